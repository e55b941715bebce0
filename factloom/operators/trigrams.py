"""Search for a part of a text in stored rows without reading all files: each file has a bitmap of the trigrams of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.report import containing

ROWS = 500_000  # of a file, about: more rows make more files, not larger ones
BITS = 1 << 20  # of a file's bitmap, in rows of 32,768: a sparse one has few rows


def _trigrams(text: Column) -> Column:
    """The trigrams of a text in lower case, by three cuts of it at offsets 0, 1 and 2."""
    text = F.lower(text)
    return F.concat(*[F.regexp_extract_all(F.substring(text, F.lit(i + 1), F.length(text)), F.lit("(?s).{3}"), F.lit(0)) for i in range(3)])


def _bit(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS)) + 1  # bitmaps count from 1


def write_indexed(rows: DataFrame, path: str, columns: list[str]) -> None:
    """rows in files under path/rows, as they are dealt, and path/trigrams: file, bucket and bitmap of the trigrams of the columns."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/rows")
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.concat(*[F.coalesce(_trigrams(F.col(c).cast("string")), F.array().cast("array<string>")) for c in columns]).alias("grams"))
    grams = back.select("file", F.explode(F.array_distinct("grams")).alias("gram")).select("file", _bit(F.col("gram")).alias("bit")).distinct()  # bits of a file are bounded; bitmaps are made by sorting what they are made of
    maps = grams.groupBy("file", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    maps.write.parquet(f"{path}/trigrams")


def dealt(rows: DataFrame, key: str, least: int = 8) -> DataFrame:
    """rows in ranges of the key, about ROWS in each."""
    return rows.repartitionByRange(max(least, -(-rows.count() // ROWS)), key)


def files_with(spark: SparkSession, path: str, term: str) -> list[str] | None:
    """The files that may hold the term (as many names as there are such files); None if it is too short to tell."""
    if len(term) < 3:
        return None
    bits = spark.range(1).select(F.explode(F.array_distinct(_trigrams(F.lit(term)))).alias("gram")).select(_bit(F.col("gram")).alias("bit")).distinct()
    bits = bits.select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    wanted = F.broadcast(bits)  # one for each trigram of the term
    n = bits.count()
    there = spark.read.parquet(f"{path}/trigrams").join(wanted, "bucket")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) > 0
    return sorted(r.file for r in there.where(held).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == n).select("file").collect())


def search(spark: SparkSession, path: str, columns: list[str], term: str) -> DataFrame:
    """The rows that hold the term in one of the columns, in any case; only files that may hold it are read."""
    files = files_with(spark, path, term)
    every = spark.read.parquet(f"{path}/rows")
    if files is None:
        return containing(every, columns, term)
    return containing(spark.read.schema(every.schema).parquet(*files) if files else every.limit(0), columns, term)
