"""Summaries of result rows, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions.textnorm import or_default
from factloom.functions.values import export_type

#: Fixed: the export's column headers, in order.
HEADERS = {"category": "Kategorie", "query": "Dotaz", "label": "Popisek", "value": "Hodnota", "absolute_value": "Absolutní hodnota", "type": "Typ"}


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(or_default(F.col("type"), "unknown").alias("type")).agg(F.count("*").alias("n"))


def confidence_summary(rows: DataFrame) -> DataFrame:
    c = F.col("confidence") * 100
    return rows.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def top_value_types(rows: DataFrame, order: Column, top: int = 5) -> DataFrame:
    kinds = rows.groupBy(export_type(F.col("value")).alias("value_type")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return kinds.orderBy(F.col("n").desc(), "first").limit(top).select("value_type", "n")


def types_with_samples(rows: DataFrame, order: list, samples: int = 5, shown: int = 3) -> DataFrame:
    """type, n, percent, avg_confidence, samples, sample_text: row_number keeps the few samples, so no group is gathered."""
    kind = or_default(F.col("type"), "unknown")
    rows = rows.withColumn("type", kind)
    filled = rows.where(F.coalesce("value", F.lit("")) != "").withColumn("_n", F.row_number().over(W.partitionBy("type").orderBy(*order)))
    some = filled.where(F.col("_n") <= samples).groupBy("type").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("s"))
    counts = rows.groupBy("type").agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    all_rows = F.sum("n").over(W.partitionBy())
    values = F.transform("s", lambda x: x["value"])
    out = counts.withColumn("percent", F.round(F.col("n") / all_rows * 100, 1)).join(some, "type", "left")
    return out.select("type", "n", "percent", "avg_confidence", F.array_join(values, "; ").alias("samples"), F.array_join(F.slice(values, 1, shown), "; ").alias("sample_text"))


def statistics(rows: DataFrame) -> DataFrame:
    """Without confidences their mean and deviation are 0, without match counts their sum is; means of nothing and least and greatest ones are null."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        F.count_distinct(F.nullif("value", F.lit(""))).alias("distinct_values"),
        (F.count_distinct("type") + F.coalesce(F.max(F.col("type").isNull().cast("int")), F.lit(0))).alias("distinct_types"),
        zero(F.avg("confidence")).alias("mean_confidence"), zero(F.stddev_pop("confidence")).alias("sd_confidence"),
        F.min("start_position").alias("min_start"), F.max("start_position").alias("max_start"), F.avg("start_position").alias("mean_start"),
        F.coalesce(F.sum("match_count"), F.lit(0)).alias("matches"), F.avg("match_count").alias("mean_matches"), F.max("match_count").alias("max_matches"),
    )


def per_category(queries: DataFrame) -> DataFrame:
    """category and its number of queries, and a row for all (category null)."""
    return queries.rollup("category").agg(F.count("*").alias("n"))


def containing(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return rows.where(hit)


def cut(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "...").otherwise(""))


def printable(rows: DataFrame) -> DataFrame:
    return rows.select(*[cut(F.col(c), n).alias(c) for c, n in (("category", 18), ("query", 20), ("label", 15), ("value", 15))])


def summary(rows: DataFrame, order: Column) -> DataFrame:
    """section, item, value: counts by type, confidences, and the most frequent value types."""
    kinds = type_counts(rows).select(F.lit("types").alias("section"), F.col("type").alias("item"), F.col("n").cast("double").alias("value"))
    names = ["avg_confidence", "min_confidence", "max_confidence"]
    sure = confidence_summary(rows).select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in names])).alias("x"))
    top = top_value_types(rows, order).select(F.lit("value types"), "value_type", F.col("n").cast("double"))
    return kinds.unionByName(sure.select(F.lit("confidence").alias("section"), "x.item", "x.value")).union(top)


def _manifest(spark: SparkSession, path: str, fmt: str, records: int, parts: list[str]) -> None:
    """Written last: an export without it is not whole and is not read."""
    made = spark.range(1).select(F.lit(fmt).alias("format"), F.lit(records).cast("long").alias("records"), F.array(*map(F.lit, parts)).alias("parts"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("generated"))
    made.write.json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """format, records, parts and generated (the time) of a whole export; fails if there is none."""
    return spark.read.schema("format string, records long, parts array<string>, generated string").json(f"{path}/manifest")


def write_csv(rows: DataFrame, path: str) -> int:
    """Rows as CSV and a manifest beside them, in one pass: the rows are counted while they are written."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("records"))
    counted.select(*[F.col(c).alias(h) for c, h in HEADERS.items()]).write.option("header", True).option("escape", '"').csv(f"{path}/data")
    _manifest(rows.sparkSession, path, "csv", seen.get["records"], ["data"])
    return seen.get["records"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A whole CSV export, under the columns' own names; empty texts are null."""
    manifest(spark, path)
    back = spark.read.schema(", ".join(f"`{h}` string" for h in HEADERS.values())).option("header", True).option("escape", '"').csv(f"{path}/data")
    return back.select(*[F.nullif(F.col(h), F.lit("")).alias(c) for c, h in HEADERS.items()])


def write_workbook(rows: DataFrame, path: str, order: list[str]) -> int:
    """Four sheets, each a folder, and a manifest. The rows are made once: the other sheets are made of the written results."""
    seen, spark = Observation(), rows.sparkSession
    rows.observe(seen, F.count(F.lit(1)).alias("records")).write.parquet(f"{path}/results")
    kept = spark.read.schema(rows.schema).parquet(f"{path}/results")
    sheets = {"summary": summary(kept, F.struct(*order)), "types": types_with_samples(kept, order), "statistics": statistics(kept)}
    for name, df in sheets.items():
        df.write.parquet(f"{path}/{name}")
    _manifest(spark, path, "workbook", seen.get["records"], ["results", *sheets])
    return seen.get["records"]


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a whole workbook, by name."""
    parts = manifest(spark, path).first().parts
    return {name: spark.read.parquet(f"{path}/{name}") for name in parts}


# -- distinct counts of very large tables ------------------------------------------------------------------------------
def distinct_sketches(rows: DataFrame, by: Column, columns: list[str], log_size: int = 14) -> DataFrame:
    """day and a sketch for each column: what a day has of distinct values, in a few KB. Sketches of days are kept; new days are added, old rows are not read again."""
    return rows.groupBy(by.alias("day")).agg(*[F.hll_sketch_agg(F.nullif(F.col(c).cast("string"), F.lit("")), log_size).alias(c) for c in columns])


def merged_sketches(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """About how many distinct values each column has over all given sketches (standard error 1.04 / sqrt(2 ** log_size), less than 1 %)."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
