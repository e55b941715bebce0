"""Result tables: categories, history, feedback, deletion, selection, order and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from factloom.functions.textnorm import or_default
from factloom.operators import answers as A
from factloom.sources.files import stored

CATEGORIES = "array<struct<category:string,items:array<string>>>"
OTHER = "Ostatní"


def categories(assignments: DataFrame, asked: DataFrame) -> DataFrame:
    """query_set, ord, query, category from assignments(query_set, raw_text); what is no JSON list puts all asked queries in Ostatní."""
    ok = F.col("raw_text").isNotNull() & F.try_parse_json("raw_text").isNotNull() & F.startswith("raw_text", F.lit("["))
    good = assignments.where(ok).select("query_set", F.posexplode(F.from_json("raw_text", CATEGORIES)).alias("i", "c"))
    good = good.select("query_set", "i", "c.category", F.posexplode("c.items").alias("j", "query"))
    good = good.select("query_set", (F.col("i").cast("long") * 1_000_000 + F.col("j")).alias("ord"), "query", "category")
    bad = assignments.where(~F.coalesce(ok, F.lit(False))).select("query_set").join(asked, "query_set")
    return good.unionByName(bad.select("query_set", F.col("ord").cast("long").alias("ord"), "query", F.lit(OTHER).alias("category")))


def history(rows: DataFrame, mapping: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Flattened batch answers as history rows: an empty label is none, category and confidence are added."""
    out = A.with_category(rows, mapping)
    return out.withColumn("label", F.nullif("label", F.lit(""))).withColumn("confidence", F.lit(confidence))


def positioned(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with position: their place, from 1, in the given order, which should tell all rows apart.

    Spark deals the rows by ranges and sorts each partition, which numbers its own rows; the numbers begin after the rows of the partitions before. Only
    counts by partition meet in one place, and are broadcast: as many rows as the sort has partitions.
    """
    sorted_rows = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("position", F.col("_before") + within + 1).drop("_part", "_at", "_before")


def newest_first(rows: DataFrame, ts: str, order: str) -> DataFrame:
    """rows with position, the newest first."""
    return positioned(rows, F.col(ts).desc(), F.col(order))


def to_highlight(full_context: Column, values: Column, value: Column) -> Column:
    """The full context, else all values, else the value, as an array."""
    some = F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0
    one = F.when(F.coalesce(value, F.lit("")) != "", F.array(value)).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(full_context, F.lit("")) != "", F.array(full_context)).when(some, values).otherwise(one)


def with_status(rows: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """rows with the latest status of feedback(key, status, ts); null without any. Of equal times the greater status counts."""
    latest = feedback.groupBy(key).agg(F.max(F.struct("ts", "status"))["status"].alias("status"))
    return rows.join(latest, key, "left")


def without_history(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """rows less all of each history item of which a row is selected."""
    return rows.join(selected.select("hist_id").distinct(), "hist_id", "left_anti")


def only_selected(rows: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """The selected rows; all of them if none is selected."""
    if selected.isEmpty():
        return rows
    return rows.join(selected.select(*keys).distinct(), keys, "left_semi")


def sorted_by(rows: DataFrame, column: str, order: str, descending: bool = False) -> DataFrame:
    """rows with position by a column, text in the root locale's order; equal keys keep their order."""
    c = F.collate(column, "UNICODE") if dict(rows.dtypes)[column] == "string" else F.col(column)
    return positioned(rows, c.desc() if descending else c.asc(), F.col(order))


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """hits, found, wanted, precision, recall, f1 over distinct (doc_id, query, value)."""
    keys = ["doc_id", "query", "value"]
    pairs = found.select(*keys, F.lit(1).alias("f")).distinct().join(truth.select(*keys, F.lit(1).alias("t")).distinct(), keys, "full_outer")
    n = pairs.agg(F.count(F.col("f") + F.col("t")).alias("hits"), F.count("f").alias("found"), F.count("t").alias("wanted"))
    of = lambda a, b: F.try_divide(F.col(a), F.col(b))
    f1 = F.try_divide(2 * F.col("hits"), F.col("found") + F.col("wanted"))
    return n.select("*", of("hits", "found").alias("precision"), of("hits", "wanted").alias("recall"), f1.alias("f1"))


#: Fixed: confidences of answers by where they come from.
FROM_API, MISSING_ONE, FROM_BATCH, FAILED_BATCH = 0.95, 0.9, 0.95, 0.0


def with_confidence(rows: DataFrame, origin: str | None = None, failed: str | None = None) -> DataFrame:
    """rows with confidence: 0.95 for answers of the search service and of a batch, 0 for a failed batch, else the row's own, or 0.9 where that is missing or zero.

    origin: the column that says where a row comes from: `api`, `batch`, or neither; failed: the column that marks a batch that failed.
    """
    out = A.confidence(F.col("confidence"), MISSING_ONE)
    if origin:
        lost = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
        batch = F.when(lost, FAILED_BATCH).otherwise(FROM_BATCH)
        out = F.when(F.col(origin) == "api", FROM_API).when(F.col(origin) == "batch", batch).otherwise(out)
    return rows.withColumn("confidence", out)


def answer_text(raw: Column) -> Column:
    return or_default(raw, A.MISSING)
