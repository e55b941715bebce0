"""Audit-log jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DEBUG, INFO, WARN, ERROR = range(4)


def filtered(log: DataFrame, level: int, category: str | None = None) -> DataFrame:
    out = log.where(F.col("level") >= level)
    return out if category is None else out.where(F.col("category") == category)


def newest(log: DataFrame, order: list, n: int = 1000) -> DataFrame:
    return log.orderBy(*order).limit(n)


def slow(log: DataFrame, limit: float = 1000.0) -> DataFrame:
    level = F.when(F.col("duration") > limit, WARN).otherwise(DEBUG)
    return log.withColumn("level", level).groupBy("category", "level").agg(F.count("*").alias("n"), F.max("duration").alias("longest"))


def mismatches(rows: DataFrame, told: str, found: str) -> DataFrame:
    return rows.where(~F.col(told).eqNullSafe(F.col(found))).withColumn("told_length", F.length(told)).withColumn("found_length", F.length(found))


def validations(rows: DataFrame, valid: str) -> DataFrame:
    return rows.withColumn("level", F.when(F.col(valid), DEBUG).otherwise(WARN))


def search_results(answers: DataFrame, places: DataFrame) -> DataFrame:
    """The answers with match_count, in how many places their value stands, and result_count, how many results their search has: a row for each result, however many.

    answers: doc_id, query_id, label, value; places: doc_id, value, start. A value without a place has match_count 0. Places are counted before they meet the answers.
    """
    counts = places.groupBy("doc_id", "value").agg(F.count("*").alias("match_count"))
    rows = answers.join(counts, ["doc_id", "value"], "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return rows.withColumn("result_count", F.count("*").over(W.partitionBy("doc_id", "query_id")))


def searches(answers: DataFrame, places: DataFrame, shown: int | None = None) -> DataFrame:
    """doc_id, query_id, result_count and results, an array of (label, value, match_count), for each search: what it gave and in how many places.

    The array holds all results of a search by item (a column of the answers), or its first `shown`, for whoever asks for no more; result_count counts all. Where
    one search may have more results than fit in an array, take search_results().
    """
    rows = search_results(answers, places)
    if shown is not None:
        nth = F.row_number().over(W.partitionBy("doc_id", "query_id").orderBy("item", "label", "value"))
        rows = rows.withColumn("_kept", nth <= shown)
    one = F.struct("item", F.struct("label", "value", "match_count").alias("r"))
    out = rows.groupBy("doc_id", "query_id").agg(F.count("*").alias("result_count"), F.array_sort(F.collect_list(one if shown is None else F.when(F.col("_kept"), one))).alias("results"))
    return out.withColumn("results", F.transform("results", lambda x: x["r"]))


def write_json(log: DataFrame, path: str) -> None:
    log.write.json(path)
