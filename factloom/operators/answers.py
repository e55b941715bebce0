"""A language model's answers: parse, flatten, complete, verify and tabulate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import values as V
from factloom.functions.textnorm import js_trim, or_default

MISSING = "Nenalezeno"  # fixed: data, not null
ITEM = "struct<label:string,value:string>"
SINGLE = f"struct<type:string,value:string,label:string,results:array<{ITEM}>>"
BATCH = f"struct<results:array<struct<query:string,type:string,value:string,values:array<{ITEM}>>>>"
YES_NO = "struct<answer:string,fullContext:string>"
PLACED = "struct<results:array<struct<label:string,value:string,start:int,end:int,confidence:double,type:string,context:string>>>"


def _json(raw: Column) -> Column:
    return F.try_parse_json(raw).isNotNull()


def single(raw: Column) -> Column:
    """A single search's answer; text that is no JSON becomes its value. The reply is trimmed first, a blank one is Nenalezeno."""
    value = or_default(js_trim(raw), MISSING)
    plain = F.struct(F.lit("single").alias("type"), value.alias("value"), F.lit(None).cast("string").alias("label"), F.lit(None).cast(f"array<{ITEM}>").alias("results"))
    return F.when(_json(value) & value.startswith("{"), F.from_json(value, SINGLE)).otherwise(plain)


def yes_no(raw: Column) -> Column:
    got = F.from_json(raw, YES_NO)
    both = raw.startswith("{") & _json(raw) & (F.coalesce(got["answer"], F.lit("")) != "") & (F.coalesce(got["fullContext"], F.lit("")) != "")
    return F.when(both, got).otherwise(F.struct(raw.alias("answer"), F.lit(None).cast("string").alias("fullContext")))


def placed(raw: Column) -> Column:
    """Positional answer: the text, or its part from the first { to the last }, as JSON; else null."""
    part = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(_json(raw), F.from_json(raw, PLACED)).when(_json(part) & (part != ""), F.from_json(part, PLACED))


def confidence(c: Column, default: float) -> Column:
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))


def flatten(answers: DataFrame) -> DataFrame:
    """doc_id, chunk_id, query, label, value: a row for each item of a multiple result and for each single one."""
    # an exploded array of one: an answer that is made by an expression is made once, not again in the filter
    answers = answers.select("doc_id", "chunk_id", F.explode(F.array("raw_text")).alias("raw_text"))
    rows = answers.where(_json(F.col("raw_text"))).select("doc_id", "chunk_id", F.explode(F.from_json("raw_text", BATCH)["results"]).alias("r"))
    one = F.array(F.struct(F.lit(None).cast("string").alias("label"), or_default(F.col("r.value"), MISSING).alias("value")))
    items = F.when((F.col("r.type") == "multiple") & F.col("r.values").isNotNull(), F.col("r.values")).otherwise(one)
    return rows.select("doc_id", "chunk_id", F.col("r.query").alias("query"), F.posexplode(items).alias("item", "v")).select("doc_id", "chunk_id", "query", "item", "v.label", "v.value")


def completed(results: DataFrame, asked: DataFrame) -> DataFrame:
    """results and a Nenalezeno row for each distinct (doc_id, query) of asked without one: one join, so that both are made once."""
    rows = results.select("doc_id", "query", "label", "value", F.lit(True).alias("_given")).join(asked.select("doc_id", "query").distinct(), ["doc_id", "query"], "full_outer")
    return rows.select("doc_id", "query", "label", F.when(F.col("_given"), F.col("value")).otherwise(MISSING).alias("value"))


def completed_one_each(results: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, ord, query, value: one row for each asked query; of repeated answers the last (by item order) counts."""
    last = W.partitionBy("doc_id", "query").orderBy(F.col("chunk_id").desc(), F.col("pos").desc())
    results = results.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("doc_id", "query", "value")
    return asked.join(results, ["doc_id", "query"], "left").select("doc_id", "ord", "query", or_default(F.col("value"), MISSING).alias("value"))


def right_place(text: Column, value: Column) -> Column:
    """0-based place of the trimmed value in text, exactly or else ignoring case; null if absent."""
    value = js_trim(value)
    exact, loose = F.instr(text, value), F.instr(F.lower(text), F.lower(value))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)


def verified(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Positional results whose span holds the value, or that could be placed elsewhere with less confidence and the text found there.

    A result whose span is empty or not within the text is dropped.

    results(doc_id, r) are gathered for each document first, so that a text meets its results once.
    """
    r = F.col("r")
    fits = (F.coalesce(r["value"], F.lit("")) != "") & r["start"].isNotNull() & r["end"].isNotNull()
    per_doc = results.where(fits).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item", "r"))).alias("rs"))
    rows = per_doc.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.explode("rs").alias("x")).select("doc_id", "text", "x.item", "x.r.*")
    start, end, text, value = F.col("start"), F.col("end"), F.col("text"), F.col("value")
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    same = F.coalesce(inside & (js_trim(F.substring(text, start + 1, end - start)) == js_trim(value)), F.lit(False))
    at = right_place(text, value)
    lower = F.greatest(F.lit(0.5), confidence(F.col("confidence"), 0.8) - 0.2)
    out = rows.where(inside).withColumn("same", same).withColumn("at", at).where(F.col("same") | F.col("at").isNotNull())
    keep, size = F.col("same"), F.length(js_trim(value))
    return out.select(
        "doc_id", "item", "label", F.when(keep, value).otherwise(F.substring(text, F.col("at") + 1, size)).alias("value"),
        F.when(keep, start).otherwise(F.col("at")).alias("start"), F.when(keep, end).otherwise(F.col("at") + size).alias("end"),
        F.when(keep, F.col("confidence")).otherwise(lower).alias("confidence"), "type",
    )


def with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """rows with category; of a query's several categories the last counts, without any it is Ostatní."""
    last = W.partitionBy("query").orderBy(F.col("ord").desc())
    one = categories.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("query", F.col("category").alias("_c"))
    return rows.join(one, "query", "left").withColumn("category", F.coalesce("_c", F.lit("Ostatní"))).drop("_c")


ANSWER = f"struct<type:string,value:string,label:string,results:array<{ITEM}>>"


def table_rows(history: DataFrame) -> DataFrame:
    """Result rows of history(hist_id, category, query, answer, value, content, label); answer is of type ANSWER, the rest are strings.

    A single answer gives one row, one of several results a row for each, an answer of another type or without results none. History items
    without an answer give one row of their own value, or else content, and label. Categories stay as they are, empty ones too.
    """
    one = lambda label, value: F.array(F.struct(label.alias("label"), value.alias("value")))
    kind, none = F.col("answer.type"), F.array().cast(f"array<{ITEM}>")
    own = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(or_default(F.col("content"), ""))
    items = F.when(F.col("answer").isNull(), one(F.col("label"), own)).when(kind == "single", one(F.col("answer.label"), F.col("answer.value")))
    items = F.coalesce(items.when(kind == "multiple", F.col("answer.results")).otherwise(none), none)
    rows = history.select("hist_id", "category", "query", F.posexplode(items).alias("item_idx", "v"))
    value = or_default(F.col("v.value"), "")
    type_ = V.table_type(value)
    return rows.select(
        "hist_id", "item_idx", or_default(F.col("category"), "").alias("category"), or_default(F.col("query"), "Dotaz").alias("query"),
        or_default(F.col("v.label"), "Výsledek").alias("label"), value.alias("value"), type_.alias("type"), V.absolute_value(value, type_).alias("absolute_value"),
    )
