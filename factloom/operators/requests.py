"""What is asked of a model: query sets, chunks, prompts. The model itself is not called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions.textnorm import js_trim, normalized_for_model

CHUNK = 5


def distinct_queries(queries: DataFrame) -> DataFrame:
    """query_set, query, ord: each query of a set once, where it is first asked."""
    return queries.groupBy("query_set", "query").agg(F.min("ord").alias("ord"))


def chunks(queries: DataFrame, size: int = CHUNK) -> DataFrame:
    """queries with chunk_id and place, both from 0, by ord in their set."""
    n = F.row_number().over(W.partitionBy("query_set").orderBy("ord")) - 1
    return queries.withColumn("chunk_id", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


def numbered(chunked: DataFrame) -> DataFrame:
    """query_set, chunk_id, listed: `1. a`, `2. b` and so on, a line each."""
    rows = F.array_sort(F.collect_list(F.struct("place", "query")))
    lines = F.transform(rows, lambda r: F.concat((r["place"] + 1).cast("string"), F.lit(". "), r["query"]))
    return chunked.groupBy("query_set", "chunk_id").agg(F.array_join(lines, "\n").alias("listed"))


def request_parts(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, document, chunks: a row for each document(doc_id, text, query_set), its prepared text once, with the array of chunk_id and listed of its set.

    A set's lists are gathered before they meet the documents, so that what is moved and stored doesn't grow with the number of chunks.
    """
    sets = lists.groupBy("query_set").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "listed"))).alias("chunks"))
    return documents.select("doc_id", "query_set", normalized_for_model(F.col("text")).alias("document")).join(sets, "query_set").select("doc_id", "document", "chunks")


def rendered(parts: DataFrame, template: str = "Dokument:\n{document}\n\nDotazy:\n{queries}") -> DataFrame:
    """doc_id, chunk_id, prompt of request_parts(), made where they are used: a narrow step."""
    before, rest = template.split("{document}")
    between, after = rest.split("{queries}")
    rows = parts.select("doc_id", "document", F.explode("chunks").alias("c"))
    return rows.select("doc_id", "c.chunk_id", F.concat(F.lit(before), "document", F.lit(between), "c.listed", F.lit(after)).alias("prompt"))


def refusal(query: Column, document: Column) -> Column:
    """Why a request is refused: `query` or `document` is missing or blank; null if it is accepted."""
    blank = lambda c: F.length(js_trim(F.coalesce(c, F.lit("")))) == 0
    return F.when(blank(query), "query").when(blank(document), "document")


def expanded(queries: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """query_id, word, synonym for each head word that is a word of the query, ignoring case."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"))).alias("word"))
    rows = [F.struct(F.lit(w).alias("word"), F.lit(s).alias("synonym")) for w, ss in synonyms.items() for s in ss]
    table = F.filter(F.array(*rows), lambda r: r["word"] == F.col("word"))
    return words.where(F.col("word").isin(*synonyms)).select("query_id", F.explode(table).alias("r")).select("query_id", "r.word", "r.synonym")
