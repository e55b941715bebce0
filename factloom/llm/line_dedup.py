"""Lines that many documents share are dropped, everywhere they occur.

A text is split at line feeds. A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of at least
least_chars code points that occur in at least least_docs documents lose all their lines. What is left is joined by line feeds, in order.

Lines are exploded once, into a narrow table of (row, place, 128 bits of hash of the key): texts are not moved for counting. Distinct documents
are counted for each hash, dealt by (hash, document), so that a hash in all documents is as cheap as others. Of the frequent hashes,
those with a ten-thousandth of all frequent lines or more, of which there can be ten thousand at most, are broadcast and their lines are marked in
place; the lines of the others are joined by hash. The marked places of a row are gathered (never more than it has lines) and joined to the text by
the row's key, a hash of id and text, so that a lost executor may compute it again; a much repeated row is left to AQE's skew join.

Defined results: a null or empty text is one empty line; keys shorter than least_chars are never dropped; a text that loses all lines becomes
empty. Rows that share an id are one document in counting, but each keeps its own lines; rows without an id are known by their text. Repeated
rows give repeated results. An empty table gives an empty result. Columns of docs named n_lines or n_dropped are replaced, others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

#: Fixed: the white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 10_000
ROW = ["_line_doc", "_line_same"]  # what tells rows apart


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text, before stripping; case is folded once for the text."""
    return F.split(F.translate(text, UPPER, LOWER), "\n", -1)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with the text (null: empty) and the row's key. The hash of a long is one to one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    doc = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit("no id"), whole)).otherwise(F.xxhash64(doc_id))
    return docs.withColumns({"_line_text": whole, ROW[0]: doc, ROW[1]: F.xxhash64(whole)})


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """The row's key, place and h1, h2 (of the line's key) of every line that is long enough to be dropped."""
    rows = _keyed(docs, doc_id, text).select(*ROW, F.posexplode(line_keys(F.col("_line_text"))).alias("place", "key"))
    rows = rows.withColumn("key", F.btrim("key", F.lit(SPACE))).where(F.length("key") >= least_chars)
    return rows.select(*ROW, "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def frequent(found: DataFrame, least_docs: int = 10) -> DataFrame:
    """h1, h2, n_docs, n_lines of the keys of lines() in at least so many documents."""
    return found.groupBy("h1", "h2").agg(F.count_distinct(ROW[0]).alias("n_docs"), F.count("*").alias("n_lines")).where(F.col("n_docs") >= least_docs)


def _marked(found: DataFrame, often: DataFrame) -> DataFrame:
    """The rows of found whose hash is in often."""
    total = often.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.col("n_lines") * HOT >= total  # at most HOT hashes, however large the table: their lines sum to total
    few = F.broadcast(often.where(hot).select("h1", "h2"))
    at_once = found.join(few, ["h1", "h2"], "left_semi")
    rest = found.join(few, ["h1", "h2"], "left_anti").join(often.where(~hot).select("h1", "h2"), ["h1", "h2"])
    return at_once.select(*ROW, "place").unionByName(rest.select(*ROW, "place"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 1, least_docs: int = 10) -> DataFrame:
    """docs with the text that is left, n_lines (before dropping) and n_dropped."""
    found = stored(lines(docs, doc_id, text, least_chars), "lines")
    often = stored(frequent(found, least_docs), "frequent-lines")
    gone = _marked(found, often).distinct().groupBy(*ROW).agg(F.collect_list("place").alias("_line_gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # cut into lines before the join, so that the lambda below reads a column and does not cut again for each line
    rows = _keyed(docs.select(*names), doc_id, text).withColumn("_line_all", F.split("_line_text", "\n", -1)).drop("_line_text", text)
    rows = rows.join(gone, ROW, "left")
    places = F.sequence(F.lit(0), F.size("_line_all") - 1)
    left = F.transform(F.array_except(places, F.col("_line_gone")), lambda i: F.get("_line_all", i))
    kept = F.when(F.col("_line_gone").isNull(), F.array_join("_line_all", "\n")).otherwise(F.array_join(left, "\n"))
    n_gone = F.when(F.col("_line_gone").isNull(), 0).otherwise(F.size("_line_gone"))
    return rows.select(*[kept.alias(c) if c == text else F.col(c) for c in names], F.size("_line_all").cast("long").alias("n_lines"), n_gone.cast("long").alias("n_dropped"))
