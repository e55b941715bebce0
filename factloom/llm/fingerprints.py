"""Document fingerprints by I-Match over several randomised lexicon subsets.

The lexicon holds the terms whose share of documents lies between low and high, counted over all documents. It is small
by construction: document frequencies sum to (documents) x (mean distinct terms), so at most mean / low terms reach the
lower end, whatever the corpus. Subset j keeps a term by a hash of term and j; the subsets come in tiers of halving
rates, so that for short and long documents alike some subsets keep one or a few terms. A fingerprint is, for each subset, the
hash of the document's sorted distinct terms in it (zeros if none). Likeness is the share of equal hashes among
the subsets where either document has terms.

A text without lexicon terms is fingerprinted by all its terms, one without terms by the text itself, in every slot. Null texts count as
empty. Equal texts have equal fingerprints. Repeated rows give repeated results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.common import stored

WORD = re.compile(r"\w+")
#: Shares of the lexicon that the subsets keep: all of it once, then tiers of falling rates.
RATES = [1.0, *(r for i in range(3, 10) for r in [2.0**-i] * 7)]
KEPT = 400_000
PART = 64_000_000  # characters


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.001, high: float = 0.1, least: int = 2) -> np.ndarray:
    """Sorted hashes of the terms in the band."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out():
            at = np.fromiter(map(_hash, sums), dtype=np.uint64, count=len(sums)).view(np.int64)
            made = pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.fromiter(sums.values(), dtype=np.int64, count=len(sums)))], names=["term", "n"])
            sums.clear()
            return made

        for batch in batches:
            for t in batch.column(0).to_pylist():
                sums.update(set(WORD.findall((t or "").lower())))
                if len(sums) > KEPT:
                    yield out()
        yield out()

    counts = docs.select(F.col(text)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = docs.count()
    band = counts.where(F.col("n").between(max(least, low * n), high * n))
    return np.sort(np.array([r["term"] for r in band.select("term").collect()], dtype=np.int64).view(np.uint64))


class Printer:
    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.place = {int(t): i for i, t in enumerate(terms)}
        self.members = np.zeros((len(terms), len(RATES)), dtype=bool)
        for j, rate in enumerate(RATES):
            mixed = (terms ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            self.members[:, j] = (mixed >> np.uint64(11)) < np.uint64(int(rate * 2**53))
        self.known: dict[str, int] = {}

    def print(self, text: str) -> str:
        words, known = set(WORD.findall(text.lower())), self.known
        for w in words:
            if w not in known:
                known[w] = self.place.get(_hash(w), -1)
        at = sorted({i for i in map(known.__getitem__, words) if i >= 0})
        if len(known) > KEPT:
            known.clear()
        if not at:
            return hashlib.blake2b((" ".join(sorted(words)) or text).encode(), digest_size=4).hexdigest() * len(RATES)
        own, terms = self.members[at], self.terms[at]
        slots = own.any(axis=0)
        return "".join(hashlib.blake2b(terms[own[:, j]].tobytes(), digest_size=4).hexdigest() if slots[j] else "00000000" for j in range(len(RATES)))


def likeness(a: str, b: str) -> float:
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    told = [x == y for x, y in pairs if x != "00000000" or y != "00000000"]
    return sum(told) / len(told) if told else 1.0


def fingerprints(docs: DataFrame, terms: np.ndarray, text: str = "text") -> DataFrame:
    """docs with fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("string")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        printer = Printer(sent.value)
        for texts in batches:
            yield texts.map(lambda t: printer.print(t or ""))

    return docs.withColumn("fingerprint", fingerprint(F.col(text)))


def _beside(printer: Printer, text: str, own: str, after: str, after_print: str) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of a text, given the next one and both fingerprints."""
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    again = printer.print(edited)
    return n, hashlib.sha256(edited.encode()).hexdigest(), own, again, likeness(own, again), likeness(own, after_print)


RESULT = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, type=KINDS[k]) for v, k in zip(values, columns.values(), strict=True)], names=list(columns))


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text as compressed bytes: what is shuffled is a third less than by the shuffle's own codec."""
    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array([coder.compress(t.encode()) for t in batch.column(at).to_pylist()], type=pa.binary()))


def edited_and_next(docs: DataFrame, terms: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document by id.

    The edited text's last floor(n / 2) code points are replaced by as many (or all) first ones of the next document. After the last comes the
    first; null ids come last, equal ids in the order of a hash of their texts. Ids that are no numbers count as null.

    Documents are dealt by ranges of (id, hash, place in the input), so that neither null nor repeated ids share a part, into as many parts as the
    session shuffles into, and more where these would hold above PART characters. Each part is streamed in order: texts move once. Only the last document
    of a part lacks the next one; it is joined, by the part's number, to the first one of the part after it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).try_cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("i").asc()]
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    rows = rows.mapInArrow(_packed, "doc_id long, text binary, h long, i long")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    sent = spark.sparkContext.broadcast(terms)
    inner = RESULT | {"part": "int", "edge": "string", "text": "binary"}  # edge: null for a result, else which end of its part the document is

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer, coder, held = Printer(sent.value), zstandard.ZstdDecompressor(), None
        edge = lambda which: (held[1], None, None, held[3], None, None, None, held[0], which, zstandard.compress(held[2].encode()))
        for batch in batches:
            out = []
            for part, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                text = coder.decompress(packed).decode()
                before, held = held, (part, doc, text, printer.print(text))
                out.append((before[1], *_beside(printer, *before[2:], *held[2:]), part, None, None) if before else edge("first"))
            yield _batch(out, inner)
        if held:
            yield _batch([edge("last")], inner)

    made = stored(rows.mapInArrow(within, _ddl(inner)), "prints")
    first, last = (made.where(F.col("edge") == which).select("part", "doc_id", "text", "fingerprint") for which in ("first", "last"))
    # one number for each part that holds documents, without texts: fewer rows than tasks
    place = F.row_number().over(W.orderBy("part")) - 1
    numbers = first.select("part", place.alias("place"), F.count("*").over(W.partitionBy()).alias("n"))
    after = first.join(numbers, "part").select(F.pmod(F.col("place") - 1, F.col("n")).alias("place"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    ends = last.join(numbers, "part").join(after, "place").select("doc_id", "text", "fingerprint", "after", "after_print")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(sent.value)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([(doc, *_beside(printer, zstandard.decompress(text).decode(), own, zstandard.decompress(after).decode(), print_)) for doc, text, own, after, print_ in rows], RESULT)

    return made.where("edge IS NULL").select(*RESULT).unionByName(ends.mapInArrow(between, _ddl(RESULT)))
