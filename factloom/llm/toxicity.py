"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting takes a bounded sample of labelled rows (max_rows, by the order of a hash of the id; of these, max_examples are the
examples that texts are compared with, half of each label if there are so many). These are the only bounds. Terms are all words of the sample and
their beginnings, of both labels, however rare or frequent; beginnings let an inflected form share a term with the forms seen. A term weighs
(1 + log tf) * idf * contrast, where contrast is the absolute z value of the difference between its shares of the two labels: a long
text is then near to examples of its own kind rather than of its own topic.

Scoring runs over every whole text. Words are whole, however long. The index holds each term's postings in blocks of examples with the block's largest
weight. A text's upper bound for a block is the sum of its weights times these (or, if less, the length of what it shares with the block); the four blocks of the
highest bounds are scored exactly, then all others whose bounds reach the k-th cosine so far, so the k nearest are exact (equal cosines: the earlier
example; examples lie so that blocks hold like ones). Votes weigh by 1 / (distance + 0.05) and by how many labelled rows an example stands for. Votes are mapped to
probabilities by isotonic regression on a third of the sample that neither the terms nor the examples come from. A text that shares no
term with the examples gets the share of toxic rows. Equal texts count once in fitting.

Null and empty texts have no terms and get that share too. Repeated rows get equal scores; ties in labels of one id
count as toxic. Without labelled rows every score is 0. An empty table gives an empty result. An id that is no number is null in evidence. Labels, language, source and id are
never inputs of a score. All columns of docs are kept (columns named score, predicted or evidence are replaced). Scoring shuffles nothing;
fitting joins a broadcast sample of at most max_rows ids, and brings its terms and the examples' vectors to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.cluster import small_batches
from factloom.llm.common import stored

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are terms too.
STARTS = (4, 5)
BLOCK, KEPT, CHARS = 64, 100_000, 4_000_000
HELD = 1.05  # 1 plus what is added to distances
FIRST = 4  # blocks that are scored before others are compared with the k-th cosine


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _spread(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [first, end), one range after the other, and how many each has."""
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), n


@dataclass
class Model:
    terms: dict[str, int]  # term -> place
    value: np.ndarray  # idf * contrast
    base: float  # probability of a text without terms
    weight: tuple[float, float] = (1.0, 1.0)  # labelled rows that an example of label 0, 1 stands for
    ids: list[int | None] = field(default_factory=list)
    label: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    # the index: a term's entries, one for each block that holds it; an entry's postings
    entries: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # term -> first entry
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # entry -> block
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))  # entry -> largest weight
    postings: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # entry -> first posting
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # posting -> example
    held: np.ndarray = field(default_factory=lambda: np.zeros(0))  # posting -> weight
    votes: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # isotonic map from votes ...
    scores: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # ... to probabilities
    k: int = 15
    size: int = BLOCK  # examples of a block

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the model's terms in the text, and how often each is there."""
        known, out = self.known, {}
        for word, n in Counter(WORD.findall(text.lower())).items():
            if (places := known.get(word)) is None:
                places = known[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
            for t in places:
                out[t] = out.get(t, 0) + n
        if len(known) > KEPT:
            known.clear()
        return np.fromiter(out.keys(), np.int64, len(out)), np.fromiter(out.values(), float, len(out))

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.value[at]
        length = np.sqrt((w * w).sum())
        return w / length if length > 0 else w

    def index(self, rows: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> None:
        """rows: id, label, places of terms, their weights. Examples lie so that blocks hold like ones, which keeps bounds low."""
        self._place(rows)
        like = np.zeros((len(rows), len(rows)))
        for i, (_, _, at, w) in enumerate(rows):
            like[i] = self.cosines(at, w)
        order, parts = [], [np.arange(len(rows))]
        while parts:
            own = parts.pop()
            if len(own) <= self.size:
                order += own.tolist()
                continue
            a = own[like[own].T[own].sum(axis=1).argmin()]  # the one least like the others, and the one least like it
            b = own[like[a, own].argmin()]
            own = own[np.argsort(like[b, own] - like[a, own], kind="stable")]
            half = -(-len(own) // 2 // self.size) * self.size
            parts += [own[half:], own[:half]]
        self._place([rows[i] for i in order])

    def cosines(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """With all examples, without pruning."""
        post, n = _spread(self.postings[self.entries[at]], self.postings[self.entries[at + 1]])
        return np.bincount(self.example[post], np.repeat(w, n) * self.held[post], len(self.ids))

    def _place(self, found: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> None:
        self.ids, self.label = [r[0] for r in found], np.array([r[1] for r in found], dtype=np.int64)
        at = np.concatenate([r[2] for r in found])
        example = np.repeat(np.arange(len(found)), [len(r[2]) for r in found])
        order = np.lexsort((example, at))
        at, self.example, self.held = at[order], example[order], np.concatenate([r[3] for r in found])[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(self.example // self.size) != 0)
        first = np.flatnonzero(new)
        self.postings = np.append(first, len(at))
        self.block = self.example[first] // self.size
        self.most = np.maximum.reduceat(self.held, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(at[first], np.arange(len(self.terms) + 1))

    def nearest(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosines, and these."""
        entry, n = _spread(self.entries[at], self.entries[at + 1])
        w, block = np.repeat(w, n), self.block[entry]
        blocks = -(-len(self.ids) // self.size)
        bound = np.minimum(np.bincount(block, w * self.most[entry], blocks), np.sqrt(np.bincount(block, w * w, blocks)))
        order, best_at, best = np.argsort(-bound, kind="stable"), np.zeros(0, dtype=np.int64), np.zeros(0)
        for now in (order[:FIRST], order[FIRST:]):
            open_ = np.zeros(blocks, dtype=bool)
            open_[now] = (bound[now] > 0) & (bound[now] >= (best[-1] - 1e-9 if len(best) == self.k else 0.0))
            mine = np.flatnonzero(open_[block])
            if not len(mine):
                break
            post, n = _spread(self.postings[entry[mine]], self.postings[entry[mine] + 1])
            cosine = np.bincount(self.example[post], np.repeat(w[mine], n) * self.held[post])
            here = np.flatnonzero(cosine > max(0.0, best[-1] - 1e-9 if len(best) == self.k else 0.0))
            best_at, best = np.append(best_at, here), np.append(best, cosine[here])
            rank = np.lexsort((best_at, -np.round(best, 12)))[: self.k]
            best_at, best = best_at[rank], best[rank]
        return best_at, best

    def vote(self, at: np.ndarray, n: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray]] | None:
        if not len(at) or not len(self.ids):
            return None
        near, cosine = self.nearest(at, self.vector(at, n))
        if not len(near):
            return None
        w = np.where(self.label[near] == 1, self.weight[1], self.weight[0]) / (HELD - np.minimum(cosine, 1))
        return float((w * self.label[near]).sum() / w.sum()), (near, cosine)

    def score(self, text: str) -> tuple[float, list[tuple[int | None, int, float]]]:
        """Probability of label 1 and the nearest examples (id, label, cosine)."""
        if (voted := self.vote(*self.found(text))) is None:
            return self.base, []
        at, cosine = voted[1]
        return float(np.interp(voted[0], self.votes, self.scores)), list(zip([self.ids[i] for i in at], self.label[at].tolist(), cosine.tolist(), strict=True))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps nearest to y (pool adjacent violators), as points for interpolation."""
    pools: list[list[float]] = []  # mean, weight, lowest x, highest x
    for i in np.argsort(x, kind="stable"):
        pools.append([y[i], w[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            b, a = pools.pop(), pools.pop()
            n = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]])
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] for p in pools for _ in (0, 1)])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", max_rows=9_000, max_examples=2048, k=15, block=BLOCK) -> Model:
    """labels: (doc_id, label) of the rows that may be learnt from."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # bounded by max_rows, so it may be broadcast
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy(F.xxhash64("text").alias("same")).agg(F.min("id").alias("id"), F.max("y").alias("y"), F.first("text").alias("text"))  # copies count once
    rows = stored(rows.withColumn("tune", F.pmod("same", F.lit(3)) == 0), "labelled")
    learnt = rows.where(~F.col("tune"))
    n_neg, n_pos = (learnt.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.when(F.col("y") == 1, 1)))).first()
    if not n_pos or not n_neg:
        return Model({}, np.zeros(0), 1.0 if n_pos else 0.0, k=k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums[y].update({term for word in set(WORD.findall(t.lower())) for term in terms_of(word)})
        terms = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[t] for t in part], type=pa.int64()) for c in sums)], names=["term", "neg", "pos"])

    # the terms of at most max_rows texts
    stats = learnt.select("y", "text").mapInArrow(count, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow().sort_by("term")
    neg, pos = (stats.column(c).to_numpy().astype(float) for c in ("neg", "pos"))
    both = (pos + neg) / (n_pos + n_neg)
    contrast = np.abs(pos / n_pos - neg / n_neg) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_pos + 1 / n_neg))
    idf = np.log((n_pos + n_neg + 1) / (pos + neg + 1)) + 1
    model = Model({t: i for i, t in enumerate(stats.column("term").to_pylist())}, idf * contrast, (n_pos + 1) / (n_pos + n_neg + 2), k=k, size=block)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.found(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array([f[i].astype(np.int32) for f in found], type=pa.list_(pa.int32())) for i in (0, 1))], names=["id", "y", "at", "n"])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(v[0] if (v := sent.value.vote(*sent.value.found(t))) else None) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(got, type=pa.float64())], names=["y", "vote"])

    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)
    place = F.xxhash64("same")  # an order of its own: same tells which rows tune
    parts = [learnt.where(F.col("y") == y).orderBy(place, "same").limit(max_examples // 2) for y in (0, 1)]
    bank = parts[0].unionByName(parts[1]).select(F.col("id").try_cast("long").alias("id"), "y", "text").mapInArrow(vectors, "id long, y int, at array<int>, n array<int>").toArrow()
    columns = [bank.column(c).to_pylist() for c in ("id", "y")] + [[x.values.to_numpy().astype(np.int64) for x in bank.column(c)] for c in ("at", "n")]
    model.index(sorted(((i, y, at, model.vector(at, n)) for i, y, at, n in zip(*columns, strict=True)), key=lambda r: (r[1], r[0] is None, r[0] or 0)))
    model.weight = tuple(n / max(1, int((model.label == y).sum())) for y, n in ((0, n_neg), (1, n_pos)))
    sent = context.broadcast(model)
    voted = rows.where("tune").select("y", "text").mapInArrow(votes, "y int, vote double").where("vote IS NOT NULL").toArrow()
    if voted.num_rows:
        x, y = voted.column("vote").to_numpy(), voted.column("y").to_numpy().astype(float)
        # one row of each label at the ends keeps the map defined on all votes
        model.votes, model.scores = isotonic(np.append(x, [0.0, 1.0]), np.append(y, [0.0, 1.0]), np.ones(len(x) + 2))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, predicted and evidence (the nearest labelled examples)."""
    small_batches(docs.sparkSession)
    names = ["score", "predicted", "evidence"]
    docs = docs.drop(*names)
    example = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(example))])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_rows and max_examples
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            step = max(1, int(batch.num_rows * CHARS / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = [model.score(t or "") for t in part.column(text).to_pylist()]
                scores = pa.array([s for s, _ in got], type=pa.float64())
                predicted = pa.array([int(s >= 0.5) for s, _ in got], type=pa.int32())
                evidence = pa.array([[{"doc_id": i, "label": y, "cosine": c} for i, y, c in e] for _, e in got], type=kind)
                yield pa.RecordBatch.from_arrays([*part.columns, scores, predicted, evidence], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)
