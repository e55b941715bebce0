"""Exact top-k by integer inner product: a ball tree in each shard, searched by branch and bound.

Rows are dealt by hash into shards of bounded size; each shard becomes a ball tree, packed into one row. Queries are
packed into blocks of bounded size. A cell of a few shards beside a group of a few query blocks is one unit of work; both are dealt to it by a
shuffle, a shard once for each group and a block once for each cell, and nothing is broadcast. Nodes are taken best first by their upper
bound q.c + |q| r, and a search ends when the best bound left is below the query's current k-th score. That score is
shared: a first pass over one pilot shard gives every query a k-th score, with which the searches of the other shards begin, and
each tree of a cell raises it for the cell's next ones.
Bounds carry a slack for rounding and equal scores are never cut, so the result is exact.

Components become floor(scale * x), x taken as double. Vectors that are null or hold null, NaN or infinite components take
no part. Vectors of unlike length are compared on the components they share. Rows with the query's own id
are not its candidates. A repeated row is one query, but each of its copies is a candidate of others. Ties go to the smaller id. Fewer candidates than k give fewer rows; an empty table gives none. Only
the named columns are read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.common import stored

SHARD, QUERIES, LEAF = 4096, 1024, 48
#: shards and query blocks that one task holds at most
CELL = 32


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        out = {k: z[k] for k in z.files}
    return out | {k: out[k].astype(np.float64) for k in ("points", "vectors") if k in out}


def _narrow(points: np.ndarray) -> np.ndarray:
    """Whole numbers as the smallest integers that hold them; _unpack() gives doubles again."""
    top = np.abs(points).max(initial=0)
    return points.astype(np.int16 if top < 2**15 else np.int32) if top < 2**31 else points


def _matrix(vectors, scale: float) -> np.ndarray:
    wide = max(map(len, vectors))
    out = np.zeros((len(vectors), wide))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(np.asarray(v, dtype=np.float64) * scale)
    return out


class BallTree:
    """order: rows as the leaves hold them; nodes: centre, radius, first row, end, children (or -1)."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.first, self.end, self.child = [], [], [], [], []
        self._build(points, 0, len(points))

    def _build(self, points: np.ndarray, first: int, end: int) -> int:
        own = points[self.order[first:end]]
        centre = own.mean(axis=0)
        far = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(far.max())
        self.first.append(first)
        self.end.append(end)
        self.child.append((-1, -1))
        if end - first > LEAF and far.max() > 0:
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            side = own @ (b - a)
            half = (end - first) // 2
            self.order[first:end] = self.order[first:end][np.argsort(side, kind="stable")]
            self.child[node] = (self._build(points, first, first + half), self._build(points, first + half, end))
        return node

    def packed(self, ids: np.ndarray, points: np.ndarray) -> bytes:
        return _pack(ids=ids[self.order], points=_narrow(points[self.order]), centre=np.array(self.centre), radius=np.array(self.radius), first=np.array(self.first), end=np.array(self.end), child=np.array(self.child))


def search(tree: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of all rows that can be among a query's k best, given kth, the score that k others reach."""
    wide = min(vectors.shape[1], tree["points"].shape[1])
    vectors = vectors[:, :wide]
    points = tree["points"][:, :wide]
    exact = float(np.abs(points).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, wide) < 2.0**52
    if not exact:
        points, whole = points.astype(object), vectors
    length = np.sqrt((vectors**2).sum(axis=1))
    bound = vectors @ tree["centre"][:, :wide].T + length[:, None] * tree["radius"]
    size = np.sqrt((tree["centre"] ** 2).sum(axis=1)) + tree["radius"]
    bound += 1e-9 * length[:, None] * size + 1e-6
    first, end, child, rows = tree["first"].tolist(), tree["end"].tolist(), tree["child"].tolist(), tree["ids"]
    for q in range(len(ids)):
        bounds, best = bound[q].tolist(), []  # best: a heap of (score, -id), the worst in front
        least, heap = float(kth[q]), [(-bounds[0], 0)]
        vector = vectors[q] if exact else np.array([int(x) for x in whole[q]], dtype=object)
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            a, b = child[node]
            if a >= 0:
                for c in (a, b):
                    if bounds[c] >= least:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            at = slice(first[node], end[node])
            scores = points[at] @ vector
            for i in np.flatnonzero(np.asarray(scores >= least, dtype=bool)):
                vec_id = int(rows[at][i])
                if vec_id == int(ids[q]):
                    continue
                item = (int(scores[i]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                least = max(least, float(best[0][0]))
        for score, vec_id in best:
            yield int(ids[q]), -vec_id, score


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. is_query is a condition on the column vec_id."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(pdf["v"].to_list(), scale)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "tree": [BallTree(points).packed(pdf["vec_id"].to_numpy(), points)]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(pdf["v"].to_list(), scale)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "asked": [_pack(ids=pdf["vec_id"].to_numpy(), vectors=_narrow(points))]})

    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    trees = stored(rows.withColumn("shard", dealt).groupBy("shard").applyInPandas(plant, "shard int, tree binary"), "trees")
    dealt = F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int")
    queries = stored(rows.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("block", dealt).groupBy("block").applyInPandas(pack, "block int, asked binary"), "queries")
    found = "block int, query_id long, vec_id long, score long"

    def cell(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query among the rows of these trees, less what cannot be among its k best of all."""
        blocks = []
        for _, row in asked.iterrows():
            known = {} if row["ids"] is None else dict(zip(row["ids"], row["kths"], strict=True))
            q = _unpack(row["asked"])
            blocks.append((row["block"], q, np.array([known.get(i, -np.inf) for i in q["ids"].tolist()], dtype=float), {}))
        for blob in trees["tree"]:
            tree = _unpack(blob)
            for _, q, least, held in blocks:
                for query_id, other, score in search(tree, q["ids"], q["vectors"], least, k):
                    held.setdefault(query_id, []).append((-score, other))
                for i, query_id in enumerate(q["ids"].tolist()):
                    if query_id in held:
                        best = held[query_id] = sorted(held[query_id])[:k]
                        if len(best) == k:
                            least[i] = max(least[i], -best[-1][0])
        hits = [(block, query_id, other, -score) for block, _, _, held in blocks for query_id, best in held.items() for score, other in best]
        return pd.DataFrame(hits, columns=["block", "query_id", "vec_id", "score"])

    def searched(trees: DataFrame, queries: DataFrame, by_cell: int, by_group: int) -> DataFrame:
        """Each query block beside each tree, by_cell trees and by_group blocks in one unit of work."""
        cells, groups = -(-shards // by_cell), -(-blocks // by_group)
        left = trees.select("tree", F.floor(F.col("shard") / by_cell).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        right = queries.select("*", F.floor(F.col("block") / by_group).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
        return left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInPandas(cell, found)

    none = F.lit(None).cast("array<long>")
    first = queries.select("block", "asked", none.alias("ids"), none.alias("kths"))
    seen = stored(searched(trees.where("shard = 0"), first, shards, 1), "pilot")
    if shards > 1:
        kth = seen.groupBy("block", "query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
        known = kth.groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("known"))  # a block's queries at most
        queries = queries.join(known.hint("merge"), "block", "left").select("block", "asked", F.col("known.query_id").alias("ids"), F.col("known.kth").alias("kths"))
        by_group = min(CELL, blocks)
        units = 4 * vectors.sparkSession.sparkContext.defaultParallelism
        by_cell = max(1, min(CELL, shards * -(-blocks // by_group) // units))
        seen = seen.unionByName(searched(trees.where("shard > 0"), queries, by_cell, by_group))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return seen.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
