"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target: its weight's share of all words, held at cap times its own words, with the excess shared again
by weight until no source is above (solved in closed form over one row for each source). A document of a source with
ratio r = target / words is taken floor(r) times, and once more with probability r - floor(r). Which documents get the
extra turn is chosen by the cube method: the vector of inclusion probabilities moves through the null space of two
constraints, the source's expected words and documents, until every entry but a few is 0 or 1. That is done in blocks of
bounded size in parallel; what each block leaves undecided (at most two documents or so) meets in blocks of the next level,
until one block for each source is left. There the last few documents are rounded, and a
reserve of small documents, left out of the flight until then, takes the turns that make up the difference (the landing). Where that
is too little, as in a source of few documents and a very long one, one or two turns at a time are changed.

Equal rows are counted first, and units of at most EQUAL of them fly as one: a unit of m rows has whole turns floor(m * r) and a chance of one more, and
deals its turns to its rows. So rows repeated very often spread over all blocks, and none holds more units than is meant.

Random numbers come from hashes of the units, and blocks from the same hash, so reruns agree whatever the partitions.
Null texts have size 0; documents of size 0 take no words. A null source is a source like any other and comes last. Identical
rows may be taken different numbers of times. Documents of a source without words are not taken; with no words at all every target is 0. An empty table gives an empty
result. Other columns only tell rows apart, so that clashing names do not matter.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.common import stored

BLOCK, FAN, RESERVE, LAST = 8192, 2048, 256, 10
EQUAL = 64  # equal rows that are one unit of the flight
NEAR = 0.001  # share of its target by which a source may miss it before turns are changed
SCHEMA = "key long, seed long, equal int, doc_id string, source string, size long, source_size long, target double, whole int, p double, blocks long, block long"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sources(source, source_size, ...) with target and ratio; one row for each source, so its windows are small."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int"))
    out = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.lit(cap) * F.col("source_size"))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("level", (total - before) / rest).withColumn("held", F.col("level") * F.col("weight") > F.col("most"))
    level = F.max(F.when(~F.col("held"), F.col("level"))).over(W.partitionBy())  # levels fall once none is held
    target = F.when(F.col("held"), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    ratio = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("held"), F.lit(cap)).otherwise(F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0)))
    return out.withColumn("target", target).withColumn("ratio", ratio).drop("weight", "most", "level", "held")


def flight(size: np.ndarray, p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """p moved to 0 and 1, keeping sum(p) and sum(p * size), but for a few entries."""
    p = [float(x) for x in p]
    size = [float(x) for x in size]
    chance = [float(x) for x in chance]
    tiny = 1e-9
    live = [i for i in range(len(p)) if tiny < p[i] < 1 - tiny]
    for i in range(len(p)):
        if not tiny < p[i] < 1 - tiny:
            p[i] = float(round(p[i]))
    hand: list[int] = []
    turn = 0

    def move(units: list[int], u: list[float]) -> None:
        nonlocal turn
        up = down = float("inf")
        for i, x in zip(units, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        c = chance[turn % len(chance)]
        turn += 1
        step = up if c * (up + down) < down else -down
        for i, x in zip(units, u, strict=True):
            p[i] += step * x
            if p[i] < tiny or p[i] > 1 - tiny:
                p[i] = float(round(p[i]))

    def undecided() -> list[int]:
        return [i for i in hand if 0 < p[i] < 1]

    for i in live:
        hand.append(i)
        while len(hand) >= 3:
            a, b, c = hand
            u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
            move(hand, u if any(u) else [1.0, -1.0, 0.0])
            hand = undecided()
    while len(hand) == 2 and size[hand[0]] == size[hand[1]]:
        move(hand, [1.0, -1.0])
        hand = undecided()
    return np.array(p)


def landing(size: np.ndarray, p: np.ndarray, chance: np.ndarray, words: float) -> np.ndarray:
    """Turns (0 or 1) for a few hundred documents whose sizes come near words; the last few are tried in all ways."""
    z, left, end = np.zeros(len(p)), float(size.sum()), len(p) - LAST
    for i in range(max(0, end)):
        z[i] = 1.0 if chance[i] * left < words else 0.0
        words -= z[i] * size[i]
        left -= size[i]
    tail = size[max(0, end) :]
    ways = np.array(list(product((0.0, 1.0), repeat=len(tail))))
    z[max(0, end) :] = ways[np.abs(ways @ tail - words).argmin()]
    return z


def settled(size: np.ndarray, z: np.ndarray, short: float) -> np.ndarray:
    """Turns (0 or 1) of which one or two at a time are changed while that brings their words nearer; short: the words they lack."""
    z, own = z.copy(), np.arange(len(z))
    for _ in range(8):
        adds = np.where(z > 0.5, -size, size)
        order = np.argsort(adds, kind="stable")
        adds = adds[order]
        ways = [(np.abs(short - adds), own)]  # a single change is a pair with itself
        near = np.searchsorted(adds, short - adds)
        for step in (-1, 0, 1):
            other = np.clip(near + step, 0, len(z) - 1)
            ways.append((np.where(other == own, np.inf, np.abs(short - adds - adds[other])), other))
        error, other = min(ways, key=lambda w: w[0].min())
        i = int(error.argmin())
        if not error[i] < abs(short):
            break
        change = sorted({i, int(other[i])})
        short -= float(adds[change].sum())
        z[order[change]] = 1 - z[order[change]]
    return z


def _level(docs: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "seed", "key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        mixed = pdf["seed"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        size, p, chance = pdf["size"].to_numpy(dtype=float), pdf["p"].to_numpy(dtype=float), (mixed >> np.uint64(11)) / 2.0**53
        open_ = np.flatnonzero((size > 0) & (p > 1e-9) & (p < 1 - 1e-9))
        kept = open_[len(open_) - min(RESERVE, len(open_) // 2) :] if pdf["block"].iloc[0] == 0 else open_[:0]
        fly = np.setdiff1d(np.arange(len(p)), kept)
        total = float((size * p).sum())
        p[fly] = flight(size[fly], p[fly], chance[fly])
        if pdf["blocks"].iloc[0] == 1:
            hand = fly[(p[fly] > 0) & (p[fly] < 1)]
            p[hand] = landing(size[hand], p[hand], chance[hand], float((size[hand] * p[hand]).sum()))
            p[kept] = landing(size[kept], p[kept], chance[kept], total - float((size[fly] * p[fly]).sum()))
            short = total - float((size * p).sum())
            if len(open_) and abs(short) > NEAR * pdf["target"].iloc[0]:
                p[open_] = settled(size[open_], p[open_], short)
        return pdf.assign(p=p)

    return docs.groupBy("source", "block").applyInPandas(run, SCHEMA)


def row_key(docs: DataFrame, text: str) -> Column:
    """A hash of the whole row, so that rows that differ in any column are different ones."""
    return F.xxhash64(text, F.to_json(F.struct(*[c for c in docs.columns if c != text])))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """key, doc_id, source, size, source_size, target, copies (how often the mix takes the document) and taken (words).

    key is row_key(docs). Ids that are no numbers become null.
    """
    key, text, doc_id = row_key(docs, text), F.col(text), F.col(doc_id)
    sized = docs.select(key.alias("key"), doc_id.cast("string").alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"))
    # the texts are read once; equal rows become units of a bounded number of them, with a seed each
    equal = sized.groupBy(*sized.columns).count().withColumn("unit", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / EQUAL))))
    units = equal.select(*sized.columns, F.least(F.lit(EQUAL), F.col("count") - F.col("unit") * EQUAL).cast("int").alias("equal"), F.xxhash64("key", "unit").alias("seed"))
    sized = stored(units, "sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("source_size"), F.count("*").alias("n"))
    sources = stored(targets(sources, weights, cap), "targets").withColumnRenamed("source", "of")
    most = sources.agg(F.max("n")).first()[0] or 0
    turns = F.col("ratio") * F.col("equal")
    whole = F.floor(turns).cast("int")
    level = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).select(
        "key", "seed", "equal", "doc_id", "source", "size", "source_size", "target", whole.alias("whole"), (turns - whole).alias("p"),
        F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"),
    )
    level = level.withColumn("block", F.pmod(F.xxhash64("seed"), F.col("blocks")))
    done, blocks = [], -(-most // BLOCK)
    while True:
        level = stored(_level(level), "flight")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(level.where(~undecided))
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN)
        level = level.where(undecided).withColumn("block", F.floor(F.col("block") / FAN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    turns, equal = F.col("whole") + F.round("p").cast("int"), F.col("equal")
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1), equal)))  # back to rows: the unit's turns, as evenly as whole numbers allow
    copies = F.floor(turns / equal).cast("int") + (F.col("i") <= turns % equal).cast("int")
    return out.select("key", F.col("doc_id").try_cast("long").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, **names) -> DataFrame:
    """The rows of docs as the mix takes them: some never, some repeatedly. Only rows that are equal in all columns stand for each other."""
    turns = mix(docs, **names).groupBy("key").agg(F.sum("copies").alias("turns")).where("turns > 0")
    key, taken = "_mix_key", "_mix_turns"
    turns = turns.select(F.col("key").alias(key), F.col("turns").alias(taken))
    rows = docs.withColumn(key, row_key(docs, names.get("text", "text"))).dropDuplicates([key]).join(turns, key)
    return rows.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(taken).cast("int")))).select(*docs.columns)
