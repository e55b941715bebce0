"""Near duplicates by exact Jaccard similarity of word shingles: a parity-sketch join.

A document's set holds its distinct k-word shingles. Each shingle's hash picks one of P parts and one bit of a very wide bit sketch
of that part; a bit is the parity (XOR) of the shingles that picked it. A shingle that only one of two documents has changes
one bit, so the Hamming distance of two sketches is at most the symmetric difference of the sets, and so is the number of
parts that differ. Similarity s means a symmetric difference of at most d = (1 - s) / (1 + s) * (n1 + n2), so with more than d
filled parts some filled part agrees (pigeonhole). P depends on the larger document's size band; a document signs the parts of its own band,
and of the next one if a partner in reach may lie there. A part's signature is the XOR of its shingles' 64-bit hashes, which stands
for the part's wide sketch.

Shingles that very many documents share (a repeated line or passage) would bring unlike documents together, so a document first signs
parts of its other shingles alone. Their difference is no larger, so a document with more than d filled parts of them meets every
partner there. A document with fewer signs, besides, the parts of all its shingles, and if more than d of these are not filled either,
the empty ones too. Both partners lack them or one has them: either way some signature is shared. That holds for any list of frequent
shingles, as long as it is one list for all documents; it is taken from one text in SAMPLE, with less than LISTED entries, and only tells how much work there is.

1. Each partition signs its distinct texts. Documents that share a signature are candidates; signatures that only one text has are
   dropped. A signature that more than a thousandth of the sampled texts have is dealt to several buckets, by the text's hash.
2. In each bucket the text with the most shared signatures leads (and the first of the leaders of one signature's buckets leads these); all
   are compared with it: by size and parity sketch, which rules out most chance meetings, then by their texts, exactly. Sketches have
   one to two bits for each shingle (256 bits at least), or they would say nothing of long texts; of two widths the larger is folded by
   XOR. A group of copies, however large, needs as many comparisons as it has texts, not pairs.
3. For signatures that still hold texts of several components, texts of different components are compared: their sketches first,
   in blocks of bounded size, and what passes by its texts. Texts of a signature's largest component meet the others only, not each
   other. Blocks with very many such pairs first give each text's nearest only, and whatever is still unconnected after that.
4. If links are to be counted, all texts of a class are compared with each other, exactly, in square blocks of bounded size (every link lies
   within a class). Only sums for each text leave a block, no pairs: a document's links are its equal copies and the documents
   of all texts that are similar enough.
5. Components of the verified links are the classes. Rows are joined to them, and to their names, with the few most frequent keys
   broadcast, so that no large class is dealt to one task; pairs are joined to a frequent leader's text in parts.

Texts, and equal texts as one, are known by a 64-bit hash. With N different texts it mistakes two for one with odds of about N^2 / 2^65.

Null texts and texts without words have an empty set and link with nothing. A text with fewer than k words has one shingle, all of it.
Rows with null ids take part, but never give a class its name (a class is known by the least hash of its texts). Repeated rows are copies. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.cluster import small_batches
from factloom.llm.common import stored
from factloom.llm.graph import components

RATIO = 1.5  # of size bands
SIDE = 1024  # of the square blocks
BLOCK = 4_000_000  # characters in a side of the blocks in which links are counted
BITS = 256  # the least width of a sketch
KEPT = 100_000  # words whose hashes a task keeps: about 25 MB
LEAST = 16  # of its signatures a text brings along, so that a pair is told at the least one it shares
FEW = 8  # pairs for each text of a block that are compared at once
SAMPLE, LISTED = 16, 1 << 20  # one text of so many is looked at for frequent shingles and signatures; bound of the shingles listed


def shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """Words are runs without ASCII white space; only A-Z is lower-cased: what bytes.lower and bytes.split do."""
    words = text.encode("utf-8").lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class Hasher:
    """64-bit hashes of a text's distinct shingles."""

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = text.encode("utf-8").lower().split(), self.known
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(known) > KEPT:
            known.clear()
        if not len(h):
            return h
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


class Scheme:
    """Size bands and their numbers of parts for a similarity of at least s."""

    def __init__(self, s: float):
        self.s = s
        self.rate = (1 - s) / (1 + s)

    def most(self, n1: int, n2: int) -> int:
        return floor(self.rate * (n1 + n2) + 1e-9)

    def band(self, n: int) -> int:
        return floor(log(n) / log(RATIO) + 1e-12)

    def top(self, band: int) -> int:
        return max(1, ceil(RATIO ** (band + 1)) - 1)

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a band, and the difference it allows."""
        d = self.most(self.top(band), self.top(band))
        if d == 0:
            return 1, 0
        n = max(1.0, RATIO**band)
        p = d + 1
        while p < 2 * d + 8 and p * (1 - np.exp(-n / p)) - 2 * sqrt(p) * np.exp(-n / p / 2) < d + 1:
            p += max(1, d // 50)
        return p, d

    def bands(self, n: int) -> list[int]:
        own, last = self.band(n), self.band(floor(n / self.s + 1e-9))
        return list(range(own, last + 1))


def _parted(sized: list[tuple[int, int, np.ndarray]], plan: dict[int, tuple[int, int]], kind: int, empty: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which entry, signature) of the filled parts (and, where these are too few, if empty, of the others) of (document, band, hashes), and how many are filled."""
    base, starts, keys = 0, [], []
    for _, band, h in sized:
        p, _ = plan[band]
        keys.append((h >> np.uint64(20)) % np.uint64(p) + np.uint64(base))
        starts.append(base)
        base += p
    if not sized:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key, value = np.concatenate(keys).astype(np.int64), np.concatenate([h for _, _, h in sized])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    word, slot = np.bitwise_xor.reduceat(value, first) if len(key) else value, key[first]
    starts = np.array(starts)
    at = np.searchsorted(starts, slot, side="right") - 1
    filled = np.bincount(at, minlength=len(sized))
    if empty:
        slots, ats = [slot], [at]
        for j in [j for j, (_, band, _) in enumerate(sized) if filled[j] <= plan[band][1]]:
            more = np.setdiff1d(np.arange(starts[j], starts[j] + plan[sized[j][1]][0]), slot[at == j])
            slots.append(more)
            ats.append(np.full(len(more), j))
        slot, at = np.concatenate(slots), np.concatenate(ats)
        word = np.append(word, np.zeros(len(slot) - len(word), dtype=np.uint64))
    tag = (np.array([2 * band + kind for _, band, _ in sized], dtype=np.uint64)[at] << np.uint64(32)) + (slot - starts[at]).astype(np.uint64)
    mixed = (word ^ (tag * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0x94D049BB133111EB)
    return at, mixed ^ (mixed >> np.uint64(31)), filled


def sign(hashes: list[np.ndarray], scheme: Scheme, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which document, signature) for a batch of documents' shingle hashes; frequent: sorted hashes of shingles that many documents have."""
    whole = [(i, band, h) for i, h in enumerate(hashes) if len(h) for band in scheme.bands(len(h))]
    plan = {band: scheme.parts(band) for band in {b for _, b, _ in whole}}
    rare = [h[~_among(h, frequent)] for h in hashes]
    at, signature, filled = _parted([(i, band, rare[i]) for i, band, _ in whole], plan, 0, False)
    short = np.array([j for j, (_, band, _) in enumerate(whole) if filled[j] <= plan[band][1]], dtype=np.int64)
    more, signature_too, _ = _parted([whole[j] for j in short], plan, 1, True)
    entry = np.concatenate([at, short[more]])
    return np.array([i for i, _, _ in whole], dtype=np.int64)[entry], np.concatenate([signature, signature_too])


def _among(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h if len(listed) else np.zeros(len(h), dtype=bool)


def sketch(h: np.ndarray) -> bytes:
    """Parities of the hashes in at least as many bits as there are hashes; a power of two."""
    bits = max(BITS, 1 << len(h).bit_length())
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def narrowed(sketches: list[bytes], n_bytes: int) -> np.ndarray:
    """One row for each sketch, folded by XOR to a width that divides its own: the sketch that this width would have given."""
    widths = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    out = np.empty((len(sketches), n_bytes // 8), dtype=np.uint64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches[i] for i in at), dtype=np.uint64).reshape(len(at), -1, n_bytes // 8), axis=1)
    return out


def distances(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Hamming distances of pairs of sketches, at the smaller width of each pair."""
    widths, out = np.array([min(len(x), len(y)) for x, y in zip(one, two, strict=True)], dtype=np.int64), np.zeros(len(one), dtype=np.int64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        for part in np.array_split(at, 1 + len(at) * int(w) // 8_000_000):
            if len(part):
                a, b = (narrowed([x[i] for i in part], int(w)) for x in (one, two))
                out[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Nodes and shingle hashes of the distinct texts of a partition, about 150,000 hashes at a time."""
    hasher, seen = Hasher(k), set()
    nodes, hashes, total = [], [], 0
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
            if node in seen:
                continue
            seen.add(node)
            nodes.append(node)
            hashes.append(hasher(text.as_py()))
            total += len(hashes[-1])
            if total > 150_000:
                yield nodes, hashes
                nodes, hashes, total = [], [], 0
    if nodes:
        yield nodes, hashes


def _frequent(sample: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the sample's most frequent shingles, less than LISTED of them whatever the sample's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes in _each(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64))], names=["shingle"])

    counts = sample.select("node", "text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = stored(counts, "shingles")
    least = (counts.agg(F.sum("n")).first()[0] or 0) // LISTED
    often = counts.where(F.col("n") > F.lit(max(1, least))).select("shingle").toArrow()
    return np.sort(often.column("shingle").to_numpy().astype(np.int64).view(np.uint64))


def _signatures(docs: DataFrame, k: int, s: float, frequent: np.ndarray) -> DataFrame:
    """(signature, node) of the distinct texts of each partition."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # less than LISTED hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(s)
        for nodes, hashes in _each(batches, k):
            which, signature = sign(hashes, scheme, sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(np.array(nodes, dtype=np.int64)[which])], names=["signature", "node"])

    return docs.select("node", "text").mapInArrow(run, "signature long, node long")


def _hot(signed: DataFrame, texts: float) -> DataFrame:
    """(signature, cuts) of the signatures that more than a thousandth of a sample's texts have, a bounded list, and how many buckets each gets."""
    n, texts = F.col("n"), max(1.0, texts)
    cuts = F.least(F.ceil(n / texts * 4096), F.ceil(n * SAMPLE / 256)).cast("long")
    return signed.groupBy("signature").agg(F.count("*").alias("n")).where(n > max(16.0, texts / 1000)).select("signature", cuts.alias("cuts"))


def _sized(docs: DataFrame, k: int) -> DataFrame:
    """(node, doc_id, n_shingles, sketch) of each document; equal texts of a partition are counted once, and only the first has the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(k), {}
        for batch in batches:
            sizes, sketches = [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                made = None
                if node not in known:
                    h = hasher(text.as_py())
                    known[node] = len(h)
                    made = sketch(h) if len(h) else None
                sizes.append(known[node])
                sketches.append(made)
            columns = [batch.column("node"), batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(sketches, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "n_shingles", "sketch"])

    return docs.select("node", "doc_id", "text").mapInArrow(run, "node long, doc_id long, n_shingles long, sketch binary")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), once for each of the nodes (a stored table); copies within a partition are dropped before the shuffle."""
    wanted = docs.select("node", "text").join(nodes, "node", "left_semi")
    return _once_in_partitions(wanted, ["node"]).dropDuplicates(["node"])


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (a, b), stored and distinct, with the table's columns for a and for b.

    A node a with more than a thousandth of the pairs (fewer than a thousand are) is given to its pairs in parts.
    """
    columns = [c for c in table.columns if c != "node"]
    most = max(64.0, pairs.count() / 1000)
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("cuts")).where("cuts > 1")
    hot = F.broadcast(stored(counts, "hot"))  # fewer than a thousand rows, or of fewer than 64,000 pairs
    cuts = F.coalesce("cuts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), cuts).cast("int").alias("cut"))
    two = table.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    one = table.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    one = one.join(hot, "a", "left").withColumn("cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("cuts")
    return dealt.join(two, "b").join(one, ["a", "cut"])


def _verified(pairs: DataFrame, docs: DataFrame, k: int, s: float) -> DataFrame:
    """The pairs (a, b), stored and distinct, whose texts are similar enough."""
    num, den = round(s * 1000), 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], shingles(batch.column("text_a")[i].as_py(), k)
                right = shingles(batch.column("text_b")[i].as_py(), k)
                both = len(left & right)
                good.append(both > 0 and den * both >= num * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    texts = stored(_texts(docs, _nodes_of(pairs)), "texts")
    return _beside(pairs, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, sketches: DataFrame, s: float) -> DataFrame:
    """The pairs (a, b), stored and distinct, whose sizes and sketches allow the similarity; sketches are moved in place of texts."""
    scheme = Scheme(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            far = distances(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())
            good = (far <= np.floor(scheme.rate * (n + m) + 1e-9)) & (np.minimum(n, m) >= s * np.maximum(n, m) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    return _beside(pairs, sketches).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, parts: DataFrame, sketches: DataFrame, s: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of unlike components with a signature in common whose sketches allow the similarity.

    nearest: a block with more than FEW of them for each text gives only each text's closest, and its key in the column rest.
    A pair that has several signatures in common is told at the least of them: each text brings along its LEAST least ones, and where both
    list a smaller one, the pair is left to that.
    members: key (a signature), bucket (of it, bounded), node. Texts of a key's largest component and the others are cut into blocks of about
    SIDE texts; each pair of blocks is one group, but for pairs of blocks of the largest component.
    """
    scheme = Scheme(s)
    rows = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows, "members")
    sums = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"))
    main = F.when(F.col("all") > SIDE, F.col("main.n")).otherwise(F.lit(0))  # few texts are one block
    sums = sums.where("main.n < all").select("key", F.when(main > 0, F.col("main.component")).alias("main"), *[F.ceil(c / SIDE).cast("int").alias(n) for c, n in ((main, "x"), (F.col("all") - main, "y"))])
    mixed = stored(members.select("key", "bucket").distinct().join(sums, "key").drop("key"), "mixed")  # a row for each bucket, so that no key is hot in the next join
    rows = rows.join(mixed, "bucket")
    listed = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST).alias("least"))  # no more than the text has signatures
    rows = rows.join(sketches.join(listed, "node"), "node")
    x, y, largest = F.col("x"), F.col("y"), F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    rows = rows.withColumn("cut", F.when(largest, F.pmod(F.xxhash64("node"), x)).otherwise(x + F.pmod(F.xxhash64("node"), y)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(largest, x).otherwise(F.lit(0)), x + y - 1)))
    rows = rows.select("key", F.least("cut", "other").alias("one"), F.greatest("cut", "other").alias("two"), "cut", "node", "component", "n", "sketch", "least")

    def here(least: np.ndarray, one: np.ndarray, two: np.ndarray, key: int) -> np.ndarray:
        """Which of the pairs (one, two) list no smaller signature in common than key."""
        out = np.ones(len(one), dtype=bool)
        for at in range(0, len(one), 50_000):
            a, b = least[one[at : at + 50_000]][:, :, None], least[two[at : at + 50_000]][:, None, :]
            out[at : at + 50_000] = ~((a == b) & (a < key)).any(axis=(1, 2))
        return out

    def compare(group: pa.Table) -> tuple[set[tuple[int, int]], bool]:
        """The pairs, and whether more than these are possible."""
        node, comp, n, cut = (group.column(c).to_numpy() for c in ("node", "component", "n", "cut"))
        sketches = group.column("sketch").to_pylist()
        bits = narrowed(sketches, min(map(len, sketches)))  # a bucket holds sizes of neighbouring bands
        key = group.column("key")[0].as_py()
        least = np.array([x + [np.iinfo(np.int64).max] * (LEAST - len(x)) for x in group.column("least").to_pylist()], dtype=np.int64)
        left, right = np.flatnonzero(cut == group.column("one")[0].as_py()), np.flatnonzero(cut == group.column("two")[0].as_py())
        closest, every, count = set(), set(), 0
        step = max(1, 2_000_000 // max(1, len(right) * bits.shape[1]))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            far = np.bitwise_count(bits[i][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64)
            one, two = n[i][:, None], n[right][None, :]
            fits = (comp[i][:, None] != comp[right][None, :]) & (far <= np.floor(scheme.rate * (one + two) + 1e-9)) & (np.minimum(one, two) >= s * np.maximum(one, two) - 1e-9)
            x, y = np.nonzero(fits)
            told = here(least, i[x], right[y], key)
            x, y = x[told], y[told]
            count += len(x)
            if nearest and len(x):
                some = np.flatnonzero(fits.any(axis=1))
                best = np.where(fits[some], far[some], np.iinfo(np.int64).max).argmin(axis=1)
                told = here(least, i[some], right[best], key)
                closest |= set(zip(node[i[some[told]]].tolist(), node[right[best[told]]].tolist(), strict=True))
            if not nearest or count <= FEW * group.num_rows:
                every |= set(zip(node[i[x]].tolist(), node[right[y]].tolist(), strict=True))
        cut_off = nearest and count > FEW * group.num_rows
        pairs = {(min(p), max(p)) for p in (closest if cut_off else every)}
        return pairs or ({(int(node[0]), int(node[0]))} if cut_off else set()), cut_off  # a text beside itself only tells the key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        rest: pa.Table | None = None
        sent: set[tuple[int, int]] = set()

        def out(groups: list[pa.Table]) -> pa.RecordBatch:
            found = [(*p, g.column("key")[0].as_py() if cut_off else None) for g in groups for pairs, cut_off in [compare(g)] for p in pairs if cut_off or p not in sent]
            if len(sent) > 1_000_000:
                sent.clear()
            sent.update(f[:2] for f in found)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], type=pa.int64()) for i in range(3)], names=["a", "b", "rest"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            key = [rows.column(c).to_numpy() for c in ("key", "one", "two")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            groups = [rows.slice(x, y - x) for x, y in zip(np.append(0, ends[:-1]), ends, strict=True)] if len(ends) else []
            rest = rows.slice(int(ends[-1]) if len(ends) else 0)
            if groups:
                yield out(groups)
        if rest is not None:
            yield out([rest])

    group = ["key", "one", "two"]
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, rest long")


def similar(one: list[np.ndarray], two: list[np.ndarray], s: float) -> np.ndarray:
    """Whether each set of one and each of two are similar enough; sets are arrays of the numbers of their shingles."""
    num, den = round(s * 1000), 1000
    sizes = [np.array(list(map(len, x)), dtype=np.int64) for x in (one, two)]
    column = [np.concatenate(x) if len(x) else np.zeros(0, dtype=np.int64) for x in (one, two)]
    row = [np.repeat(np.arange(len(x)), n) for x, n in zip((one, two), sizes, strict=True)]
    common = np.intersect1d(*column)  # the others are in no intersection
    both = np.zeros((len(one), len(two)), dtype=np.int64)
    at = [np.minimum(np.searchsorted(common, c), max(0, len(common) - 1)) for c in column]
    hit = [common[a] == c if len(common) else np.zeros(len(c), dtype=bool) for a, c in zip(at, column, strict=True)]
    row, at = [r[h] for r, h in zip(row, hit, strict=True)], [a[h] for a, h in zip(at, hit, strict=True)]
    order = [np.argsort(a, kind="stable") for a in at]
    row, at = [r[o] for r, o in zip(row, order, strict=True)], [a[o] for a, o in zip(at, order, strict=True)]
    step = max(64, 2_000_000 // max(1, len(one), len(two)))
    for low in range(0, len(common), step):
        parts = []
        for r, a, x in zip(row, at, (one, two), strict=True):
            i, j = np.searchsorted(a, [low, low + step])
            m = np.zeros((len(x), min(step, len(common) - low)), dtype=np.float32)
            m[r[i:j], a[i:j] - low] = 1
            parts.append(m)
        both += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return (both > 0) & (den * both >= num * (sizes[0][:, None] + sizes[1][None, :] - both))


def _links(parts: DataFrame, docs: DataFrame, copies: DataFrame, k: int, s: float) -> DataFrame:
    """(node, linked): the number of documents whose texts are unlike but similar enough, for each text of a component."""
    members = parts.select("node", "component").unionByName(parts.select(F.col("component").alias("node"), "component")).distinct()
    members = stored(members, "members")
    texts = stored(_texts(docs, members.select("node")), "texts")
    members = stored(members.join(texts.select("node", F.length("text").alias("chars")), "node").join(copies, "node"), "members")
    cuts = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("chars") / BLOCK)).cast("int").alias("cuts"))
    rows = _spread(members, stored(cuts, "cuts"), "component")
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select("component", F.least("cut", "other").alias("one"), F.greatest("cut", "other").alias("two"), "cut", "node", "copies").join(texts, "node")
    group = ["component", "one", "two"]

    def counted(rows: pa.Table) -> tuple[list[int], list[int]]:
        node, copies, cut = (rows.column(c).to_numpy() for c in ("node", "copies", "cut"))
        numbers: dict[tuple[bytes, ...], int] = {}
        sets = [np.array([numbers.setdefault(x, len(numbers)) for x in shingles(t.as_py(), k)], dtype=np.int64) for t in rows.column("text")]
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        left, right = np.flatnonzero(cut == one), np.flatnonzero(cut == two)
        linked = similar([sets[i] for i in left], [sets[i] for i in right], s)
        if one == two:
            np.fill_diagonal(linked, False)
            return node[left].tolist(), (linked @ copies[right]).tolist()
        return node[left].tolist() + node[right].tolist(), (linked @ copies[right]).tolist() + (linked.T @ copies[left]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        rest: list[pa.Table] = []

        def out(groups: list[pa.Table]) -> pa.RecordBatch:
            found = [counted(g) for g in groups]
            return pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[i]], type=pa.int64()) for i in (0, 1)], names=["node", "linked"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            key = [rows.column(c).to_numpy() for c in group]
            ends = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in key], axis=0)) + 1).tolist()
            pieces = [rows.slice(x, y - x) for x, y in zip([0, *ends], [*ends, rows.num_rows], strict=True)]
            done = []
            if rest and any(rest[0].column(c)[0] != rows.column(c)[0] for c in group):
                done, rest = [pa.concat_tables(rest)], []
            rest.append(pieces[0])
            for piece in pieces[1:]:
                done, rest = [*done, pa.concat_tables(rest)], [piece]
            if done:
                yield out(done)
        if rest:
            yield out([pa.concat_tables(rest)])

    sums = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "node long, linked long")
    return sums.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(docs: DataFrame, k: int = 5, s: float = 0.8, doc_id: str = "doc_id", text: str = "text", links_too: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), node (hash of the text), class; with links_too also n_links.

    n_links: how many other documents are similar enough, copies of equal texts each counted.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("node", F.xxhash64("text"))
    sizes = stored(_sized(docs, k), "sizes")
    sketches = sizes.where("sketch IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketches, sizes = stored(sketches, "sketches"), sizes.drop("sketch")
    # step 1: buckets; the lowest bit tells those of a signature that is dealt to several
    sample = docs.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    frequent = _frequent(sample, k)
    hot = stored(_hot(_signatures(sample, k, s, frequent), sizes.count() / SAMPLE), "hot")
    key = F.col("signature").bitwiseAND(F.lit(-2))
    part = lambda i: F.xxhash64("signature", i).bitwiseOR(F.lit(1).cast("long"))
    bucket = F.when(F.col("cuts").isNull(), key).otherwise(part(F.pmod("node", "cuts")))
    in_bucket, several = W.partitionBy("bucket"), F.col("bucket").bitwiseAND(F.lit(1)) == 1
    shared = _signatures(docs, k, s, frequent).join(F.broadcast(hot), "signature", "left").select(bucket.alias("bucket"), "node")
    shared = shared.withColumn("low", F.min("node").over(in_bucket)).withColumn("high", F.max("node").over(in_bucket))
    shared = stored(shared.where((F.col("low") != F.col("high")) | several).select("bucket", "node").distinct(), "shared")
    buckets = hot.select("signature", key.alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("i"))
    buckets = stored(buckets.select(part(F.col("i")).alias("bucket"), "key"), "buckets")
    # step 2: everyone in a bucket against its leader
    nodes = shared.groupBy("node").agg(F.count("*").alias("degree"))
    order = F.struct(-F.col("degree"), F.col("node"))
    lead = F.first("node").over(in_bucket.orderBy(order))
    led = shared.join(nodes, "node").select("bucket", "node", lead.alias("a"), order.alias("order"))
    led = stored(led.join(buckets, "bucket", "left").withColumn("key", F.coalesce("key", "bucket")), "led")
    pairs = led.where("node <> a").select("a", F.col("node").alias("b"))
    heads = led.where((F.col("node") == F.col("a")) & several)
    first = heads.groupBy("key").agg(F.min_by("node", "order").alias("first"))
    pairs = pairs.unionByName(heads.join(first, "key").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    pairs = stored(_possible(stored(pairs.distinct(), "pairs"), sketches, s), "possible")
    links = stored(_verified(pairs, docs, k, s), "links")
    # step 3: what is still apart
    members = led.where((F.col("node") != F.col("a")) | several).select("key", "bucket", "node")
    of = F.coalesce("component", "node")
    for nearest in (True, False):
        found = stored(_across(members, components(links), sketches, s, nearest), "possible")
        more = stored(found.where("a <> b").select("a", "b").distinct(), "pairs")
        if found.isEmpty():
            break
        if not more.isEmpty():
            links = stored(links.unionByName(_verified(more, docs, k, s)), "links")
        members = members.join(found.select(F.col("rest").alias("key")).dropna().distinct(), "key", "left_semi")
    parts = components(links)
    if links_too:
        copies = sizes.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("copies"))
        copies = stored(copies, "copies")
        linked = stored(_links(parts, docs, copies, k, s), "linked")
        n_links = (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
        parts = stored(copies.join(linked, "node", "left").join(parts, "node", "left").select("node", "component", n_links), "parts")
    classed = _spread(sizes, parts, "node").withColumn("class", of).drop("component")
    classed = stored(classed, "classed")
    names = stored(classed.groupBy("class").agg(F.min("doc_id").alias("least")), "names")
    out = _spread(classed, names, "class")
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links_too else []
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "node", "class", *more)


def _spread(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows left-joined to table (one row for each key), where few keys may hold most of the rows.

    Keys with more than a thousandth of the rows, so fewer than a thousand, are joined by broadcast; the rest by an ordinary join.
    """
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows.count() / 1000).drop("_n")
    often = stored(often.join(table, key, "left"), "often")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(table, key, "left")
    return rows.join(F.broadcast(often), key).unionByName(rest)


def one_of_each(docs: DataFrame, k: int = 5, s: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the least by id (nulls last), text's hash and hash of the other columns. Texts without words all stay."""
    found = near_duplicates(docs, k, s, doc_id, text).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    first = stored(found.groupBy("class").agg(F.min(order).alias("first")).select("first._id", "first._node"), "first")
    columns = docs.columns
    others = [F.col(c) for c in columns if c != text]
    rows = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_node": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "_row": F.xxhash64(F.to_json(F.struct(*others)))})
    words = F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    key = ["_id", "_node", "_row"]
    least = rows.where(words).select(*key).groupBy("_id", "_node").agg(F.min("_row").alias("_row"))
    least = stored(least.join(_renamed(first), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_node") == F.col("_node2")), "left_semi"), "least")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_node") == F.col("_node2")) & (F.col("_row") == F.col("_row2"))
    kept = _once_in_partitions(rows.where(words), key).join(_renamed(least), same, "left_semi").dropDuplicates(key)
    return kept.select(*columns).unionByName(rows.where(~words).select(*columns))


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns])


def _once_in_partitions(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows without those whose key came before in the same partition, so that rows repeated very often are not dealt to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keep = []
            for i, x in enumerate(zip(*[batch.column(c).to_pylist() for c in key], strict=True)):
                if x not in seen:
                    seen.add(x)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)
