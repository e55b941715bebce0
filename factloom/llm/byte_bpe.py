"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encodings of byte strings form a monoid: join(encode(a), encode(b)) = encode(a + b). A pre-token longer than LEAF bytes
is cut in halves, which are encoded recursively and joined. A join re-encodes a window of tokens around the border and
doubles it until both of the window's outer borders are stable. A border between two tokens is stable if the pair, as a byte string,
encodes to just these two tokens. A sequence all of whose borders are stable is the encoding of its bytes: the first
merge across a border would also happen in the pair alone, as merges inside each of the two tokens are the same there.
Pre-tokens are encoded separately, so above them a join is plain concatenation. Decoding concatenates the tokens' bytes
up the tree of halves.

Encodings of pre-tokens are kept in a bounded table of the worker. Null texts count as empty: no ids, no bytes. Texts are taken whole.
Repeated rows give repeated results; all columns are kept. No shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.bpe import merge_by_heap, pretokens

LEAF, KEPT, CHARS = 24, 300_000, 4_000_000


class Coder:
    def __init__(self, ranks_file: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.find = pretokens(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.stable = lru_cache(maxsize=100_000)(self._stable)

    def leaf(self, piece: bytes) -> list[int]:
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return [whole]
        if len(piece) > 4 * LEAF:
            def pair(a: bytes, b: bytes):
                return None if (r := rank.get(a + b)) is None else (r, a + b)

            return [rank[p] for p in merge_by_heap([piece[i : i + 1] for i in range(len(piece))], pair)]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 60)
        return [rank[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        return self.leaf(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        wide = 1
        while True:
            i, j = max(0, len(left) - wide), min(len(right), wide)
            window = self.leaf(b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            wide *= 2

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, text: str) -> list[int]:
        known, words = self.known, self.find(text)
        for word in {w for w in words if w not in known}:
            known[word] = tuple(self.tree(word.encode("utf-8")))
        ids = list(chain.from_iterable(map(known.__getitem__, words)))
        if len(known) > KEPT:
            known.clear()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _coder(ranks_file: bytes, pattern: str) -> Coder:
    return Coder(ranks_file, pattern)


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, fields: list[T.StructField], make) -> DataFrame:
    """docs with the columns that make(coder, batch) gives; a column of the same name is replaced."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: about a MB, whatever the corpus
    names = [f.name for f in fields]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            for part in _pieces(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(coder, part)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of bounded bytes (or one row)."""
    rows = max(1, int(batch.num_rows * CHARS / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", check: bool = True) -> DataFrame:
    """docs with ids (array of int), n_tokens and, if check, decoded: the bytes that the ids decode to."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("decoded", T.BinaryType())] * check

    def make(coder: Coder, batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [coder.encode(t or "") for t in batch.column(text).to_pylist()]
        n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        ids = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(n.sum())))
        )
        ids = ids.cast(pa.list_(pa.field("element", pa.int32(), nullable=False)))
        return [ids, pa.array(n), *([pa.array([coder.decode(r) for r in rows], type=pa.binary())] if check else [])]

    return _mapped(docs, ranks_path, pattern, fields, make)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the bytes of its ids (null ids give none)."""

    def make(coder: Coder, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([coder.decode(r or []) for r in batch.column(ids).to_pylist()], type=pa.binary())]

    return _mapped(encoded, ranks_path, r"(?s).+", [T.StructField("decoded", T.BinaryType())], make)
