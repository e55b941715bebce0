"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit borders and put in the order suffix-first or prefix-first, between sentinels.

Each byte of the UTF-8 texts belongs to a class: byte within a character, character within a word, word start, space, line feed. A batch's bytes
form one wavelet matrix over the classes: a bit vector for each bit of the class, with counts by 64-bit word, each sorted stably by the bit above.
Counts of a class before a place (rank) cost a few look-ups, for all texts of the batch at once. Boundary counts are made of them: characters are all bytes
less those within characters, words are word starts, lines are line feeds and one more if the text ends without one. A cut after k units is found by
bisection on these ranks; the characters of prefix and middle are rank differences.

Where to cut and which form to give comes from the first four 32-bit numbers of sha256("seed:id"), so that reruns agree, wherever a row is computed.

Defined results: a null text is an empty one; empty texts, texts that hold a sentinel, and the share that rate leaves out stay plain. A null id counts
as an empty one. Repeated rows give equal results. An empty table gives an empty result. Other columns are kept; columns named as the results are replaced.
No shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSIDE, PLAIN, START, SPACE, LINE = range(5)
BITS = 3
CHARS = 4_000_000  # bytes of a batch that are handled at once (or one text)
SENTINELS = ("<P>", "<S>", "<M>")


def classes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each byte; first: the places where texts begin."""
    table = np.full(256, PLAIN, dtype=np.uint8)
    table[0x80:0xC0] = INSIDE
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[0x0A] = LINE
    out = table[data]
    after = np.ones(len(out), dtype=bool)
    after[1:] = out[:-1] >= SPACE
    after[first[first < len(out)]] = True
    out[after & (out == PLAIN)] = START
    return out


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.size, self.levels = len(symbols), []
        for shift in reversed(range(bits)):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are this one."""
        low, high = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            ones_low, ones_high = bits.ones(low), bits.ones(high)
            if symbol >> shift & 1:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low


def before(m: WaveletMatrix, unit: str, at: np.ndarray) -> np.ndarray:
    """How many units have a border at or before each place (for words and characters: begin before it; for lines: end)."""
    if unit == "char":
        return at - m.rank(INSIDE, at)
    return m.rank({"word": START, "line": LINE}[unit], at)


def units(m: WaveletMatrix, unit: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many units each text has."""
    n = before(m, unit, end) - before(m, unit, start)
    if unit == "line":
        last = np.maximum(end - 1, start)
        n = n + ((end > start) & (m.rank(LINE, end) == m.rank(LINE, last)))
    return n


def cuts(m: WaveletMatrix, unit: str, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the first k units of each text end: lines end after their line feed, words and characters where the next one begins."""
    base, n = before(m, unit, start), units(m, unit, start, end)
    low, high = start.copy(), end.copy()  # the smallest place with as many units before it as wanted
    wanted = base + k + (0 if unit == "line" else 1)
    while (low < high).any():
        middle = (low + high) >> 1
        enough = before(m, unit, middle) >= wanted
        low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
    place = low - (0 if unit == "line" else 1)  # before the byte that begins unit k + 1
    return np.where(k >= n, end, np.where(k <= 0, start, place))


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels between which texts without them can be told apart: different, not empty, none beginning as another ends."""
    borders = [a for a in sentinels for b in sentinels for i in range(1, len(a) + 1) if a[:i] == b[len(b) - i :] and (a != b or i < len(a))]
    if not all(sentinels) or len(set(sentinels)) < 3 or borders or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("sentinels must differ, must not be empty and must not overlap")
    return sentinels


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, sentinels=SENTINELS) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    rate: percent of texts that are cut; spm: percent of these that are given suffix first. unit: line, word or char.
    """
    p, s, m = (x.encode() for x in checked(tuple(sentinels)))
    if unit not in ("line", "word", "char"):
        raise ValueError("unit is line, word or char")
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    names = [f.name for f in fields]
    docs = docs.drop(*[c for c in names if c not in (doc_id, text)])
    schema = T.StructType([*docs.schema.fields, *fields])

    def made(ids: list, texts: list[bytes]) -> list[pa.Array]:
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        end = np.cumsum(size)
        start = end - size
        drawn = np.array([draws(seed, i) for i in ids], dtype=np.int64).reshape(len(texts), 4)
        matrix = WaveletMatrix(classes(np.frombuffer(b"".join(texts), dtype=np.uint8), start))
        n = units(matrix, unit, start, end)
        ends = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
        one, two = (cuts(matrix, unit, start, end, ends[:, i]) for i in (0, 1))
        at = [before(matrix, "char", x) for x in (start, one, two)]
        plain = np.array([not t or any(x in t for x in (p, s, m)) for t in texts], dtype=bool) | (drawn[:, 2] % 100 >= rate)
        form, output = [], []
        for t, cut, a, b, first in zip(texts, ~plain, (one - start).tolist(), (two - start).tolist(), drawn[:, 3] % 100 < spm, strict=True):
            form.append(("spm" if first else "psm") if cut else "plain")
            if cut:
                t = b"".join((s, t[b:], p, t[:a], m, t[a:b]) if first else (p, t[:a], s, t[b:], m, t[a:b]))
            output.append(t.decode("utf-8", "replace"))
        chars = [pa.array(x, mask=plain) for x in (at[1] - at[0], at[2] - at[1])]
        return [pa.array(n), pa.array(form), *chars, pa.array(output, type=pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, int(batch.num_rows * CHARS / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                texts = part.column(text).cast(pa.binary()).to_pylist()
                new = made(part.column(doc_id).to_pylist(), [t or b"" for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = checked(tuple(sentinels))

    def parts(first: str, second: str) -> Column:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        return F.split(body, f"\\Q{second}\\E|\\Q{m}\\E", 3)

    psm, spm = parts(p, s), parts(s, p)
    of = lambda x, *order: F.concat(*[F.get(x, F.lit(i)) for i in order])
    return F.when(form == "psm", of(psm, 0, 2, 1)).when(form == "spm", of(spm, 1, 2, 0)).otherwise(output)
