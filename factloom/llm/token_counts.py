"""Token counts by rank-synchronous array merging.

A batch's new pre-tokens are held as one ragged numpy array of symbol ids. In each round every pre-token finds the
lowest rank among its neighbouring pairs and merges all places of that pair at once; pre-tokens without a ranked pair
leave the array, and the symbols that survive are the tokens. Merging all places at once equals merging them one by one
when each merge makes a symbol that no other merge makes (a pair with the new symbol then always ranks later); the
constructor checks this. Counts of pre-tokens are kept in a bounded table of the worker, so that a frequent one is merged
once. A pre-token beyond LONG bytes, for which rounds would cost too much, is merged by a heap with the same result.

Special strings inside a text are cut out first and count as one token each, as the library does by default. Null texts
count as empty: 0 bytes, 0 tokens. Texts are taken whole. Repeated rows give repeated results; all columns are kept. No shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import merge_by_heap, pretokens

LONG, KEPT, CHARS = 2000, 400_000, 2_000_000
#: Fixed: the pattern that byte-level tokenizer files of this kind imply by "use_regex".
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer is needed")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [a + b for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("two merges make the same symbol; they can't be applied together")
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[m] for m in made], dtype=np.int64)
        self.byte = np.zeros(256, dtype=np.int64)
        for letter, b in byte_letters().items():
            self.byte[b] = vocab[letter]
        self.none = len(merges)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.find = pretokens(BYTE_LEVEL)
        self.known: dict[str, int] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], self.none)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols survive in each piece (of at least one byte)."""
        out = np.ones(len(pieces), dtype=np.int64)
        symbols = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        while len(symbols) > 1:
            inner = owner[:-1] == owner[1:]
            rank = np.where(inner, self.rank_of(symbols[:-1], symbols[1:]), self.none)
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, ~inner))
            lowest = np.minimum.reduceat(rank, first)
            seq = np.cumsum(np.append(True, ~inner)) - 1
            # leave the array: pieces without a ranked pair
            ended = lowest == self.none
            if ended.any():
                lengths = np.diff(np.append(first, len(symbols)))
                out[owner[first[ended]]] = lengths[ended]
                stay = ~ended[seq]
                symbols, owner, rank, seq = symbols[stay], owner[stay], rank[stay], seq[stay]
                if not len(symbols):
                    break
            hit = rank == lowest[seq]
            # in a run of overlapping hits every other one merges, from the left
            place = np.arange(1, len(hit) + 1)
            hit &= (place - np.maximum.accumulate(np.where(hit, 0, place))) % 2 == 1
            left = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[left] = self.made[rank[left]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[left + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            out[owner[0]] = 1
        return out

    def long(self, piece: bytes) -> int:
        def rank(a: int, b: int):
            r = int(self.rank_of(np.array([a]), np.array([b]))[0])
            return None if r == self.none else (r, int(self.made[r]))

        return len(merge_by_heap([int(x) for x in self.byte[np.frombuffer(piece, dtype=np.uint8)]], rank))

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
        pairs = [(w, w.encode("utf-8")) for w in sorted(new)]
        short = [(w, b) for w, b in pairs if len(b) <= LONG]
        if short:
            self.known.update(zip([w for w, _ in short], self.merged([b for _, b in short]).tolist(), strict=True))
        self.known.update({w: self.long(b) for w, b in pairs if len(b) > LONG})

    def counts(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            chunk, chars = [], 0
            while at < len(texts) and (not chunk or chars + len(texts[at]) <= CHARS):
                chunk.append(texts[at])
                chars += len(texts[at])
                at += 1
            extra = [0] * len(chunk)
            found = []
            for i, text in enumerate(chunk):
                if self.special and self.special.search(text):
                    parts = self.special.split(text)
                    extra[i] = len(parts) - 1
                    found.append([w for part in parts for w in self.find(part)])
                else:
                    found.append(self.find(text))
            needed = set().union(*found)
            if new := {w for w in needed if w not in self.known}:
                if len(self.known) + len(new) > KEPT:  # the table is cleared: all of this chunk is needed again
                    new = needed
                self.learn(new)
            get = self.known.__getitem__
            out += [n + sum(map(get, words)) for n, words in zip(extra, found, strict=True)]
        return out


@lru_cache(maxsize=2)
def _counter(tokenizer_json: str) -> Counter:
    return Counter(tokenizer_json)


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. The tokenizer's file is read on the driver and sent out once (a few MB)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(spec.value)
        for texts in batches:
            yield pd.Series(counter.counts(["" if t is None else t for t in texts]), dtype="int64")

    counted = docs.withColumn("n_tokens", n_tokens(F.col(text)))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
