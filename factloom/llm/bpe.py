"""What the two tokenizer operators share: pre-tokens, and merges of one long piece by a heap."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import regex


def pretokens(pattern: str) -> Callable[[str], list[str]]:
    r"""findall for the pattern; \s is spelt out as the Unicode property that the tokenizer libraries take it for."""
    spelt = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"[^\p{White_Space}]")
    return regex.compile(spelt).findall


def merge_by_heap(parts: list, rank: Callable) -> list:
    """Merges the lowest-ranked neighbouring pair, the leftmost of equals, until none has a rank: O(n log n).

    rank(a, b) gives (rank, merged) or None.
    """
    n = len(parts)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := rank(parts[i], parts[j])) is not None:
            heap.append((found[0], i, j, parts[i], parts[j], found[1])) if building else heapq.heappush(heap, (found[0], i, j, parts[i], parts[j], found[1]))

    building = True
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    building = False
    while heap:
        _, i, j, a, b, merged = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and parts[i] == a and parts[j] == b):
            continue
        parts[i], alive[j] = merged, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p, here in zip(parts, alive, strict=True) if here]
