"""Independent answers in plain Python for small graphs (lists of (src, dst[, weight])), and the two-precision run.

They share no code with the engine, so they may judge it. Everything here holds the graph on the driver: for fixtures only.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np


def smallest_labels(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """Component label of each vertex by breadth-first search from roots in rising order, so a label is its component's smallest id."""
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    label: list[int] = [-1] * n
    for root in range(n):
        wave = [root] if label[root] < 0 else []
        while wave:
            for v in wave:
                label[v] = root
            wave = sorted({w for v in wave for w in near[v] if label[w] < 0})
    return label


def dijkstra(n: int, edges: list[tuple[int, int, int]], source: int) -> list[int | None]:
    out = defaultdict(list)
    for a, b, w in edges:
        out[a].append((b, w))
    found: list[int | None] = [None] * n
    queue = [(0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if found[v] is None:
            found[v] = d
            for w, cost in out[v]:
                if found[w] is None:
                    heapq.heappush(queue, (d + cost, w))
    return found


def relaxation_rounds(n: int, edges: list[tuple[int, int, int]], source: int, most: int = 256) -> int:
    """Rounds of relaxing all edges at once until the distances are Dijkstra's; raises beyond `most`."""
    want, now = dijkstra(n, edges, source), [0 if v == source else None for v in range(n)]
    for k in range(most + 1):
        if now == want:
            return k
        after = list(now)
        for a, b, w in edges:
            if now[a] is not None and (after[b] is None or now[a] + w < after[b]):
                after[b] = now[a] + w
        now = after
    raise ValueError(f"more than {most} rounds")


def pagerank(n: int, edges: list[tuple[int, int]], damping: float = 0.85, epsilon: float = 1e-6, single: bool = False) -> list[float]:
    """Ranks to an L1 change of epsilon; `single`: every product and sum is rounded to float32, destinations add their sources in order."""
    kind = np.float32 if single else np.float64
    edges = sorted(edges)
    degree = np.bincount([a for a, _ in edges], minlength=n)
    rank = np.full(n, 1 / n, kind)
    while True:
        share = (kind(damping) * (rank / np.maximum(degree, 1).astype(kind)).astype(kind)).astype(kind)
        lost = kind(0)
        for v in np.flatnonzero(degree == 0):
            lost = kind(lost + rank[v])
        after = np.full(n, kind(kind((1 - damping) / n) + kind(kind(damping) * lost) / kind(n)), kind)
        got = np.zeros(n, kind)
        for a, b in edges:
            got[b] = kind(got[b] + share[a])
        after = (after + got).astype(kind)
        change = float(np.abs(after.astype(np.float64) - rank).sum())
        rank = after
        if change <= max(epsilon, 1e-5 if single else 0.0):
            return [float(x) for x in rank]


@dataclass
class Dual:
    exact: bool
    l1: float
    largest: float
    within: bool


def compare(one: list, other: list, epsilon: float = 1e-6, single: bool = True, infinity: int | None = None) -> Dual:
    """How two answers differ: exact if equal (an infinite distance is None, or `infinity` in a machine word), and whether within tolerance.

    The tolerance of a vertex is the larger of eight epsilon and 2e-5 in single precision (1e-12 in double).
    """
    plain = lambda x: None if x is None or x == infinity else x
    gaps = [0.0 if plain(a) == plain(b) else float("inf") if plain(a) is None or plain(b) is None else abs(a - b) for a, b in zip(one, other, strict=True)]
    tolerance = max(8 * epsilon, 2e-5 if single else 1e-12)
    l1, largest = sum(gaps), max(gaps, default=0.0)
    return Dual(not any(gaps), l1, largest, largest <= tolerance and l1 <= tolerance * len(gaps))
