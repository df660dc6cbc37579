"""Spectral and combinatorial measures of many small graphs, one group of edges at a time.

``per_graph`` sorts edges by their graph and hands each graph to a numpy function, so only one graph is held.
A graph of more than ``most`` nodes is no small graph: it gives one row of nulls beside its name, and the others go on.  Nodes are numbered in the order
of their names, so that results don't depend on the order of rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.tables import share_package

#: Nodes of a graph whose matrix a task holds (200 MB of numbers).
MOST_NODES = 5_000


def per_graph(edges: DataFrame, graph: str, function: Callable[[np.ndarray, list[str]], list[tuple]], out: str, most: int = MOST_NODES) -> DataFrame:
    """Rows of ``function(adjacency, names)`` for each graph, after its name; edges are (graph, src, dst) without direction."""
    share_package(edges.sparkSession)
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    types = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
    kinds = [types[c.strip().split(" ")[1]] for c in out.split(",")]

    def graph_rows(name, pairs):
        nodes = sorted({x for p in pairs for x in p})
        if len(nodes) > most:
            return [(name, *[None] * len(names))]
        at = {x: i for i, x in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        for u, v in pairs:
            if u != v:
                a[at[u], at[v]] = a[at[v], at[u]] = 1.0
        return [(name, *row) for row in function(a, nodes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pairs, rows = None, [], []

        def flush():
            columns = list(zip(*rows)) if rows else [[]] * (len(names) + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *kinds])], names=[graph, *names])

        for batch in batches:
            for g, u, v in zip(*(c.to_pylist() for c in batch.columns)):
                if g != current:
                    if pairs:
                        rows += graph_rows(current, pairs)
                    current, pairs = g, []
                pairs.append((u, v))
            if len(rows) > 10_000:
                yield flush()
                rows = []
        if pairs:
            rows += graph_rows(current, pairs)
        yield flush()

    placed = edges.select(F.col(graph).cast("string").alias(graph), F.col("src").cast("string"), F.col("dst").cast("string")).where("src IS NOT NULL AND dst IS NOT NULL")
    return placed.repartition(graph).sortWithinPartitions(graph).mapInArrow(run, f"{graph} string, {out}")


def laplacian(a: np.ndarray, normed: bool = True) -> np.ndarray:
    d = a.sum(1)
    if not normed:
        return np.diag(d) - a
    root = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0.0)
    return np.diag((d > 0).astype(float)) - root[:, None] * a * root[None, :]


def spectrum(a: np.ndarray, normed: bool = True) -> np.ndarray:
    return np.linalg.eigvalsh(laplacian(a, normed))


def spectral_measures(a: np.ndarray, _names: list[str], times: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0)) -> list[tuple]:
    """Nodes, spectral entropy, gap, energy and dimension."""
    values = spectrum(a)
    total = values.sum()
    p = values[values > 1e-12] / total if total > 0 else np.array([1.0])
    traces = [np.exp(-t * values).sum() for t in times]
    slope = np.polyfit(np.log(times), np.log(traces), 1)[0]
    n, m = len(a), a.sum() / 2
    energy = np.abs(values - 2 * m / n).sum()
    return [(n, float(-(p * np.log(p)).sum()), float(values[1] - values[0]) if n > 1 else 0.0, float(energy), float(-2 * slope), float(values[-1]))]


def chebyshev_heat(lap: np.ndarray, t: float, order: int = 30) -> np.ndarray:
    """exp(-t L) for a Laplacian with eigenvalues in [0, 2], by Chebyshev polynomials."""
    k = order + 1
    theta = (np.arange(k) + 0.5) * math.pi / k
    f = np.exp(-t * (np.cos(theta) + 1))
    c = [2 / k * (f * np.cos(j * theta)).sum() for j in range(k)]
    x = lap - np.eye(len(lap))
    before, now = np.eye(len(lap)), x
    out = c[0] / 2 * before + c[1] * now
    for j in range(2, k):
        before, now = now, 2 * x @ now - before
        out += c[j] * now
    return out


def graphwave(a: np.ndarray, names: list[str], scales: tuple[float, ...] = (0.5, 1.0), points: int = 4) -> list[tuple]:
    """(``node``, ``vec``): real and imaginary parts of the characteristic function of each node's heat wavelet."""
    lap = laplacian(a)
    grid = np.linspace(0, 2 * math.pi, points)
    parts = []
    for s in scales:
        heat = chebyshev_heat(lap, s)
        phase = np.exp(1j * heat[:, :, None] * grid).mean(1)
        parts += [phase.real, phase.imag]
    vectors = np.concatenate(parts, axis=1)
    return [(n, [float(x) for x in v]) for n, v in zip(names, vectors)]


def distances(a: np.ndarray) -> np.ndarray:
    """Steps between nodes; infinite between components."""
    n = len(a)
    out = np.full((n, n), np.inf)
    near = [np.flatnonzero(row) for row in a]
    for s in range(n):
        out[s, s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if out[s, v] == np.inf:
                    out[s, v] = out[s, u] + 1
                    queue.append(v)
    return out


def box_cover(d: np.ndarray, radius: int) -> list[list[int]]:
    """Greedy balls: the first node not yet covered, with all uncovered within ``radius``."""
    free = np.ones(len(d), dtype=bool)
    boxes = []
    while free.any():
        seed = int(np.flatnonzero(free)[0])
        inside = np.flatnonzero(free & (d[seed] <= radius))
        free[inside] = False
        boxes.append([int(i) for i in inside])
    return boxes


def overlapping_balls(a: np.ndarray, names: list[str], radius: int = 1) -> list[tuple]:
    """(``ball``, ``node``): greedy balls around the first node not yet covered, with all within ``radius``, covered before or not."""
    d = distances(a)
    free = np.ones(len(d), dtype=bool)
    out = []
    while free.any():
        seed = int(np.flatnonzero(free)[0])
        inside = np.flatnonzero(d[seed] <= radius)
        free[inside] = False
        out += [(names[seed], names[i]) for i in inside]
    return out


def box_dimension(a: np.ndarray, _names: list[str], radii: tuple[int, ...] = (1, 2, 3)) -> list[tuple]:
    """Boxes at each radius and the slope of their logarithms; 0 where it can't be fitted."""
    d = distances(a)
    counts = [len(box_cover(d, r)) for r in radii]
    slope = np.polyfit(np.log(radii), np.log(counts), 1)[0] if len(radii) > 1 else 0.0
    return [(*counts, float(-slope))]


def contracted(a: np.ndarray, names: list[str], radius: int = 1) -> list[tuple]:
    """(``node``, ``box``): the graph's boxes, each named after its first node."""
    boxes = box_cover(distances(a), radius)
    return [(names[i], names[box[0]]) for box in boxes for i in box]


def persistence(a: np.ndarray, _names: list[str]) -> list[tuple]:
    """(``dim``, ``birth``, ``death``) by Kruskal over edges weighted by their ends' degrees: tree edges end components, others begin loops."""
    n, deg = len(a), a.sum(1)
    edges = sorted((float(max(deg[u], deg[v])), u, v) for u in range(n) for v in range(u + 1, n) if a[u, v])
    top = edges[-1][0] if edges else 0.0
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for w, u, v in edges:
        p, q = root(u), root(v)
        if p != q:
            parent[p] = q
            out.append((0, 0.0, w))
        else:
            out.append((1, w, top))
    return out


def sinkhorn(one: np.ndarray, other: np.ndarray, eps: float = 0.1, rounds: int = 50) -> float:
    """Entropic transport between diagrams with the L-infinity cost; 0 if either is empty."""
    if not len(one) or not len(other):
        return 0.0
    cost = np.abs(one[:, None, :] - other[None, :, :]).max(2)
    k = np.exp(-cost / eps) + 1e-300
    p, q = np.full(len(one), 1 / len(one)), np.full(len(other), 1 / len(other))
    v = np.ones(len(other))
    for _ in range(rounds):
        u = p / (k @ v)
        v = q / (k.T @ u)
    return float((u[:, None] * k * v[None, :] * cost).sum())


def betweenness(a: np.ndarray, names: list[str]) -> list[tuple]:
    """(``node``, ``value``): shares of shortest paths through each node, over the pairs of others."""
    n = len(a)
    near = [np.flatnonzero(row) for row in a]
    score = np.zeros(n)
    for s in range(n):
        order, before, paths, depth = [], [[] for _ in range(n)], np.zeros(n), np.full(n, -1)
        paths[s], depth[s] = 1, 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in near[u]:
                if depth[v] < 0:
                    depth[v] = depth[u] + 1
                    queue.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
                    before[v].append(u)
        share = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                score[v] += share[v]
    pairs = (n - 1) * (n - 2)
    return [(x, float(v / pairs) if pairs else 0.0) for x, v in zip(names, score)]


def orbits(a: np.ndarray, names: list[str]) -> list[tuple]:
    """(``node``, ``orbit``): classes that colour refinement can't tell apart, named after their first node."""
    n = len(a)
    near = [np.flatnonzero(row) for row in a]
    colour = [0] * n
    for _ in range(n):
        keys = [(colour[i], tuple(sorted(colour[j] for j in near[i]))) for i in range(n)]
        ranks = {k: r for r, k in enumerate(sorted(set(keys)))}
        new = [ranks[k] for k in keys]
        if len(set(new)) == len(set(colour)):
            break
        colour = new
    first: dict[int, str] = {}
    for i in range(n):
        first.setdefault(colour[i], names[i])
    return [(names[i], first[colour[i]]) for i in range(n)]


def fourier(a: np.ndarray, _names: list[str]) -> list[tuple]:
    """(``k``, ``energy``): squared coefficients of the degrees over the eigenvalues, which signs and orders of vectors don't change."""
    values, vectors = np.linalg.eigh(laplacian(a))
    coefficients = vectors.T @ a.sum(1)
    groups: dict[float, float] = {}
    for v, c in zip(values, coefficients):
        groups[round(float(v), 6)] = groups.get(round(float(v), 6), 0.0) + float(c * c)
    return [(k, e) for k, e in enumerate(groups.values())]
