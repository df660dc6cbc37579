"""Distances of diagrams, covers, symmetries, views and random graphs: numpy functions over what one task or the driver holds.

Inputs are small by nature: one diagram, one graph of a group, or matrices of as many rows as vectors have numbers.
"""

from __future__ import annotations

import numpy as np

from lodestrata.operators.numeric import box_cover, chebyshev_heat, distances, laplacian, spectrum


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row the column of the cheapest perfect assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    row_price, column_price = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            done[at] = True
            i = owner[at]
            reduced = cost[i - 1] - row_price[i] - column_price[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], at
            following = 1 + int(np.argmin(np.where(done[1:], np.inf, least[1:])))
            step = least[following]
            row_price[owner[done]] += step
            column_price[done] -= step
            least[~done] -= step
            at = following
            if not owner[at]:
                break
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    out = np.empty(n, dtype=int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def _with_diagonal(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """L-infinity costs of matching the points of two diagrams with each other or with the diagonal."""
    n, m = len(one), len(other)
    cost = np.zeros((n + m, n + m))
    if n and m:
        cost[:n, :m] = np.abs(one[:, None, :] - other[None, :, :]).max(2)
    cost[:n, m:] = ((one[:, 1] - one[:, 0]) / 2)[:, None] if n else 0
    cost[n:, :m] = ((other[:, 1] - other[:, 0]) / 2)[None, :] if m else 0
    return cost


def wasserstein_distance(one: np.ndarray, other: np.ndarray, power: float = 1.0) -> float:
    """Between two diagrams (birth, death), points matched with each other or the diagonal."""
    cost = _with_diagonal(one, other) ** power
    return float(cost[np.arange(len(cost)), assignment(cost)].sum() ** (1 / power)) if len(cost) else 0.0


def bottleneck_distance(one: np.ndarray, other: np.ndarray) -> float:
    """The least greatest cost of a matching: the least bound under which all points can be matched, by bisection over the costs."""
    cost = _with_diagonal(one, other)
    if not len(cost):
        return 0.0
    values = np.unique(cost)

    def matches(bound: float) -> bool:
        partner = np.full(len(cost), -1)

        def place(row: int, seen: set[int]) -> bool:
            for column in np.flatnonzero(cost[row] <= bound):
                if column not in seen:
                    seen.add(column)
                    if partner[column] < 0 or place(partner[column], seen):
                        partner[column] = row
                        return True
            return False

        return all(place(row, set()) for row in range(len(cost)))

    low, high = 0, len(values) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if matches(values[middle]) else (middle + 1, high)
    return float(values[low])


def ball_cover(points: np.ndarray, radius: float) -> int:
    """Balls that a greedy cover takes: the first point left, with all within the radius."""
    free = np.arange(len(points))
    balls = 0
    while len(free):
        free = free[np.linalg.norm(points[free] - points[free[0]], axis=1) > radius]
        balls += 1
    return balls


def point_dimension(points: np.ndarray, radii: list[float]) -> float:
    """Slope of the logarithms of ball counts against those of the radii's inverses; 0 with fewer than two radii."""
    if len(radii) < 2 or not len(points):
        return 0.0
    return float(np.polyfit(-np.log(radii), np.log([ball_cover(points, r) for r in radii]), 1)[0])


def colour_boxes(a: np.ndarray, radius: int) -> int:
    """Boxes by greedy colouring: nodes further apart than the radius may not share one."""
    far = distances(a) > radius
    colour = np.full(len(a), -1)
    for i in range(len(a)):
        taken = set(colour[far[i] & (colour >= 0)])
        colour[i] = next(c for c in range(len(a)) if c not in taken)
    return int(colour.max()) + 1 if len(a) else 0


def spectral_density(a: np.ndarray, bins: int, normed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of the Laplacian's eigenvalues, as a density, and its edges."""
    values = spectrum(a, normed)
    return np.histogram(values, bins=bins, range=(0.0, 2.0 if normed else max(1e-12, float(values.max()))), density=True)


def fourier_of(a: np.ndarray, signal: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(laplacian(a))[1].T @ signal


def inverse_fourier(a: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(laplacian(a))[1] @ coefficients


def signal_back(a: np.ndarray, names: list[str]) -> list[tuple]:
    """(``node``, ``value``): the degrees, there and back through the transform."""
    return [(n, float(v)) for n, v in zip(names, inverse_fourier(a, fourier_of(a, a.sum(1))))]


def hierarchy(a: np.ndarray, names: list[str], radius: int = 1, most: int = 10) -> list[tuple]:
    """(``level``, ``node``, ``box``): boxes of boxes until a level doesn't shrink; ``box`` is the first node of each."""
    out, current, own = [], a, list(names)
    for level in range(1, most + 1):
        boxes = box_cover(distances(current), radius)
        if len(boxes) == len(current):
            break
        label = np.empty(len(current), dtype=int)
        for b, box in enumerate(boxes):
            label[box] = b
        firsts = [own[box[0]] for box in boxes]
        out += [(level, own[i], firsts[label[i]]) for i in range(len(current))]
        joined = np.zeros((len(boxes), len(boxes)))
        for u, v in zip(*np.nonzero(current)):
            if label[u] != label[v]:
                joined[label[u], label[v]] = 1.0
        current, own = joined, firsts
    return out


def heat_diagonal(a: np.ndarray, t: float, order: int = 30, samples: int | None = None, seed: int = 0) -> np.ndarray:
    """The diagonal of exp(-t L): exact, or estimated by ``samples`` vectors of signs."""
    heat = chebyshev_heat(laplacian(a), t, order)
    if samples is None:
        return np.diag(heat).copy()
    signs = np.random.default_rng(seed).choice((-1.0, 1.0), (len(a), samples))
    return (signs * (heat @ signs)).mean(1)


def lanczos_largest(matrix: np.ndarray, steps: int = 30, seed: int = 0) -> float:
    """The largest eigenvalue of a symmetric matrix by Lanczos steps."""
    n = len(matrix)
    v = np.random.default_rng(seed).standard_normal(n)
    v /= np.linalg.norm(v)
    basis, alphas, betas = [v], [], []
    for _ in range(min(steps, n)):
        w = matrix @ basis[-1]
        alphas.append(float(w @ basis[-1]))
        for b in basis:  # kept orthogonal, as rounding would bring old directions back
            w -= (w @ b) * b
        norm = float(np.linalg.norm(w))
        if norm < 1e-12:
            break
        betas.append(norm)
        basis.append(w / norm)
    k = len(alphas)
    return float(np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))[-1])


def automorphisms(a: np.ndarray, most: int = 1_000) -> list[tuple[int, ...]]:
    """Permutations of the nodes that leave the edges as they are, ``most`` at most: a search by degrees and neighbours placed so far."""
    n, degree = len(a), a.sum(1)
    found: list[tuple[int, ...]] = []

    def place(image: list[int]) -> None:
        i = len(image)
        if len(found) >= most:
            return
        if i == n:
            found.append(tuple(image))
            return
        for c in range(n):
            if c not in image and degree[c] == degree[i] and all(a[i, j] == a[c, image[j]] for j in range(i)):
                place([*image, c])

    place([])
    return found


def orbits_of(images: list[tuple[int, ...]], n: int) -> list[int]:
    """The least node that each node is carried to or from."""
    label = list(range(n))
    for image in images:
        for i, j in enumerate(image):
            p, q = label[i], label[j]
            if p != q:
                label = [min(p, q) if x in (p, q) else x for x in label]
    return label


def canonical_views(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` canonical correlations of two views of the same rows, and both projections."""
    x, y = x - x.mean(0), y - y.mean(0)
    n = max(1, len(x) - 1)

    def whitening(m):
        values, vectors = np.linalg.eigh(m.T @ m / n + ridge * np.eye(m.shape[1]))
        return vectors / np.sqrt(np.maximum(values, ridge)) @ vectors.T

    wx, wy = whitening(x), whitening(y)
    u, s, vt = np.linalg.svd(wx @ (x.T @ y / n) @ wy)
    return s[:k], wx @ u[:, :k], wy @ vt[:k].T


def linear_autoencoder(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Codes of ``width`` numbers, the decoder, and the mean squared error: the best linear ones, by singular vectors."""
    mean = x.mean(0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    decoder = vt[:width]
    codes = (x - mean) @ decoder.T
    return codes, decoder, float(((x - mean - codes @ decoder) ** 2).mean())


def attention_embeddings(hyperedges: list[list[int]], features: np.ndarray, width: int, heads: int = 1, seed: int = 0) -> np.ndarray:
    """For each hyperedge the mean of its members' values after softmax attention between them, with seeded random projections."""
    rng = np.random.default_rng(seed)
    maps = rng.standard_normal((heads, 3, features.shape[1], width)) / np.sqrt(features.shape[1])
    out = np.zeros((len(hyperedges), heads * width))
    for e, members in enumerate(hyperedges):
        if not members:
            continue
        x = features[members]
        for h in range(heads):
            q, k, v = (x @ maps[h, i] for i in range(3))
            score = q @ k.T / np.sqrt(width)
            weight = np.exp(score - score.max(1, keepdims=True))
            out[e, h * width : (h + 1) * width] = (weight / weight.sum(1, keepdims=True) @ v).mean(0)
    return out


def poincare_points(a: np.ndarray, dimensions: int = 2, epochs: int = 100, rate: float = 0.1, seed: int = 0) -> np.ndarray:
    """Points in the unit ball whose hyperbolic distances follow the graph's steps, by gradient descent on their stress."""
    d = np.minimum(distances(a), len(a))
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((len(a), dimensions)) * 0.01

    def stress(p):
        square = ((p[:, None] - p[None]) ** 2).sum(2)
        inner = np.outer(1 - (p * p).sum(1), 1 - (p * p).sum(1))
        return np.arccosh(1 + 2 * square / inner), square, inner

    for _ in range(epochs):
        dist, square, inner = stress(x)
        scale = np.where(d > 0, (dist - d) / np.maximum(np.sqrt((1 + 2 * square / inner) ** 2 - 1), 1e-6) / inner, 0.0)
        gradient = 4 * (scale[:, :, None] * (x[:, None] - x[None])).sum(1) / max(1, len(a))
        x = x - rate * ((1 - (x * x).sum(1, keepdims=True)) ** 2 / 4) * gradient
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.where(norm >= 1 - 1e-3, x / norm * (1 - 1e-3), x)
    return x


def walked_graph(a: np.ndarray, walks: int, length: int, edges: int, seed: int = 0) -> np.ndarray:
    """A graph of as many ``edges`` as asked for, those that random walks over ``a`` take most often (the first in order among equals)."""
    rng = np.random.default_rng(seed)
    count = np.zeros_like(a)
    near = [np.flatnonzero(row) for row in a]
    for _ in range(walks):
        at = int(rng.integers(len(a)))
        for _ in range(length):
            if not len(near[at]):
                break
            following = int(rng.choice(near[at]))
            count[at, following] += 1
            count[following, at] += 1
            at = following
    u, v = np.triu_indices(len(a), 1)
    order = np.lexsort((v, u, -count[u, v]))[:edges]
    out = np.zeros_like(a)
    out[u[order], v[order]] = out[v[order], u[order]] = 1.0
    return out


def grown_graph(nodes: int, edges: int, seed: int = 0) -> np.ndarray:
    """A connected graph grown node by node: each joins one before it, then pairs are added until there are ``edges``."""
    if not nodes - 1 <= edges <= nodes * (nodes - 1) // 2:
        raise ValueError("a connected graph of so many nodes has another number of edges")
    rng = np.random.default_rng(seed)
    a = np.zeros((nodes, nodes))
    for i in range(1, nodes):
        j = int(rng.integers(i))
        a[i, j] = a[j, i] = 1.0
    free = np.stack(np.nonzero(np.triu(1 - a, 1)), axis=1)
    for u, v in free[rng.permutation(len(free))[: edges - (nodes - 1)]]:
        a[u, v] = a[v, u] = 1.0
    return a


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    """Of minimising, for normal predictions; 0 where nothing is uncertain."""
    from math import erf

    z = np.where(deviation > 0, (best - mean) / np.maximum(deviation, 1e-12), 0.0)
    cdf = 0.5 * (1 + np.vectorize(erf)(z / np.sqrt(2)))
    return np.where(deviation > 0, (best - mean) * cdf + deviation * np.exp(-z * z / 2) / np.sqrt(2 * np.pi), 0.0)


def proposed(params: np.ndarray, scores: np.ndarray, bounds: np.ndarray, samples: int = 200, width: float = 0.2, seed: int = 0) -> np.ndarray:
    """The candidate of greatest expected improvement under a Gaussian process over what was tried."""
    span = bounds[:, 1] - bounds[:, 0]
    x = (params - bounds[:, 0]) / span
    candidates = np.random.default_rng(seed).uniform(size=(samples, len(bounds)))
    kernel = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2) / (2 * width**2))
    centred = scores - scores.mean()
    inverse = np.linalg.inv(kernel(x, x) + 1e-6 * np.eye(len(x)))
    cross = kernel(candidates, x)
    mean = cross @ inverse @ centred
    deviation = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", cross, inverse, cross), 0.0))
    return bounds[:, 0] + candidates[int(np.argmax(expected_improvement(mean, deviation, float(centred.min()))))] * span


def finite_gradient(f, x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """Central differences of ``f`` in each direction."""
    steps = np.eye(len(x)) * h
    return np.array([(f(x + s) - f(x - s)) / (2 * h) for s in steps])


def information_bottleneck(features: np.ndarray, labels: np.ndarray, beta: float, rounds: int = 200, rate: float = 0.5) -> float:
    """Cross-entropy of a logistic regression on the labels, plus ``beta`` times half the log-determinant of 1 + covariance."""
    x = np.column_stack([np.ones(len(features)), (features - features.mean(0)) / np.maximum(features.std(0), 1e-12)])
    kinds, y = np.unique(labels, return_inverse=True)
    hot, w = np.eye(len(kinds))[y], np.zeros((x.shape[1], len(kinds)))
    for _ in range(rounds):
        p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * x.T @ (p - hot) / len(x)
    entropy = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
    cov = np.atleast_2d(np.cov(features.T))
    return float(entropy + beta * 0.5 * np.linalg.slogdet(np.eye(len(cov)) + cov)[1])
