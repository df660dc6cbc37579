"""Diagram distances, covers, symmetries, views and random graphs against brute force and known values; metrics that no SQL states."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from lodestrata.operators import layers, metrics, shapes
from lodestrata.operators.numeric import laplacian, overlapping_balls

PATH4 = np.diag(np.ones(3), 1) + np.diag(np.ones(3), -1)
STAR = np.zeros((5, 5))
STAR[0, 1:] = STAR[1:, 0] = 1


def brute(one, other, fold):
    cost = shapes._with_diagonal(one, other)
    return min(fold(cost[np.arange(len(cost)), list(p)]) for p in permutations(range(len(cost))))


def test_diagram_distances_equal_brute_force():
    rng = np.random.default_rng(2)
    for n, m in [(0, 0), (0, 2), (1, 1), (2, 3), (3, 3), (4, 2)]:
        one, other = (np.sort(rng.uniform(0, 5, (k, 2)), axis=1) for k in (n, m))
        if n + m:
            assert shapes.wasserstein_distance(one, other) == pytest.approx(brute(one, other, np.sum))
            assert shapes.bottleneck_distance(one, other) == pytest.approx(brute(one, other, np.max))
    assert shapes.bottleneck_distance(np.zeros((0, 2)), np.zeros((0, 2))) == 0 == shapes.wasserstein_distance(np.zeros((0, 2)), np.zeros((0, 2)))


def test_covers_and_dimensions():
    line = np.linspace(0, 1, 400)[:, None]
    square = np.stack(np.meshgrid(np.linspace(0, 1, 40), np.linspace(0, 1, 40)), 2).reshape(-1, 2)
    assert 0.8 < shapes.point_dimension(line, [0.02, 0.04, 0.08]) < 1.2 < 1.5 < shapes.point_dimension(square, [0.1, 0.15, 0.2]) < 2.5
    assert shapes.point_dimension(line, [0.1]) == 0.0 and shapes.colour_boxes(PATH4, 1) == 2 and shapes.colour_boxes(STAR, 2) == 1
    assert [r[0] for r in shapes.hierarchy(PATH4, list("abcd"))] == [1, 1, 1, 1, 2, 2] and shapes.hierarchy(np.zeros((2, 2)), ["a", "b"]) == []


def test_spectra():
    golden = [0.64503527, 0.66448729, 0.66448729, 0.64503527]
    assert np.allclose(shapes.heat_diagonal(PATH4, 0.5), golden, atol=1e-2) and np.allclose(shapes.heat_diagonal(PATH4, 0.5, samples=20_000), golden, atol=2e-2)
    assert shapes.lanczos_largest(laplacian(STAR)) == pytest.approx(np.linalg.eigvalsh(laplacian(STAR))[-1])
    signal = np.array([3.0, 1, 4, 1])
    assert np.allclose(shapes.inverse_fourier(PATH4, shapes.fourier_of(PATH4, signal)), signal)
    density, edges = shapes.spectral_density(STAR, 4)
    assert (density * np.diff(edges)).sum() == pytest.approx(1)


def test_symmetries():
    assert len(shapes.automorphisms(PATH4)) == 2 and len(shapes.automorphisms(STAR)) == 24 and len(shapes.automorphisms(STAR, 5)) == 5
    assert shapes.orbits_of(shapes.automorphisms(STAR), 5) == [0, 1, 1, 1, 1] and shapes.orbits_of(shapes.automorphisms(PATH4), 4) == [0, 1, 1, 0]


def test_views():
    rng = np.random.default_rng(0)
    shared = rng.standard_normal((500, 2))
    x, y = np.column_stack([shared, rng.standard_normal((500, 2))]), np.column_stack([shared @ [[1, 1], [1, -1]], rng.standard_normal((500, 1))])
    values, a, b = shapes.canonical_views(x, y, 3)
    assert values[1] > 0.99 > 0.4 > values[2] and abs(np.corrcoef((x @ a)[:, 0], (y @ b)[:, 0])[0, 1]) > 0.99
    codes, decoder, error = shapes.linear_autoencoder(np.outer(rng.standard_normal(50), [1.0, 2, 3]), 1)
    assert codes.shape == (50, 1) and decoder.shape == (1, 3) and error < 1e-20
    out = shapes.attention_embeddings([[0, 1], [1, 2, 3], []], np.arange(12.0).reshape(4, 3), 5, heads=2)
    assert out.shape == (3, 10) and not out[2].any() and np.allclose(out, shapes.attention_embeddings([[1, 0], [3, 1, 2], []], np.arange(12.0).reshape(4, 3), 5, heads=2))
    points = shapes.poincare_points(STAR)
    near = np.linalg.norm(points[0] - points[1:], axis=1).mean()
    assert (np.linalg.norm(points, axis=1) < 1).all() and near < np.linalg.norm(points[1:, None] - points[None, 1:], axis=2)[np.triu_indices(4, 1)].mean()


def test_random_graphs():
    grown = shapes.grown_graph(12, 20, 3)
    assert grown.sum() == 40 and (grown == shapes.grown_graph(12, 20, 3)).all() and np.isfinite(shapes.distances(grown)).all()
    walked = shapes.walked_graph(grown, 50, 8, 15)
    assert walked.sum() == 30 and (walked <= grown).all()
    with pytest.raises(ValueError):
        shapes.grown_graph(5, 3)


def test_tuning():
    bounds = np.array([[0.0, 1.0], [0.0, 2.0]])
    tried = np.array([[0.1, 0.2], [0.9, 1.8], [0.5, 1.0]])
    found = shapes.proposed(tried, ((tried - [0.3, 0.7]) ** 2).sum(1), bounds)
    assert (found >= bounds[:, 0]).all() and (found <= bounds[:, 1]).all()
    assert np.allclose(shapes.finite_gradient(lambda x: (x**2).sum(), np.array([1.0, -2.0])), [2, -4])
    assert shapes.expected_improvement(np.array([0.0]), np.array([0.0]), 1.0)[0] == 0
    rng = np.random.default_rng(1)
    told, noise = np.repeat([0, 1], 50), rng.standard_normal((100, 2))
    assert shapes.information_bottleneck(noise + told[:, None] * 4, told, 0.0) < shapes.information_bottleneck(noise, told, 0.0)


def test_paths_code_units_and_pairs(tmp_path):
    (tmp_path / "root").mkdir()
    assert metrics.inside_root(str(tmp_path / "root" / "a"), str(tmp_path / "root")).endswith("a")
    for bad in ("root/../other", "root2"):
        with pytest.raises(ValueError):
            metrics.inside_root(str(tmp_path / bad), str(tmp_path / "root"))
    assert metrics.code_atoms("import os\ndef f():\n    return 1\nclass C:\n    pass\n") == ["def f():\n    return 1", "class C:\n    pass"]
    assert metrics.code_atoms("x = 1") == ["x = 1"] and metrics.code_atoms("def (") == ["def ("]
    assert metrics.in_base_units("3 km and 20 cm, 5 hours; 7 kmh") == "3000 m and 0.2 m, 18000 s; 7 kmh" and metrics.in_base_units(None) is None
    assert metrics.lenient_pairs("ok [{question: 'it''s', answer: 'b'}]") in ([], [("it''s", "b")])
    assert metrics.lenient_pairs("x [{'question': 'a?', 'answer': 'b', }, // c\n] y") == [("a?", "b")]
    assert metrics.lenient_pairs('broken {"question": "q", "answer": "a \\"x\\""') == [("q", 'a "x"')] and metrics.lenient_pairs(None) == []
    assert metrics.task_of(["prompt", "chosen", "rejected"]) == "rlhf" and metrics.task_of(["text", "label"]) == "classification" and metrics.task_of(["a"], "own") == "own"
    assert metrics.accumulation_steps(10, 4) == 3 and metrics.accumulation_steps(10, 0) == 10 and metrics.missing_fields("CURATE", ["question"]) == ["answer", "rating"]


def test_balls_and_radii():
    assert overlapping_balls(PATH4, list("abcd")) == [("a", "a"), ("a", "b"), ("c", "b"), ("c", "c"), ("c", "d")]
    counts = {1.0: 100, 2.0: 90, 4.0: 30, 8.0: 5}
    assert layers.steep_radius(counts, 0.8) == 4.0 and layers.steep_radius(counts, 9.0) is None and layers.steep_radius({1.0: 3}, 0.1) is None
