"""Problems on pairs: recall against brute force, and odd inputs."""

from __future__ import annotations

import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestrata.llm import name_variants, near_duplicates, vector_neighbours

# ---- near duplicates


def records(spark, rows):
    return spark.createDataFrame([(2 * i + space, space, f"{space}-{i}", t, 1) for i, (space, t) in enumerate(rows)], "rid bigint, space int, id string, text string, copy int")


def jaccard(a, b):
    g = [set(zip(*(x.lower().split()[i:] for i in range(3)))) for x in (a, b)]
    return len(g[0] & g[1]) / max(1, len(g[0] | g[1]))


def revised(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


def test_revisions_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))]
        rows.append((0, " ".join(words)))
        for _ in range(rng.randrange(3)):
            rows.append((0, " ".join(revised(rng, words, rng.choice((0.01, 0.03, 0.05))))))
    rows += [(1, rows[0][1]), (0, rows[0][1]), (0, rows[0][1].upper()), (0, "two words"), (0, None), (0, ""), (0, "one two three"), (0, "one two three"), (1, "x " * 30_000)]
    members, pairs = near_duplicates.revisions(records(spark, rows))
    heads = {r.id: r.head for r in members.collect()}
    linked = {frozenset((r.a, r.b)) for r in pairs.collect()}
    for (i, (s, a)), (j, (t, b)) in combinations(enumerate(rows), 2):
        if a and b and len(a.split()) > 2 and len(b.split()) > 2:
            p, q = heads[f"{s}-{i}"], heads[f"{t}-{j}"]
            value = jaccard(a, b)
            if s != t or value < 0.55:
                assert p != q and frozenset((p, q)) not in linked
            elif value >= 0.65:
                assert p == q or frozenset((p, q)) in linked, value


def test_sure_within_the_radius():
    """Any two signatures that differ in no more symbols than the radius meet in an entry."""
    rng = np.random.default_rng(1)
    width, chunks = near_duplicates.CHUNK_WIDTH, near_duplicates.CHUNKS
    for _ in range(300):
        wrong = rng.choice(width * chunks, near_duplicates.radius(), replace=False)
        assert np.bincount(wrong // width, minlength=chunks).min() <= near_duplicates.CHUNK_ERRORS


def test_few_pairs_at_the_limit_can_be_missed():
    """A pair of the least similarity asked for shares no entry in less than two of a thousand cases, and the radius covers what is expected of it."""
    chunks, width, p = near_duplicates.CHUNKS, near_duplicates.CHUNK_WIDTH, near_duplicates.SIMILARITY
    meets = p**width + width * (1 - p) * p ** (width - 1)
    assert (1 - meets) ** chunks < 0.002
    assert near_duplicates.radius() >= (1 - p) * chunks * width + 2


def test_revisions_of_no_rows(spark):
    members, pairs = near_duplicates.revisions(records(spark, [(0, "a b c d")]).limit(0))
    assert members.count() == 0 and pairs.count() == 0


def test_shuffled_verification_is_the_same(spark, small, monkeypatch):
    plain = {tuple(r) for r in near_duplicates.p1_found(spark, small).collect()}
    monkeypatch.setattr(near_duplicates, "BROADCAST_IDS", -1)
    assert plain == {tuple(r) for r in near_duplicates.p1_found(spark, small).collect()}


# ---- vectors


def brute(rows, k=5, least=0.9):
    unit = {n: np.array(v) / np.linalg.norm(v) for n, v in rows}
    names = sorted(unit)
    x = np.stack([unit[n] for n in names])
    c = x @ x.T
    np.fill_diagonal(c, -2)
    out = set()
    for i in range(len(names)):
        kth = np.sort(c[i])[::-1][min(k, len(names) - 1) - 1]
        out |= {tuple(sorted((names[i], names[j]))) for j in np.flatnonzero((c[i] >= kth - 1e-9) & (c[i] >= least))}
    return out


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(120):
        centre = rng.standard_normal(48)
        for m in range(int(rng.integers(1, 9))):
            rows.append((f"g{g}_{m}", (centre + rng.standard_normal(48) * rng.choice((0.05, 0.15, 0.25))) * float(rng.uniform(0.2, 3))))
    table = [(n, "s", [float(x) for x in v], 1) for n, v in rows]
    table += [table[0], ("bad1", "s", None, 1), ("bad2", "s", [], 1), ("bad3", "s", [1.0] * 3, 1), ("bad4", "s", [0.0] * 48, 1), ("bad5", "s", [float("nan")] * 48, 1), (None, "s", table[0][2], 1), ("twin", "s", table[0][2], 1), ("far", "t", table[0][2], 1)]
    vectors = spark.createDataFrame(table, "node_id string, space string, vec array<float>, rep int")
    found = {(r.id_a, r.id_b) for r in vector_neighbours.neighbour_pairs(vectors).collect()}
    truth = brute([*rows, ("twin", rows[0][1])])
    assert found <= truth and len(found & truth) / len(truth) >= 0.97
    assert vector_neighbours.neighbour_pairs(vectors.limit(0)).count() == 0


def test_a_dense_group(spark):
    """Hundreds of vectors in one spot: everyone still gets its neighbours."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    rows = [(f"n{i}", centre + rng.standard_normal(32) * 0.02) for i in range(400)]
    vectors = spark.createDataFrame([(n, "s", [float(x) for x in v]) for n, v in rows], "node_id string, space string, vec array<double>")
    found = {(r.id_a, r.id_b) for r in vector_neighbours.neighbour_pairs(vectors).collect()}
    truth = brute(rows)
    assert len(found & truth) / len(truth) >= 0.9


def written(spark) -> int:
    """Bytes shuffled so far."""
    time.sleep(1)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_many_vectors_are_shuffled_a_few_times_only(spark, tmp_path):
    """Pairs near the limit among vectors of many cells: all found, and what is shuffled is no more than three times the input."""
    rng = np.random.default_rng(21)
    n, near = 20_000, 1_000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((near, 64))
    side -= (side * x[:near]).sum(axis=1)[:, None] * x[:near]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.901, 0.95, near)[:, None]
    x[-near:] = cosine * x[:near] + np.sqrt(1 - cosine**2) * side
    names = [f"n{i}" for i in range(n)]
    table = pa.table({"node_id": names, "space": ["s"] * n, "vec": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "v.parquet")
    before = written(spark)
    found = {(r.id_a, r.id_b) for r in vector_neighbours.neighbour_pairs(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    assert written(spark) - before <= 3 * (tmp_path / "v.parquet").stat().st_size
    truth = {tuple(sorted((names[i], names[n - near + i]))) for i in range(near)}
    assert found <= truth and len(found) >= 0.998 * len(truth)


def test_a_node_with_several_vectors_keeps_the_least(spark, monkeypatch):
    rows = [("a", "s", [1.0, 0.0, 0.5]), ("a", "s", [0.0, 1.0, 0.0]), ("a", "s", [0.0, 2.0, 0.0]), ("b", "s", [0.0, 3.0, 0.1]), ("c", "s", [2.0, 0.0, 1.0]), ("d", "s", [1.0, -0.0, 0.5])]
    vectors = spark.createDataFrame(rows, "node_id string, space string, vec array<double>")
    for held in (vector_neighbours.HELD_NODES, 0):
        monkeypatch.setattr(vector_neighbours, "HELD_NODES", held)
        assert {(r.id_a, r.id_b) for r in vector_neighbours.neighbour_pairs(vectors).collect()} == {("a", "b"), ("c", "d")}


@pytest.mark.parametrize("dimensions", (1, 2, 7, 33, 64, 101))
def test_codes_stay_within_the_margin(dimensions):
    rng = np.random.default_rng(dimensions)
    x = rng.standard_normal((20_000, dimensions))
    y = x + 0.48 * rng.standard_normal(x.shape)
    x, y = ((v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32) for v in (x, y))
    turn = vector_neighbours._turn(dimensions)
    p, q = (vector_neighbours._decoded(vector_neighbours._coded(v @ turn), dimensions) for v in (x, y))
    true, seen = (x * y).sum(axis=1), (p * q).sum(axis=1)
    close = true >= vector_neighbours.COSINE
    assert close.any() and (seen[close] >= vector_neighbours.COSINE - vector_neighbours.MARGIN).all()


# ---- names


def test_one_edit():
    for a, b, same in [("abcd", "abdc", True), ("abcd", "abc", True), ("abcd", "xabcd", True), ("abcd", "abxd", True), ("abcd", "badc", False), ("abcd", "ab", False), ("", "a", True), ("same", "same", True)]:
        assert name_variants.one_edit(a, b) == same and name_variants.one_edit(b, a) == same


def names(spark, authors=(), organizations=(), entities=()):
    documents = spark.createDataFrame([(a, o) for a, o in [*((a, None) for a in authors), *((None, o) for o in organizations)]], "author string, organization string")
    chunks = spark.createDataFrame([(list(entities),), (None,), ([],)], "entities array<string>")
    return name_variants.typed_names(documents, chunks)


def grouped(table):
    out: dict = {}
    for r in name_variants.same_names(table).collect():
        out.setdefault(r.entity, set()).add(r.name)
    return sorted(map(sorted, out.values()))


def test_spellings(spark):
    person = ["Margaret Dusfirtell", "MARGARET DUSFIRTELL", "Dusfirtell, Margaret", "Dusfirtell M", "M. Dusfirtell", "Peggy Dusfirtell", "Margaret Dysfirtell", "Dr. Margaret Q. Dusfirtell (ed.)"]
    other = ["Henrietta Dusfirtell", "H. Dusfirtell"]
    body = ["Kemnkendex Agronomy Laboratory", "Kemnkendex Agron. Lab.", "Kemnkendex AL", "The Kemnkendex Agronomy Laboratory gGmbH", "Laboratory of Agronomy, Kemnkendex", "Kmenkendex Agronomy Laboratory", "Kemnkendex Agronomy"]
    another = ["Kemnkendex Textile University"]
    places = ["Port Dusfirt", "Upper Gilton", "Upper Gilten", "Dusby-71"]
    found = grouped(names(spark, [*person, *other, None, "", "  "], [*body, *another], [*person[:2], *body[:1], *places]))
    assert found == sorted([sorted(person), sorted(other), sorted(body)])


def test_ambiguous_initials_stay_apart(spark):
    found = grouped(names(spark, ["Josephine Salvirvund", "Josephine Salvirvnd", "Jonathan Salvirvund", "Jonathan Salvirvunt", "J. Salvirvund"]))
    assert found == [["Jonathan Salvirvund", "Jonathan Salvirvunt"], ["Josephine Salvirvnd", "Josephine Salvirvund"]]


def test_every_name_is_compared(spark):
    # strings of chunks that lead to a known name only by others, names of two letters, an abbreviation with a wrong first letter, a name in either field
    chunks = ["Paul Gifieldow", "P. Gifieldow", "Gifieldow, P.", "Wu, Li", "Upper Gilton", "Upper Gilten"]
    found = grouped(names(spark, ["Paul Salvirvund", "Li Wu", "Kemnkendex Agronomy Laboratory", "Max Dusfirtell"], ["Kemnkendex Agron. Lab.", "Munichen University", "Munichen Nivers.", "Max Dusfirtell Institute"], chunks))
    assert found == sorted(
        [sorted(chunks[:3]), ["Li Wu", "Wu, Li"], ["Kemnkendex Agron. Lab.", "Kemnkendex Agronomy Laboratory"], ["Munichen Nivers.", "Munichen University"]]
    )


def test_names_of_no_rows(spark):
    table = names(spark, ["x"], [], []).limit(0)
    assert name_variants.same_names(table).count() == 0


@pytest.mark.parametrize("name", ["", " ", "(ed.)", "...", "X" * 5_000, "a b c d e f g h i j k l m n", "Ü", "李明", "O'Neil-Smith, J.R.R."])
def test_odd_names(name):
    tokens = tuple(name_variants.tokens_of(name))
    assert name_variants.verdict(tokens, tokens) in (None, "link", "short")


def test_assignment_is_optimal():
    from itertools import permutations

    rng = random.Random(4)
    for _ in range(300):
        n, m = sorted((rng.randrange(1, 5), rng.randrange(1, 6)))
        worth = [[rng.randrange(-5, 6) for _ in range(m)] for _ in range(n)]
        best = max(sum(worth[i][p[i]] for i in range(n)) for p in permutations(range(m), n))
        chosen = name_variants.assign(worth)
        assert len(set(chosen)) == n and sum(worth[i][j] for i, j in enumerate(chosen)) == best


def test_long_names_align():
    tokens = tuple(f"token{i}" for i in range(30))
    assert name_variants.verdict(tokens, tuple(reversed(tokens))) == "link"


@pytest.mark.parametrize("tile", (16_384, 50))
def test_every_vector_has_its_nearest_however_far(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_neighbours, "TILE", tile)
    rng = np.random.default_rng(12)
    vectors = {("s", f"n{i}"): rng.standard_normal(24) for i in range(160)} | {("t", f"n{i}"): rng.standard_normal(16) for i in range(4)}
    vectors |= {("s", f"m{i}"): vectors["s", "n0"] + 0.05 * rng.standard_normal(24) for i in range(8)}
    rows = [(s, n, [float(x) for x in v]) for (s, n), v in vectors.items()]
    found = vector_neighbours.nearest(spark.createDataFrame(rows, "space string, node_id string, vec array<float>")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((r.space, r.id), []).append(r.other)
    for (s, n), v in vectors.items():
        others = {m: w @ v / np.linalg.norm(w) for (t, m), w in vectors.items() if t == s and m != n}
        assert got[s, n] == sorted(others, key=others.get, reverse=True)[:5]
