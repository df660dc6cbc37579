"""Operators on small fixtures whose results are known."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vectors as V
from lodestrata.operators import graph as G
from lodestrata.operators import greedy, numeric, retrieval, sampling, search, topology
from lodestrata.operators.building import fact_edges, fact_rows
from lodestrata.operators.components import connected_components
from lodestrata.operators.measures import hyper_adamic_adar, indexed_percentile, renyi_epsilon
from lodestrata.streaming import edges as E

NODES = "id string, pos bigint, type string, text string, source string, author string, organization string, birth_date string, page int, entities array<string>"
EDGES = "src string, dst string, relation string, sequence int, provenance string, similarity double"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, n, t, x, s, None, None, b, None, None) for n, (i, t, x, s, b) in enumerate(rows)], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, r, s, p, None) for a, b, r, s, p in rows], EDGES)


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text", [None, "", "abc", "a" * 512, "a" * 513, "xy" * 700, "\n\n\n", "é" * 1100])
def test_sliding_windows(spark, text):
    found = one(spark, lambda c: T.sliding_windows(c, 512, 64), text)
    expected, start = [], 0
    while text and start < len(text):
        end = min(start + 512, len(text))
        expected.append(text[start:end])
        if end == len(text):
            break
        start = end - 64
    assert found == expected


def test_markup_and_dates(spark):
    assert one(spark, T.without_markup, "<p>Hello\n world</p>") == "Hello world"
    for typed, iso in [("Jan 2, 2024", "2024-01-02"), ("18.9.1954", "1954-09-18"), ("1980-05-06T00:00:00Z", "1980-05-06"), ("1996", None), ("nonsense", None), (None, None)]:
        assert str(one(spark, G.normalized_date, typed)) == str(iso)


def test_packed_paragraphs(spark):
    text = "A one. B two. C three. D four. E five\n\n" + "x" * 30 + "\n\ny"
    expected, current = [], ""
    for p in text.split("\n\n"):
        if len(current) + len(p) > 45 and current:
            expected.append(current)
            last = current.split(". ")
            current = ". ".join(last[-3:]) + "\n\n" + p if len(last) > 3 else p
        else:
            current = current + "\n\n" + p if current else p
    assert one(spark, lambda c: T.packed_paragraphs(c, 45), text) == [*expected, current]


def test_prune_sources(spark):
    n = nodes(spark, ("doc1", "document", None, "bad", None), ("c1", "chunk", "t", "bad", None), ("e1", "entity", "E", "good", None))
    e = edges(spark, ("c1", "e1", "mentions", None, "bad"))
    kept, left = G.without_sources(n, e, spark.createDataFrame([("bad",)], "source string"))
    assert [r.id for r in kept.collect()] == ["e1"] and left.count() == 0


def test_conflicts_coherence_resolution(spark):
    e = edges(spark, ("A", "B", "related", None, None), ("A", "C", "related", None, None), ("A", "D", "has_chunk", None, None))
    assert G.marked_conflicts(e).where("conflict").count() == 2
    n = nodes(spark, ("p", "person", None, None, "2024-01-01"), ("c", "person", None, None, "2023-01-01"))
    assert G.incoherent_parents(n, edges(spark, ("p", "c", "parent_of", None, None))).count() == 1
    n = nodes(spark, ("e1", "entity", "IBM", None, None), ("e2", "entity", "International Business Machines", None, None))
    aliases = spark.createDataFrame([("international business machines", "IBM")], "alias string, name string")
    assert {r.id: r.keeper for r in G.resolved_entities(n, aliases).collect()} == {"e1": "e1", "e2": "e1"}


def test_fact_confidence(spark):
    e = edges(spark, ("e1", "e2", "knows", None, None))
    said = spark.createDataFrame([("e1", "knows", "e2"), ("e1", "likes", "e2"), ("e1", "knows", "e9")], "subject string, predicate string, object string")
    found = {(r.subject, r.predicate, r.object): r.confidence for r in G.fact_confidence(said, e).collect()}
    assert found == {("e1", "knows", "e2"): 1.0, ("e1", "likes", "e2"): 0.4, ("e1", "knows", "e9"): 0.0}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (90, 2))] + [(f"l{i}", f"l{i + 1}") for i in range(40)] + [("x", "x"), (None, "y")]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    groups: dict = {}
    for x in parent:
        groups.setdefault(root(x), []).append(x)
    assert found == {x: min(g) for g in groups.values() for x in g}


def test_empty_tables(spark):
    n, e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert G.document_entities(n, e).count() == 0 and G.triangles(e).count() == 0 and connected_components(e).count() == 0
    assert G.component_sizes(n, e).count() == 0 and G.renumbered(e).count() == 0


def test_watermark(spark):
    at = datetime(2024, 1, 1, 12)
    rows = [(0, "a", "b", at + timedelta(minutes=10)), (1, "a", "c", at + timedelta(minutes=2)), (2, "a", "d", at - timedelta(minutes=5)), (3, "a", "e", None), (4, "z", None, at + timedelta(minutes=10))]
    found = E.late_events(spark.createDataFrame(rows, "arrival bigint, src string, dst string, ts timestamp"))
    assert {r.arrival: r.late for r in found.collect()} == {0: False, 1: False, 2: True, 3: True, 4: False}


def test_running_maximum_over_blocks(spark):
    rng = np.random.default_rng(4)
    values = [None if v == 0 else int(v) for v in rng.integers(0, 50, 60)]
    rows = spark.createDataFrame(list(enumerate(values)), "i bigint, v bigint")
    seen, top = [], None
    for v in values:
        top = v if top is None else top if v is None else max(top, v)
        seen.append(top)
    assert [r.seen for r in E.running_maximum(rows, "i", "v", 7).orderBy("i").collect()] == seen


def test_stream_equals_batch(spark, tmp_path):
    at = datetime(2024, 1, 1, 12)
    rng = np.random.default_rng(2)
    rows = [(i, f"s{i % 5}", f"t{i % 7}", at + timedelta(minutes=float(m))) for i, m in enumerate(rng.normal(np.arange(60), 8))]
    schema = "arrival bigint, src string, dst string, ts timestamp"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    expected = {r.arrival for r in E.late_events(spark.createDataFrame(rows, schema)).where("late").collect()}
    for i in range(3):  # three arrivals, with a restart between them
        target = tmp_path / "source"
        target.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(target / f"{i}-{f.name}")
        query = E.route_stream(spark.readStream.schema(schema).parquet(str(target)), str(tmp_path / "hot"), str(tmp_path / "late"), str(tmp_path / "check"))
        query.awaitTermination(120)
    late = {r.arrival for r in spark.read.parquet(str(tmp_path / "late")).collect()}
    hot = {r.arrival for r in spark.read.parquet(str(tmp_path / "hot")).collect()}
    assert late == expected and hot == set(range(60)) - expected


def test_quotas_and_sample(spark):
    assert sampling.quotas(10, {"a": 0.35, "b": 0.33, "c": 0.32}) == {"a": 4, "b": 3, "c": 3}
    rows = spark.range(5000).select(F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    found = sampling.stratified_sample(rows, "item", "label", 100, {"a": 0.3, "b": 0.7})
    assert {r.label: r["count"] for r in found.groupBy("label").count().collect()} == {"a": 30, "b": 70}
    again = sampling.stratified_sample(rows.repartition(7), "item", "label", 100, {"a": 0.3, "b": 0.7})
    assert sorted(r.item for r in found.collect()) == sorted(r.item for r in again.collect())
    with pytest.raises(ValueError):
        sampling.quotas(10, {"a": 0.3})


def test_budget_and_bucket(spark):
    spend = spark.createDataFrame([("u", 0.0, 3.0), ("u", 1.0, 3.0), ("u", 2.0, 2.0), ("u", 86_400.0, 3.0), ("v", 5.0, 6.0)], "user string, t double, amount double")
    found = greedy.sliding_budget(spend, "user", ["t"], "t", "amount", 5.0).orderBy("user", "t").collect()
    assert [r.accepted for r in found] == [True, False, True, True, False]
    calls = spark.createDataFrame([("t", float(x), i) for i, x in enumerate([0, 0, 0, 1, 0, 9])], "tenant string, now double, i int")
    assert [r.admitted for r in greedy.token_bucket(calls, "tenant", ["i"], "now", 1.0, 2.0).orderBy("i").collect()] == [True, True, False, True, False, True]


def test_similar_pairs(spark):
    rng = np.random.default_rng(8)
    words = "the old ledger of the northern mill was read by a clerk in the annex before noon".split()
    base = [" ".join(rng.choice(words, 9)) for _ in range(12)]
    rows = []
    for i in range(60):
        q, a = base[rng.integers(12)], base[rng.integers(4)]
        if rng.random() < 0.5:
            at = rng.integers(len(q))
            q = q[:at] + "x" + q[at + 1 :]
        rows.append((i, q, a))
    kept: list = []
    for i, q, a in rows:
        if not any(SequenceMatcher(None, q, p).ratio() >= 0.9 and SequenceMatcher(None, a, b).ratio() >= 0.9 for _, p, b in kept):
            kept.append((i, q, a))
    found = greedy.similar_pairs_dropped(spark.createDataFrame(rows, "pos bigint, question string, answer string"), 0.9)
    assert sorted(r.pos for r in found.collect()) == [i for i, _, _ in kept]


@pytest.mark.parametrize("tile", (8_192, 7))
def test_similar_pairs_without_rare_words_in_common(spark, monkeypatch, tile):
    monkeypatch.setattr(greedy, "TILE", tile)
    rows = [
        (0, "Why was entry MA-6904 moved to Upper Hall by clerk 17 in the year 1894 of the old count?", "It was moved to the upper hall."),
        (1, "Why was entry MA-6914 moved to Uppel Hall by clerk 27 in the year 1894 of the old count?", "It was moved to the upper hall."),
        (2, "", "The ledger lies in the northern annex."),
        (3, None, "The ledger lies in the northern annexe."),
        (4, "账目在哪里存放的呢请告诉我们好吗", "In the annex."),
        (5, "账目在哪里存放的呢请告诉我们好么", "In the annex."),
        (6, "?!", None),
        (7, "?!", "In the hall."),
    ]
    rng = np.random.default_rng(5)
    words = "the old ledger of the northern mill was read by a clerk in the annex before noon".split()
    for i in range(8, 60):
        q = list(" ".join(rng.choice(words, 10)) if i % 3 or i < 12 else rows[i - 3][1] or "x")
        for at in rng.integers(len(q), size=rng.integers(4)):
            q[at] = "qxz7"[rng.integers(4)]
        rows.append((i, "".join(q), rows[rng.integers(4)][2]))
    kept: list = []
    for i, q, a in ((i, q or "", a or "") for i, q, a in rows):
        if not any(SequenceMatcher(None, q, p).ratio() >= 0.9 and SequenceMatcher(None, a, b).ratio() >= 0.9 for _, p, b in kept):
            kept.append((i, q, a))
    found = greedy.similar_pairs_dropped(spark.createDataFrame(rows, "pos bigint, question string, answer string"), 0.9)
    assert sorted(r.pos for r in found.collect()) == [i for i, _, _ in kept]


def test_merged_points(spark):
    rows = spark.createDataFrame([(0, "g", [0.0, 0.0]), (1, "g", [0.02, 0.0]), (2, "g", [1.0, 0.0])], "i int, g string, v array<double>")
    assert [r.cluster for r in greedy.merged_points(rows, "g", "i", "v", 0.05).orderBy("i").collect()] == [0, 0, 1]


def test_vectors(spark):
    rows = spark.createDataFrame([([0.1, 0.2], [0.3, -0.1])], "a array<double>, b array<double>")
    r = rows.select(V.poincare_distance(F.col("a"), F.col("b")).alias("d"), V.cosine(F.col("a"), F.col("b")).alias("c"), V.quantized(F.col("a")).alias("q"), V.hybrid_score((F.col("a"), F.lit(None).cast("array<double>")), (F.col("a"), F.col("b")), (F.col("a"), F.col("b"))).alias("h")).first()
    a, b = np.array([0.1, 0.2]), np.array([0.3, -0.1])
    assert math.isclose(r.d, math.acosh(1 + 2 * ((a - b) @ (a - b)) / ((1 - a @ a) * (1 - b @ b))), rel_tol=1e-9)
    assert math.isclose(r.c, a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and r.q.q == [64, 127] and r.h == 0.0


def test_heat_on_a_path():
    a = np.zeros((4, 4))
    for i in range(3):
        a[i, i + 1] = a[i + 1, i] = 1
    heat = numeric.chebyshev_heat(numeric.laplacian(a), 0.5)
    assert np.allclose(np.diag(heat), [0.64503527, 0.66448729, 0.66448729, 0.64503527], atol=1e-2)
    values, vectors = np.linalg.eigh(numeric.laplacian(a))
    assert np.allclose(heat, vectors @ np.diag(np.exp(-0.5 * values)) @ vectors.T, atol=1e-8)


def test_small_graphs(spark):
    rows = [("p", str(i), str(i + 1)) for i in range(3)] + [("c", "a", "b"), ("c", "b", "d"), ("c", "d", "a")]
    e = spark.createDataFrame(rows, "graph string, src string, dst string")
    counts = {(r.graph, r.dim): r["count"] for r in numeric.per_graph(e, "graph", numeric.persistence, "dim bigint, birth double, death double").groupBy("graph", "dim").count().collect()}
    assert counts == {("p", 0): 3, ("c", 0): 2, ("c", 1): 1}
    between = {r.node: r.value for r in numeric.per_graph(e.where("graph = 'p'"), "graph", numeric.betweenness, "node string, value double").collect()}
    assert between["0"] == 0 and math.isclose(between["1"], 2 / 3)
    orbit = {r.node: r.orbit for r in numeric.per_graph(e, "graph", numeric.orbits, "node string, orbit string").where("graph = 'p'").collect()}
    assert orbit == {"0": "0", "1": "1", "2": "1", "3": "0"}


def test_hyper_adamic_adar_and_percentile(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")], "e int, n string")
    found = {(r.u, r.v): r.score for r in hyper_adamic_adar(m, "e", "n").collect()}
    assert math.isclose(found[("a", "b")], 1 / math.log(2)) and math.isclose(found[("a", "c")], 1 / math.log(2))
    v = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 9)], "k string, v double")
    assert indexed_percentile(v, "k", "v", 0.95).first().value == 3.0
    budgets = spark.createDataFrame([("t", 0.1), ("t", 0.2)], "t string, e double")
    expected = min(math.log(sum(math.exp((a - 1) * e) for e in (0.1, 0.2))) / (a - 1) for a in range(2, 33))
    assert math.isclose(renyi_epsilon(budgets, "t", "e").first().epsilon, expected)


def test_power_iteration(spark):
    rng = np.random.default_rng(3)
    m = rng.random((6, 6))
    m = m + m.T
    rows = [(i, j, float(m[i, j])) for i in range(6) for j in range(6)]
    found = topology.power_iteration(spark.createDataFrame(rows, "i int, j int, v double"), 12).first()["lambda"]
    assert math.isclose(found, np.linalg.eigvalsh(m)[-1], rel_tol=1e-4)


def test_readers(spark, tmp_path):
    import zipfile

    from lodestrata.sources.readers import read_files

    (tmp_path / "a.html").write_text("<html><script>no</script><p>Hello <b>there</b></p><p>You</p></html>")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p></w:document>')
    (tmp_path / "e.docx").write_bytes(b"broken")
    found = {r.path.rsplit("/", 1)[1]: r.text for r in read_files(spark, str(tmp_path)).collect()}
    assert found == {"a.html": "Hello there\nYou", "b.txt": "plain", "c.bin": None, "d.docx": "One", "e.docx": None}


def test_sinks(spark, tmp_path):
    from lodestrata.sources import sinks

    pairs = spark.createDataFrame([(1, "Q", "A"), (2, None, "é")], "pos int, question string, answer string")
    assert sinks.jsonl(pairs, "pos").where("pos = 2").first().line == '{"pos":2,"answer":"é"}'
    sinks.write_partitioned(pairs, str(tmp_path / "out"), "me", "qa")
    assert spark.read.json(str(tmp_path / "out")).where("org_id = 'me' AND kind = 'qa'").count() == 2


def test_semantic_chunks():
    from lodestrata.operators.segments import semantic_chunks, summarized_chunks

    text = "The kiln was cold. The kiln was old. Ships sail far. Ships sail."
    assert semantic_chunks(text, 200) == ["The kiln was cold. The kiln was old", "Ships sail far. Ships sail"]
    assert semantic_chunks(text, 20) == ["The kiln was cold", "The kiln was old", "Ships sail far", "Ships sail"]
    assert summarized_chunks(text, 200, 2)[1] == "was old Ships sail far. Ships sail" and semantic_chunks(None, 9) == [] and semantic_chunks(" . ", 9) == []


def test_sounds(spark, tmp_path):
    import wave

    from lodestrata.operators.segments import read_sounds

    tone = (np.sin(np.arange(8000) / 40) * 9000).astype(np.int16)
    with wave.open(str(tmp_path / "a.wav"), "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(8000)
        file.writeframes(tone.tobytes())
    (tmp_path / "b.wav").write_bytes(b"no sound")
    found = {r.path[-5:]: r for r in read_sounds(spark, str(tmp_path)).collect()}
    assert found["a.wav"].valid and found["a.wav"].seconds == 1.0 and not found["b.wav"].valid and found["b.wav"].rate is None


def _operators(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_renyi_repeats_no_row_and_broadcasts_none(spark):
    budgets = spark.createDataFrame([("t", 0.3), ("t", 1.2), ("t", None), ("u", None), (None, 1.0), ("v", 800.0), ("v", 800.0), ("w", -2.0)], "t string, e double")
    frame = renyi_epsilon(budgets, "t", "e")
    said = _operators(frame)
    assert "Generate" not in said and "Broadcast" not in said
    found = {r.t: r.epsilon for r in frame.collect()}
    expected = min(math.log(math.exp((a - 1) * 0.3) + math.exp((a - 1) * 1.2)) / (a - 1) for a in range(2, 33))
    assert set(found) == {"t", "u", "v", "w"} and found["u"] is None and math.isclose(found["t"], expected)
    assert math.isclose(found["v"], 800 + math.log(2) / 31) and math.isclose(found["w"], -2.0)


def test_facts_are_found_once_for_their_edges(spark):
    texts = ["It is. Ada is the queen of France. x is y", "a is b is c. d is e.", "Bo was born in Rome. Bo is the  is z.", " is . q", "é is big. ok, he is the. Now it is the end.", "nothing", None]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "id string, text string")
    edges = fact_edges(fact_rows(chunks))
    assert "regexp_extract_all" not in _operators(edges)
    got = sorted((r.subject, r.predicate, r.object) for r in fact_rows(chunks).collect())
    want = [(s.strip(" "), p, o.strip(" ")) for t in texts if t for r, p in ((r"([A-Za-z ]+) is (?:the )?([A-Za-z ]+)\.", "is"), (r"([A-Za-z ]+) was born in ([A-Za-z ]+)\.", "born_in")) for s, o in re.findall(r, t)]
    assert got == sorted(want) and len(want) > 5
    assert edges.count() == 3 * len(want) + len(set(want))


@pytest.mark.parametrize("terms, queries", ((2_000_000, 4_000), (3, 4)))
def test_similar_texts_equal_the_join_and_shuffle_no_pair(spark, monkeypatch, terms, queries):
    monkeypatch.setattr(retrieval, "HELD_TERMS", terms)
    monkeypatch.setattr(retrieval, "HELD_QUERIES", queries)
    rng = np.random.default_rng(3)
    rows = [(f"k{i:03}", " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 12)) % 40)) for i in range(150)] + [("z1", None), ("z2", "w1 w1"), ("z3", "Ünik"), ("a0", "w1 W1")]
    texts = spark.createDataFrame(rows, "key string, text string").repartition(3)
    asked = texts.where("key LIKE '%0'").select(F.col("key").alias("query"))
    frame = retrieval.similar_texts(texts, asked, "key", "text", 3)
    assert "SortMergeJoin" not in (said := _operators(frame)) and "BroadcastHashJoin" not in said
    index = search.tfidf(texts, "key", "text")
    own = index.join(asked.withColumnRenamed("query", "key"), "key", "left_semi").select(F.col("key").alias("query"), "term", F.col("weight").alias("own"))
    scores = own.join(index, "term").where("query <> key").groupBy("query", "key").agg(F.round(F.sum(F.col("own") * F.col("weight")), 9).alias("score"))
    plain = lambda f: sorted((r.query, r["rank"], r.key, round(r.score, 7)) for r in f.collect())
    assert plain(frame) == plain(search.top_k(scores, "query", 3, "score", "key"))


def test_linked_sections_join_subjects_only(spark, small):
    from lodestrata.plans.elements import _facts, graph_linked_sections_by_entity
    from lodestrata.operators.elements import fact_sections

    frame = graph_linked_sections_by_entity(spark, small)
    said = _operators(frame)
    assert "regexp_extract_all" not in said and "under_section" not in said
    walked = _facts(spark, small)
    about = G.related(walked, "subject").select(F.col("src").alias("fact"), F.col("dst").alias("entity"))
    expected = G.co_mentions(fact_sections(walked).join(about, "fact"), "section", "entity")
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("block, least, few, names, a_row", ((12_000, 8, 500, 200_000, 4_000), (40, 8, 500, 50, 7), (500, 3, 10, 1, 1)))
def test_co_mentions_in_tiles_equal_the_join_and_shuffle_no_pair(spark, monkeypatch, block, least, few, names, a_row):
    for name, value in (("MEMBERS_A_BLOCK", block), ("LEAST_BLOCKS", least), ("FEW_MEMBERS", few), ("NAMES_AT_ONCE", names), ("PAIRS_A_ROW", a_row)):
        monkeypatch.setattr(G, name, value)
    rng = np.random.default_rng(5)
    rows = [(f"m{i}{'é' * (i % 3)}", f"g{g}") for i in range(300) for g in rng.zipf(1.4, rng.integers(1, 5)) % 50]
    rows += [("a", "g1"), ("a", "g1"), (None, "g1"), ("b", None), ("c", "alone"), ("", "g2"), ("z", ""), ("y", "")] + [(m, f"h{i}") for m in ("y", "z", "m7") for i in range(300)]
    pairs = spark.createDataFrame(rows, "member string, g string").repartition(3)
    frame = G.co_mentions_in_tiles(pairs, "member", "g")
    assert not {"SortMergeJoin", "BroadcastHashJoin", "HashAggregate"} & set(re.findall(r"\w+", _operators(frame)))
    expected = G.co_mentions(pairs, "member", "g")
    assert frame.dtypes == expected.dtypes
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, expected.collect()))
    assert G.co_mentions_in_tiles(pairs.where("g = 'none'"), "member", "g").count() == 0


def test_tiles_of_few_members_and_of_empty_blocks_repeat_no_pair(spark, monkeypatch):
    tile = lambda *sides: pa.table({"m": ["a", "b"], "groups": [["g"], ["g"]], "side": pa.array(sides, pa.int32())})
    found = lambda t: [(sources, int(shared), others.to_pylist()) for sources, shared, others in G._later(t)]
    assert found(tile(-1, -1)) == found(tile(1, 1)) == []
    assert found(tile(0, 0)) == found(tile(-1, 1)) == [([0], 1, ["b"])]
    monkeypatch.setattr(G, "MEMBERS_A_BLOCK", 1)
    pairs = spark.createDataFrame([(f"m{i}", g) for i in range(9) for g in ("all", f"g{i % 3}")], "member string, g string")
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(G.co_mentions_in_tiles(pairs, "member", "g")) == rows(G.co_mentions(pairs, "member", "g"))


def test_linked_sections_of_odd_documents_join_and_shuffle_no_pair(spark, tmp_path):
    from compare import duck, rows_of
    from lodestrata.plans.elements import ORACLES, graph_linked_sections_by_entity as linked

    texts = ["Gate\nThe gate is red.\r\nA map is here. The Gate has bars\n\nMap\nmap IS old.", "before is here.\nTitle is this\n- gate is big.\nthe gate likes it.", None, "", "Gate\nis is is. gate  is x. MAP has gate.", "no titles here, but a map is known to them, says a line that is long enough."]
    rows = [(i % 5, t) for i, t in enumerate(texts * 2)] + [(None, texts[0]), (1, texts[1]), (77, texts[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = linked(spark, str(tmp_path))
    assert not {"SortMergeJoin", "BroadcastHashJoin", "HashAggregate"} & set(re.findall(r"\w+", _operators(frame)))
    said = duck(str(tmp_path)).execute(ORACLES["graph_linked_sections_by_entity"])
    columns = [d[0] for d in said.description]
    assert (found := rows_of(frame.columns, frame.collect())) == rows_of(columns, said.fetchall()) and found
