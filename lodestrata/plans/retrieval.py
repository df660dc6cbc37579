"""Similarity of members of the graph, hybrid and two-stage search, retention by rank."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import elements as L
from lodestrata.operators import graph as G
from lodestrata.operators import retrieval as R
from lodestrata.operators import search as S
from lodestrata.plans.elements import _LF, _S
from lodestrata.plans.search import _COS, _V, _dot, _norm
from lodestrata.tables import chunk_nodes, table


def _chunk_vectors(spark, sf_dir):
    """The vector of each chunk node in the space of plain embeddings: of full length, finite, not all zero, each node's least."""
    rows = table(spark, sf_dir, "embedding").where("space = 'embedding' AND size(vec) = 64").select(F.col("node_id").alias("id"), V.as_double(F.col("vec")).alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _asked_chunks(spark, sf_dir):
    """Every fiftieth chunk node, by position."""
    first = chunk_nodes(spark, sf_dir).groupBy("id").agg(F.min("pos").alias("pos")).where("pos % 50 = 0")
    return _chunk_vectors(spark, sf_dir).join(first.select("id"), "id", "left_semi").select(F.col("id").alias("query"), F.col("v").alias("q"))


def _near_chunks(spark, sf_dir, k=5):
    return S.nearest(_asked_chunks(spark, sf_dir), _chunk_vectors(spark, sf_dir), k, "id", "v")


def graph_chunk_nearest(spark, sf_dir):
    """The chunks most similar to every fiftieth chunk."""
    return _near_chunks(spark, sf_dir).select("query", "id", F.round("score", 6).alias("score"), "rank")


def graph_chunk_nearest_data(spark, sf_dir):
    """The same with each neighbour's text and document."""
    text = G.distinct_nodes(table(spark, sf_dir, "nodes")).select("id", F.md5("text").alias("fingerprint"))
    owner = L.first_parent(table(spark, sf_dir, "edges"), "has_chunk").select(F.col("dst").alias("id"), F.col("src").alias("document"))
    near = _near_chunks(spark, sf_dir).select("query", "id", F.round("score", 6).alias("similarity"))
    return near.join(text, "id", "left").join(owner, "id", "left").select("query", "id", "similarity", "fingerprint", "document")


def graph_similar_links(spark, sf_dir):
    """similar_to edges from every fiftieth chunk to its neighbours, where no edge joins the two yet."""
    known = table(spark, sf_dir, "edges").select(F.col("src").alias("query"), F.col("dst").alias("id")).distinct()
    near = _near_chunks(spark, sf_dir).join(known, ["query", "id"], "left_anti")
    return near.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.lit("similar_to").alias("relation"), F.round("score", 6).alias("similarity"))


def _titles(spark, sf_dir):
    return L.section_nodes(L.section_lines(table(spark, sf_dir, "documents"))).select(F.col("id").alias("key"), "text")


def graph_similar_sections(spark, sf_dir):
    """Sections whose title is most like that of a fiftieth document's sections, by tf-idf."""
    titles = _titles(spark, sf_dir)
    asked = titles.where(F.regexp_extract("key", r"^d([0-9]+)_", 1).cast("bigint") % 50 == 0)
    return R.similar_texts(titles, asked.select(F.col("key").alias("query")), "key", "text", 3).select("query", "key", F.round("score", 6).alias("score"), "rank")


def graph_similar_documents(spark, sf_dir):
    """Documents whose text is most like that of every fiftieth document, by tf-idf."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text")
    return R.similar_texts(docs, docs.where("key % 50 = 0").select(F.col("key").alias("query")), "key", "text", 3).select("query", "key", F.round("score", 6).alias("score"), "rank")


def search_lexical_then_vectors(spark, sf_dir):
    """For every fiftieth chunk: chunks of its document first, in order, then its nearest vectors; each once, five in all."""
    members = G.members_in_order(table(spark, sf_dir, "edges"), "has_chunk")
    own = members.select("src", F.col("dst").alias("query"))
    asked = _asked_chunks(spark, sf_dir).select("query")
    first = asked.join(own, "query").join(members.select("src", F.col("dst").alias("id"), "n"), "src").where("id <> query").select("query", "id", F.lit(0).alias("stage"), "n")
    second = _near_chunks(spark, sf_dir).select("query", "id", F.lit(1).alias("stage"), F.col("rank").alias("n"))
    return R.staged(first.unionByName(second), "query", "id", 5)


def _views(spark, sf_dir):
    """Three views of each vector: 24 and 20 numbers, and 20 shrunk into the ball."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    return rows.select("vec_id", "v", F.slice("v", 1, 24).alias("a"), F.slice("v", 25, 20).alias("b"), F.transform(F.slice("v", 45, 20), lambda x: x / 4).alias("c"))


def search_hybrid_reranked(spark, sf_dir):
    """Fifty nearest by the first view, ranked again by the hybrid score: five of every fiftieth vector."""
    rows = _views(spark, sf_dir)
    asked = rows.where("vec_id % 50 = 0")
    coarse = S.nearest(asked.select(F.col("vec_id").alias("query"), F.col("a").alias("q")), rows, 50, "vec_id", "a").select("query", "vec_id")
    met = coarse.join(rows.drop("v"), "vec_id").join(asked.select(F.col("vec_id").alias("query"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2")), "query")
    score = V.hybrid_score((F.col("a"), F.col("a2")), (F.col("b"), F.col("b2")), (F.col("c"), F.col("c2")))
    return S.top_k(met.select("query", "vec_id", F.round(score, 9).alias("score")), "query", 5, "score", "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def search_hybrid_of_label(spark, sf_dir):
    """The same score over all vectors of the query's label, for every fiftieth vector."""
    rows = _views(spark, sf_dir).drop("v").join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"))
    score = V.hybrid_score((F.col("a"), F.col("a2")), (F.col("b"), F.col("b2")), (F.col("c"), F.col("c2")))
    met = rows.join(asked, "label").where("vec_id <> query").select("query", "vec_id", F.round(score, 9).alias("score"))
    return S.top_k(met, "query", 3, "score", "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def search_quantized_reranked(spark, sf_dir):
    """Fifty nearest among eight-bit vectors, ranked again by the vectors themselves: five of every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    coded = rows.withColumn("w", V.as_double(V.quantized(F.col("v"))["q"]))
    asked = coded.where("vec_id % 50 = 0")
    coarse = S.nearest(asked.select(F.col("vec_id").alias("query"), F.col("w").alias("q")), coded, 50, "vec_id", "w").select("query", "vec_id")
    return R.reranked(coarse, asked.select(F.col("vec_id").alias("query"), F.col("v").alias("q")), rows, "vec_id", "v", 5).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def search_seeded_walk(spark, sf_dir):
    """Nodes one edge away from the nearest chunks of every fiftieth chunk."""
    links = G.distinct_edges(table(spark, sf_dir, "edges")).select(F.col("src").alias("id"), "dst", "relation")
    return _near_chunks(spark, sf_dir, 3).select("query", "id").join(links, "id").select("query", F.col("id").alias("seed"), "relation", "dst").distinct()


def search_neighbourhood(spark, sf_dir):
    """Nodes within two steps of every fiftieth chunk, by whatever relation but has_chunk."""
    seeds = chunk_nodes(spark, sf_dir).groupBy("id").agg(F.min("pos").alias("pos")).where("pos % 50 = 0").select("id")
    return G.expanded(seeds, table(spark, sf_dir, "edges"), 2, ("next_chunk", "similar_to", "mentions"))


def vector_probe_curve(spark, sf_dir):
    """Recall at five of every fiftieth vector when so many first candidates of the eight-bit vectors are ranked again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    coded = rows.withColumn("w", V.as_double(V.pruned(F.col("v"), 0.25)))
    asked = coded.where("vec_id % 50 = 0")
    coarse = S.nearest(asked.select(F.col("vec_id").alias("query"), F.col("w").alias("q")), coded, 40, "vec_id", "w").select("query", "vec_id", "rank")
    exact = S.nearest(asked.select(F.col("vec_id").alias("query"), F.col("v").alias("q")), rows, 5, "vec_id", "v").select("query", "vec_id")
    return R.probe_curve(coarse, exact, "vec_id", [5, 10, 20, 40], 5).select("probes", F.round("recall", 6).alias("recall"))


def vector_probes_needed(spark, sf_dir):
    """The fewest probes that reach a recall of 0.8, or the most there are."""
    return R.least_reaching(vector_probe_curve(spark, sf_dir), "probes", "recall", 0.8)


def keep_best_checkpoints(spark, sf_dir):
    """Events of each user beyond the newest three and older than a day before the last: what a clean-up deletes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = rows.agg(F.max("us").alias("now"))
    return R.beyond_newest(rows.crossJoin(F.broadcast(now)), "user_id", ["us", "event_id"], 3).where("us < now - 86400000000").select("user_id", "event_id")


def keep_best_values(spark, sf_dir):
    """The three best values of each user so far, as a run keeps its best checkpoints."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", "event_id", "value")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("n <= 3").select("user_id", "event_id", "n")


def fold_early_stop(spark, sf_dir):
    """Where each user's values had not improved for five steps."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", "event_id", "value")
    return R.early_stops(rows, "user_id", "event_id", "value", 5)


def search_diverse_facts(spark, sf_dir):
    """For each subject the fact whose chunk states most: one fact a group, those of chunks with many first."""
    facts = L.triplet_facts(L.line_chunks(L.section_lines(table(spark, sf_dir, "documents"))))
    degree = facts.groupBy("chunk").agg(F.count("*").alias("degree"))
    ranked = facts.join(degree, "chunk").withColumn("n", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("degree"), "id")))
    return ranked.where("n = 1").select("subject", "id", "degree")


QUERIES = {
    f.__name__: f
    for f in (
        graph_chunk_nearest, graph_chunk_nearest_data, graph_similar_links, graph_similar_sections, graph_similar_documents, search_lexical_then_vectors, search_hybrid_reranked, search_hybrid_of_label, search_quantized_reranked,
        search_seeded_walk, search_neighbourhood, vector_probe_curve, vector_probes_needed, keep_best_checkpoints, keep_best_values, fold_early_stop, search_diverse_facts,
    )
}

_CV = f"""cv AS (SELECT node_id AS id, min(vec::DOUBLE[]) AS v FROM embedding WHERE space = 'embedding' AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY 1),
asked AS (SELECT id FROM nodes WHERE lower(type) = 'chunk' GROUP BY 1 HAVING min(pos) % 50 = 0),
sc AS (SELECT a.id AS query, b.id, {_COS} AS score FROM cv a JOIN cv b ON a.id <> b.id WHERE a.id IN (SELECT id FROM asked)),
nr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc),
dn AS (SELECT id, arg_min({{'v': lower(type)}}, pos).v AS type, arg_min({{'v': text}}, pos).v AS text FROM nodes GROUP BY id),
hp AS (SELECT src, dst, min(sequence) AS sequence FROM edges WHERE lower(relation) = 'has_chunk' GROUP BY 1, 2),
hc AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sequence NULLS LAST, dst) - 1 AS n FROM hp)"""


def _tfidf(rows):
    """Terms of ``rows`` (key, text) with their weights, as ``i``."""
    return rf"""q AS ({rows}), c AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(regexp_extract_all(lower(text), '([\pL\pN\pM_]{{2,}})', 1)) AS term FROM q) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT key, c.term, tf * (ln((1 + (SELECT count(DISTINCT key) FROM q)) / (1 + df)) + 1) AS w FROM c JOIN d ON d.term = c.term),
i AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM w)"""


_SIMILAR = "sm AS (SELECT a.key AS query, b.key, round(sum(a.weight * b.weight), 9) AS score FROM i a JOIN i b ON a.term = b.term AND a.key <> b.key WHERE {asked} GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM sm) SELECT query, key, round(score, 6) AS score, rank FROM rk WHERE rank <= 3"
_FIFTIETH = "regexp_extract(a.key, '^d([0-9]+)_', 1)::BIGINT % 50 = 0"
_VIEWS = f"{_V}, p AS (SELECT vec_id, label, v, v[1:24] AS a, v[25:44] AS b, list_transform(v[45:64], lambda x: x / 4) AS c FROM v)"


def _hybrid(x, y):
    square = f"list_sum(list_transform(list_zip({x}.c, {y}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    z = f"(1 + 2 * {square} / ((1 - {_dot(x + '.c', x + '.c')}) * (1 - {_dot(y + '.c', y + '.c')}) + 1e-9))"
    cos = lambda v: f"{_dot(f'{x}.{v}', f'{y}.{v}')} / ({_norm(f'{x}.{v}')} * {_norm(f'{y}.{v}')} + 1e-9)"
    return f"round(0.5 * {cos('a')} + 0.25 * (1 - ln({z} + sqrt({z} * {z} - 1))) + 0.25 * (1 - {cos('b')}), 9)"


_CODED = f"{_V}, s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM v), w AS (SELECT vec_id, v, list_transform(v, lambda x: round_even(x / CASE WHEN m = 0 THEN 1.0 ELSE m END * 127, 0)::DOUBLE) AS w FROM s)"
_COSW = f"{_dot('a.w', 'b.w')} / ({_norm('a.w')} * {_norm('b.w')})"
_CURVE = f"""{_V}, t AS (SELECT vec_id, v, list_reverse_sort(list_transform(v, lambda x: abs(x)))[floor(len(v) * 0.25)::INT] AS least FROM v),
w AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN abs(x) >= least THEN x ELSE 0 END) AS w FROM t),
co AS (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSW} DESC, b.vec_id) AS rank FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ex AS (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
cu AS (SELECT probes, round(count(co.vec_id) / count(*), 6) AS recall FROM (SELECT * FROM ex WHERE rank <= 5) ex CROSS JOIN (VALUES (5), (10), (20), (40)) p(probes) LEFT JOIN co ON co.query = ex.query AND co.vec_id = ex.vec_id AND co.rank <= probes GROUP BY 1)"""

ORACLES = {
    "graph_chunk_nearest": f"WITH {_CV} SELECT query, id, round(score, 6) AS score, rank FROM nr WHERE rank <= 5",
    "graph_chunk_nearest_data": f"WITH {_CV} SELECT query, nr.id, round(score, 6) AS similarity, md5(text) AS fingerprint, src AS document FROM nr LEFT JOIN dn ON dn.id = nr.id LEFT JOIN (SELECT dst, min(src) AS src FROM hp GROUP BY 1) h ON h.dst = nr.id WHERE rank <= 5",
    "graph_similar_links": f"WITH {_CV} SELECT query AS src, id AS dst, 'similar_to' AS relation, round(score, 6) AS similarity FROM nr WHERE rank <= 5 AND (query, id) NOT IN (SELECT (src, dst) FROM edges)",
    "graph_similar_sections": f"WITH {_S}, {_tfidf('SELECT section AS key, text FROM t')}, {_SIMILAR.format(asked=_FIFTIETH)}",
    "graph_similar_documents": f"WITH {_tfidf('SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL')}, {_SIMILAR.format(asked='a.key % 50 = 0')}",
    "search_lexical_then_vectors": f"WITH {_CV}, u AS (SELECT x.dst AS query, y.dst AS id, 0 AS stage, y.n FROM hc x JOIN hc y ON y.src = x.src AND y.dst <> x.dst WHERE x.dst IN (SELECT id FROM asked) AND x.dst IN (SELECT id FROM cv) UNION ALL SELECT query, id, 1, rank FROM nr WHERE rank <= 5), m AS (SELECT query, id, min({{'s': stage, 'n': n}}) AS o FROM u GROUP BY 1, 2) SELECT query, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o, id) AS rank FROM m) WHERE rank <= 5",
    "search_hybrid_reranked": f"WITH {_VIEWS}, co AS (SELECT a.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_dot('a.a', 'b.a')} / ({_norm('a.a')} * {_norm('b.a')}) DESC, b.vec_id) AS n FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), s AS (SELECT query, co.vec_id, {_hybrid('x', 'y')} AS score FROM co JOIN p x ON x.vec_id = co.vec_id JOIN p y ON y.vec_id = query WHERE n <= 50), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "search_hybrid_of_label": f"WITH {_VIEWS}, s AS (SELECT y.vec_id AS query, x.vec_id, {_hybrid('x', 'y')} AS score FROM p x JOIN p y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE y.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3",
    "search_quantized_reranked": f"WITH {_CODED}, co AS (SELECT a.vec_id AS query, b.vec_id, a.v AS va, b.v AS vb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSW} DESC, b.vec_id) AS n FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), z AS (SELECT query, vec_id, {_dot('va', 'vb')} / ({_norm('va')} * {_norm('vb')}) AS score FROM co WHERE n <= 50), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM z) SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
    "search_seeded_walk": f"WITH {_CV} SELECT DISTINCT query, id AS seed, lower(relation) AS relation, dst FROM nr JOIN edges ON src = id WHERE rank <= 3",
    "search_neighbourhood": f"WITH asked AS (SELECT id FROM nodes WHERE lower(type) = 'chunk' GROUP BY 1 HAVING min(pos) % 50 = 0), lk AS (SELECT src AS a, dst AS b FROM edges WHERE lower(relation) IN ('next_chunk', 'similar_to', 'mentions') UNION SELECT dst, src FROM edges WHERE lower(relation) IN ('next_chunk', 'similar_to', 'mentions')) SELECT seed, id, min(depth)::INT AS depth FROM (SELECT id AS seed, id, 0 AS depth FROM asked UNION ALL SELECT id, b, 1 FROM asked JOIN lk ON a = id UNION ALL SELECT id, y.b, 2 FROM asked JOIN lk x ON x.a = id JOIN lk y ON y.a = x.b) GROUP BY 1, 2",
    "vector_probe_curve": f"WITH {_CURVE} SELECT probes, recall FROM cu",
    "vector_probes_needed": f"WITH {_CURVE} SELECT coalesce(min(probes) FILTER (recall >= 0.8), max(probes)) AS probes FROM cu",
    "keep_best_checkpoints": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC NULLS LAST, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n > 3 AND epoch_us(ts) < (SELECT max(epoch_us(ts)) FROM events) - 86400000000",
    "keep_best_values": "SELECT user_id, event_id, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 3",
    "fold_early_stop": "WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events WHERE value IS NOT NULL), f AS (SELECT *, min(i) OVER (PARTITION BY user_id, best) AS since FROM e) SELECT user_id, min(event_id) AS stopped FROM f WHERE i - since >= 5 GROUP BY 1",
    "search_diverse_facts": f"WITH {_LF}, dg AS (SELECT chunk, count(*) AS degree FROM f GROUP BY 1) SELECT subject, id, degree FROM (SELECT subject, fact AS id, degree, row_number() OVER (PARTITION BY subject ORDER BY degree DESC, fact) AS n FROM f JOIN dg USING (chunk)) WHERE n = 1",
}
