"""Search, vectors, deduplication, folds, samples and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.functions.text import normalized
from lodestrata.operators import graph as G
from lodestrata.operators import greedy, sampling
from lodestrata.operators import search as S
from lodestrata.plans.sqltext import clean
from lodestrata.sources import sinks
from lodestrata.tables import chunk_nodes, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q"))


def vector_top_k(spark, sf_dir):
    """Exact cosine neighbours of every fiftieth vector among all."""
    return S.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 5, "vec_id", "v").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_top_k_inner(spark, sf_dir):
    return S.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 5, "vec_id", "v", "dot").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_hyperbolic_neighbours(spark, sf_dir):
    """Poincaré neighbours of vectors shrunk into the ball."""
    inside = F.transform("v", lambda x: x / 4)
    rows = _vectors(spark, sf_dir).withColumn("v", inside)
    asked = _asked(spark, sf_dir).withColumn("q", F.transform("q", lambda x: x / 4))
    return S.nearest(asked, rows, 3, "vec_id", "v", "poincare").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_neighbours_of_label(spark, sf_dir):
    """Five nearest, then only those of the query's label: may be fewer."""
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    found = S.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 5, "vec_id", "v").join(labels, "vec_id")
    return found.join(labels.select(F.col("vec_id").alias("query"), "label"), ["query", "label"]).select("query", "vec_id", "rank")


def vector_hybrid(spark, sf_dir):
    """Hybrid score of vectors with their neighbour by id: halves of the vector as the three views."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 24).alias("a"), F.slice("v", 25, 20).alias("b"), F.transform(F.slice("v", 45, 20), lambda x: x / 4).alias("c"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("c").alias("c2"))
    score = V.hybrid_score((F.col("a"), F.col("a2")), (F.col("b"), F.col("b2")), (F.col("c"), F.col("c2")))
    return rows.join(other, "vec_id").select("vec_id", F.round(score, 6).alias("score"))


def vector_recall(spark, sf_dir):
    """Recall at ten of vectors of the same label."""
    from lodestrata.operators.measures import recall_at_k

    found = S.nearest(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10, "vec_id", "v").select("query", F.col("vec_id").alias("item"), "rank")
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    truth = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label").join(labels.select(F.col("vec_id").alias("item"), "label"), "label").where("item <> query").select("query", "item")
    return recall_at_k(found, truth, 10).select(F.round("recall", 6).alias("recall"))


def vector_quantized(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("z", V.quantized(F.col("v")))
    return rows.select("vec_id", F.round("z.scale", 6).alias("scale"), F.aggregate("z.q", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.round(V.squared_distance(F.col("v"), V.dequantized(F.col("z"))), 6).alias("loss"))


def vector_pruned(spark, sf_dir):
    kept = V.pruned(F.col("v"), 0.25)
    return _vectors(spark, sf_dir).select("vec_id", F.size(F.filter(kept, lambda x: x != 0)).alias("kept"), F.round(V.norm(kept), 6).alias("norm"))


def vector_mobius(spark, sf_dir):
    """Radius of the Möbius sum of each shrunk vector with itself."""
    x = F.transform("v", lambda y: y / 4)
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.hyperbolic_radius(V.clamped_to_ball(V.mobius_sum(x, x))), 5).alias("radius"))


def vector_product(spark, sf_dir):
    joined = F.concat(F.transform("v", lambda y: y / 4), F.col("v"))
    return _vectors(spark, sf_dir).select("vec_id", F.size(joined).alias("dimensions"), F.round(V.norm(joined), 6).alias("norm"))


def vector_export_rows(spark, sf_dir):
    """Long rows (node, space, dimensions) as vector stores load them."""
    rows = table(spark, sf_dir, "embedding").where("vec IS NOT NULL AND size(vec) > 0")
    return rows.groupBy("space", F.coalesce("version", F.lit("none")).alias("version"), F.size("vec").alias("dimensions")).agg(F.count("*").alias("n"))


def text_tfidf(spark, sf_dir):
    pairs = table(spark, sf_dir, "qa").where("question IS NOT NULL").select("pos", "question")
    return S.tfidf(pairs, "pos", "question").select("pos", "term", F.round("weight", 6).alias("weight"))


def text_lexical_top_k(spark, sf_dir):
    """Questions most like the first words of each test item, by tf-idf."""
    pairs = table(spark, sf_dir, "qa").where("question IS NOT NULL").select("pos", "question")
    asked = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query"), "text")
    scores = S.lexical_scores(S.tfidf(pairs, "pos", "question"), asked, "pos").withColumn("score", F.round("score", 6))
    return S.top_k(scores, "query", 5, "score", "pos").select("query", "pos", "score", "rank")


def dedup_exact_chunks(spark, sf_dir):
    """The first chunk of each normalised text."""
    rows = chunk_nodes(spark, sf_dir).where("text IS NOT NULL").select(F.md5(normalized(F.col("text"))).alias("fingerprint"), "pos", "id")
    return S.first_seen(rows, ["fingerprint"], ["pos"])


def dedup_exact_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "qa").select("question", "answer", "pos")
    return S.first_seen(rows, ["question", "answer"], ["pos"]).select("pos")


def dedup_similar_pairs(spark, sf_dir):
    return greedy.similar_pairs_dropped(table(spark, sf_dir, "qa").select("pos", "question", "answer"), 0.9).select("pos")


def keep_newest_versions(spark, sf_dir):
    """The newest three documents of each source, by time and id."""
    order = Window.partitionBy("source").orderBy(F.desc_nulls_last("ingested_at"), F.desc("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(order)).where("n <= 3").select("source", "doc_id", "n")


def fold_ewma(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return greedy.ewma_drift(rows, "user_id", ["event_id"], "value").select("event_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "alert")


def fold_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value").where("value IS NOT NULL").withColumn("at", F.col("us") / 1e6)
    return greedy.sliding_budget(rows, "user_id", ["us", "event_id"], "at", "value", 60.0).select("event_id", "accepted", F.round("remaining", 6).alias("remaining"))


def fold_token_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double").alias("now"))
    return greedy.token_bucket(rows, "event_type", ["event_id"], "now", 0.01, 3.0).select("event_id", "admitted")


def fold_anchored_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "edges_in").where("ts IS NOT NULL").select("src", "arrival", (F.unix_micros("ts") / 1e6).alias("s"))
    return greedy.anchored_windows(rows, "src", ["s", "arrival"], "s", 30.0).groupBy("src").agg(F.max("window").alias("windows"), F.count("*").alias("events"))


def fold_merged_points(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("w", F.slice("v", 1, 2))
    return greedy.merged_points(rows, "label", "vec_id", "w", 0.05).select("vec_id", "label", "cluster")


def sample_quota_counts(spark, sf_dir):
    ratios = {"click": 0.5, "error": 0.3, "view": 0.2}
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_sample(rows, "event_id", "event_type", 1000, ratios).groupBy("event_type").agg(F.count("*").alias("n"))


def sample_randomized(spark, sf_dir):
    """How many of each type remain after randomised answers (a property, so no SQL)."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.randomized_response(rows, "event_type", ["click", "view", "error"], 3, "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


def sample_variants(spark, sf_dir):
    words = {"report": ["account", "statement"], "list": ["roll"], "late": ["tardy", "overdue", "delayed"]}
    rows = table(spark, sf_dir, "qa").where("question IS NOT NULL").select("pos", F.posexplode(sampling.synonym_variants(F.col("question"), words, 2)).alias("n", "variant"))
    return rows


def export_jsonl(spark, sf_dir):
    return sinks.jsonl(table(spark, sf_dir, "qa").select("pos", "question", "answer"), "pos")


def export_alpaca(spark, sf_dir):
    return sinks.alpaca(table(spark, sf_dir, "qa"), "pos")


def export_chatml(spark, sf_dir):
    return sinks.chat(table(spark, sf_dir, "qa"), "pos", sinks.CHATML_SYSTEM)


def export_fine_tuning(spark, sf_dir):
    return sinks.chat(table(spark, sf_dir, "qa"), "pos", sinks.FINE_TUNING_SYSTEM)


def export_sft(spark, sf_dir):
    return sinks.sft(table(spark, sf_dir, "qa"), "pos")


def export_conversations(spark, sf_dir):
    """Turns of each pair's conversation, a row each."""
    turns = F.posexplode(sinks.messages(F.col("question"), F.col("answer"), sinks.FINE_TUNING_SYSTEM))
    return table(spark, sf_dir, "qa").select("pos", turns.alias("turn", "m")).select("pos", "turn", "m.role", "m.content")


QUERIES = {
    f.__name__: f
    for f in (
        vector_top_k, vector_top_k_inner, vector_hyperbolic_neighbours, vector_neighbours_of_label, vector_hybrid, vector_recall, vector_quantized, vector_pruned, vector_mobius, vector_product, vector_export_rows,
        text_tfidf, text_lexical_top_k, dedup_exact_chunks, dedup_exact_pairs, dedup_similar_pairs, keep_newest_versions, fold_ewma, fold_budget, fold_token_bucket, fold_anchored_windows, fold_merged_points,
        sample_quota_counts, sample_randomized, sample_variants, export_jsonl, export_alpaca, export_chatml, export_fine_tuning, export_sft, export_conversations,
    )
}

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _dot(a, b):
    return _DOT.format(a=a, b=b)


def _norm(a):
    return f"sqrt({_dot(a, a)})"


def _neighbours(score, k, order="DESC", select="query, vec_id, round(score, 6) AS score, rank::INT AS rank", more=""):
    return f"WITH {_V}, s AS (SELECT a.vec_id AS query, a.label AS ql, b.vec_id, b.label, {score} AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score {order}, vec_id) AS rank FROM s) SELECT {select} FROM r WHERE rank <= {k} {more}"


_COS = f"{_dot('a.v', 'b.v')} / ({_norm('a.v')} * {_norm('b.v')})"
_BALL_X = f"(1 + 2 * ({_SQ.format(a='a.v', b='b.v')} / 16) / ((1 - {_dot('a.v', 'a.v')} / 16) * (1 - {_dot('b.v', 'b.v')} / 16)))"
_TF = r"""
q AS (SELECT pos, lower(question) AS t FROM qa WHERE question IS NOT NULL),
c AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(regexp_extract_all(t, '([\pL\pN\pM_]{2,})', 1)) AS term FROM q) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
w AS (SELECT pos, c.term, tf * (ln((1 + (SELECT count(*) FROM q)) / (1 + df)) + 1) AS w FROM c JOIN d ON d.term = c.term),
i AS (SELECT pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY pos)) AS weight FROM w)"""
_SYSTEM = "{{'role': 'system', 'content': '{s}'}}"


def _messages(system):
    return f"to_json({{'messages': [{{'role': 'system', 'content': '{system}'}}, {{'role': 'user', 'content': coalesce(question, '')}}, {{'role': 'assistant', 'content': coalesce(answer, '')}}]}})::VARCHAR"


ORACLES = {
    "vector_top_k": _neighbours(_COS, 5),
    "vector_top_k_inner": _neighbours(_dot("a.v", "b.v"), 5),
    "vector_hyperbolic_neighbours": _neighbours(f"ln({_BALL_X} + sqrt({_BALL_X} * {_BALL_X} - 1))", 3, "ASC"),
    "vector_neighbours_of_label": _neighbours(_COS, 5, select="query, vec_id, rank::INT AS rank", more="AND ql = label"),
    "vector_recall": f"WITH {_V}, s AS (SELECT a.vec_id AS query, a.label AS ql, b.vec_id, b.label, {_COS} AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT round(avg(h / n), 6) AS recall FROM (SELECT query, count(*) FILTER (rank <= 10 AND ql = label) AS h, count(*) FILTER (ql = label) AS n FROM r GROUP BY 1 HAVING count(*) FILTER (ql = label) > 0)",
    "vector_hybrid": f"WITH {_V}, p AS (SELECT vec_id, v[1:24] AS a, v[25:44] AS b, list_transform(v[45:64], lambda x: x / 4) AS c FROM v), j AS (SELECT x.vec_id, x.a, x.b, x.c, y.a AS a2, y.b AS b2, y.c AS c2 FROM p x JOIN p y ON y.vec_id = x.vec_id + 1), h AS (SELECT *, 1 + 2 * {_SQ.format(a='c', b='c2')} / ((1 - {_dot('c', 'c')}) * (1 - {_dot('c2', 'c2')}) + 1e-9) AS z FROM j) SELECT vec_id, round(0.5 * {_dot('a', 'a2')} / ({_norm('a')} * {_norm('a2')} + 1e-9) + 0.25 * (1 - ln(z + sqrt(z * z - 1))) + 0.25 * (1 - {_dot('b', 'b2')} / ({_norm('b')} * {_norm('b2')} + 1e-9)), 6) AS score FROM h",
    "vector_quantized": f"WITH {_V}, s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM v), q AS (SELECT vec_id, v, CASE WHEN m = 0 THEN 1.0 ELSE m END AS s FROM s), z AS (SELECT *, list_transform(v, lambda x: round_even(x / s * 127, 0)::INT) AS q FROM q) SELECT vec_id, round(s, 6) AS scale, list_sum(q)::BIGINT AS total, round({_SQ.format(a='v', b='list_transform(q, lambda x: x * s / 127)')}, 6) AS loss FROM z",
    "vector_pruned": f"WITH {_V}, s AS (SELECT vec_id, v, list_reverse_sort(list_transform(v, lambda x: abs(x)))[floor(len(v) * 0.25)::INT] AS least FROM v) SELECT vec_id, len(list_filter(v, lambda x: abs(x) >= least))::INT AS kept, round(sqrt(list_sum(list_transform(list_filter(v, lambda x: abs(x) >= least), lambda x: x * x))), 6) AS norm FROM s",
    "vector_mobius": f"WITH {_V}, n AS (SELECT vec_id, {_dot('v', 'v')} / 16 AS q FROM v), r AS (SELECT vec_id, least(sqrt(q) * 2 / (1 + q), CASE WHEN sqrt(q) * 2 / (1 + q) >= 1 - 1e-6 THEN 1 - 1e-6 ELSE 1 END) AS z FROM n) SELECT vec_id, round(ln((1 + z) / (1 - z)), 5) AS radius FROM r",
    "vector_product": f"WITH {_V} SELECT vec_id, (2 * len(v))::INT AS dimensions, round(sqrt({_dot('v', 'v')} * (1 + 1 / 16.0)), 6) AS norm FROM v",
    "vector_export_rows": "SELECT space, coalesce(version, 'none') AS version, len(vec)::INT AS dimensions, count(*) AS n FROM embedding WHERE len(vec) > 0 GROUP BY 1, 2, 3",
    "text_tfidf": f"WITH {_TF} SELECT pos, term, round(weight, 6) AS weight FROM i",
    "text_lexical_top_k": f"WITH {_TF}, a AS (SELECT query, term, count(*) AS tf FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '([\\pL\\pN\\pM_]{{2,}})', 1)) AS term FROM eval_items) GROUP BY 1, 2), s AS (SELECT query, pos, round(sum(weight * tf), 6) AS score FROM i JOIN a ON a.term = i.term GROUP BY 1, 2) SELECT query, pos, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM s) WHERE rank <= 5",
    "dedup_exact_chunks": f"SELECT fingerprint, pos, id FROM (SELECT md5(lower({clean('text')})) AS fingerprint, pos, id, row_number() OVER (PARTITION BY lower({clean('text')}) ORDER BY pos) AS n FROM nodes WHERE lower(type) = 'chunk' AND text IS NOT NULL) WHERE n = 1",
    "dedup_exact_pairs": "SELECT min(pos) AS pos FROM qa GROUP BY question, answer",
    "keep_newest_versions": "SELECT source, doc_id, n::INT AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ingested_at DESC NULLS LAST, doc_id DESC) AS n FROM documents) WHERE n <= 3",
    "fold_ewma": "WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL), f AS (SELECT user_id, event_id, i, value AS mu, 0.0::DOUBLE AS sigma, false AS alert FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, 0.2::DOUBLE * value + 0.8::DOUBLE * mu, sqrt(0.2::DOUBLE * pow(value - (0.2::DOUBLE * value + 0.8::DOUBLE * mu), 2) + 0.8::DOUBLE * sigma * sigma), value > (0.2::DOUBLE * value + 0.8::DOUBLE * mu) + 3 * sqrt(0.2::DOUBLE * pow(value - (0.2::DOUBLE * value + 0.8::DOUBLE * mu), 2) + 0.8::DOUBLE * sigma * sigma) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, alert FROM f",
    "fold_budget": "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events WHERE value IS NOT NULL), f AS (SELECT user_id, event_id, i, value <= 60 AS accepted, CASE WHEN value <= 60 THEN [{'t': t, 'v': value}] ELSE [] END AS w FROM e WHERE i = 1 UNION ALL SELECT user_id, event_id, i, ok, CASE WHEN ok THEN list_append(w, {'t': t, 'v': value}) ELSE w END FROM (SELECT *, coalesce(list_sum(list_transform(w, lambda x: x.v)), 0) + value <= 60 AS ok FROM (SELECT e.user_id, e.event_id, e.i, e.t, e.value, list_filter(f.w, lambda x: x.t > e.t - 86400) AS w FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))) SELECT event_id, accepted, round(60 - coalesce(list_sum(list_transform(w, lambda x: x.v)), 0), 6) AS remaining FROM f",
    "fold_token_bucket": "WITH RECURSIVE e AS (SELECT event_type, event_id, floor(epoch_us(ts) / 1e6)::DOUBLE AS now, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), f AS (SELECT event_type, event_id, i, now, 2.0::DOUBLE AS tokens, true AS admitted FROM e WHERE i = 1 UNION ALL SELECT e.event_type, e.event_id, e.i, e.now, least(3.0, f.tokens + greatest(0.0, e.now - f.now) * 0.01::DOUBLE) - CASE WHEN least(3.0, f.tokens + greatest(0.0, e.now - f.now) * 0.01::DOUBLE) >= 1 THEN 1 ELSE 0 END, least(3.0, f.tokens + greatest(0.0, e.now - f.now) * 0.01::DOUBLE) >= 1 FROM f JOIN e ON e.event_type = f.event_type AND e.i = f.i + 1) SELECT event_id, admitted FROM f",
    "fold_anchored_windows": "WITH RECURSIVE e AS (SELECT src, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY src ORDER BY epoch_us(ts), arrival) AS i FROM edges_in WHERE ts IS NOT NULL), f AS (SELECT src, i, t, t AS start, 0::BIGINT AS n FROM e WHERE i = 1 UNION ALL SELECT e.src, e.i, e.t, CASE WHEN e.t - f.start >= 30 THEN e.t ELSE f.start END, f.n + (e.t - f.start >= 30)::INT FROM f JOIN e ON e.src = f.src AND e.i = f.i + 1) SELECT src, max(n) AS windows, count(*) AS events FROM f GROUP BY 1",
    "sample_quota_counts": "SELECT event_type, least(count(*), CASE event_type WHEN 'click' THEN 500 WHEN 'error' THEN 300 ELSE 200 END) AS n FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1",
    "export_jsonl": "SELECT pos, to_json({'pos': pos, 'question': question, 'answer': answer})::VARCHAR AS line FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL UNION ALL SELECT pos, to_json({'pos': pos, 'question': question})::VARCHAR FROM qa WHERE question IS NOT NULL AND answer IS NULL UNION ALL SELECT pos, to_json({'pos': pos, 'answer': answer})::VARCHAR FROM qa WHERE question IS NULL AND answer IS NOT NULL UNION ALL SELECT pos, to_json({'pos': pos})::VARCHAR FROM qa WHERE question IS NULL AND answer IS NULL",
    "export_alpaca": "SELECT pos, to_json({'instruction': coalesce(question, ''), 'input': '', 'output': coalesce(answer, '')})::VARCHAR AS line FROM qa",
    "export_chatml": f"SELECT pos, {_messages('You are a helpful AI assistant.')} AS line FROM qa",
    "export_fine_tuning": f"SELECT pos, {_messages('You are a helpful assistant.')} AS line FROM qa",
    "export_sft": "SELECT pos, coalesce(question, '') AS prompt, coalesce(question, '') || chr(10) || coalesce(answer, '') || '<eos>' AS text FROM qa",
    "export_conversations": "SELECT pos, 0 AS turn, 'system' AS role, 'You are a helpful assistant.' AS content FROM qa UNION ALL SELECT pos, 1, 'user', coalesce(question, '') FROM qa UNION ALL SELECT pos, 2, 'assistant', coalesce(answer, '') FROM qa",
}
