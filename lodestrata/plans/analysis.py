"""Further measures over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import analysis as A
from lodestrata.operators import graph as G
from lodestrata.operators import sampling
from lodestrata.operators import topology as P
from lodestrata.operators.measures import mean_vector
from lodestrata.tables import table


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "edges").where("lower(relation) = 'mentions'").select("src", "dst", F.col("dst").alias("motif"))


def analysis_description_length(spark, sf_dir):
    return A.description_length(table(spark, sf_dir, "edges"), _mentions(spark, sf_dir), 0.1).select("motifs", "residual", F.round("length", 4).alias("length"))


def analysis_coverage(spark, sf_dir):
    used = table(spark, sf_dir, "edges").where("lower(relation) IN ('mentions', 'has_chunk')")
    return A.coverage(table(spark, sf_dir, "edges"), used).select("edges", F.round("edge_coverage", 6).alias("edge_coverage"), "loops", F.round("loop_coverage", 6).alias("loop_coverage"))


def analysis_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return A.alignment(rows.select("vec_id", F.slice("embedding", 1, 32).alias("v")), rows.select("vec_id", F.slice("embedding", 33, 32).alias("v")), "vec_id", "v").select(F.round("correlation", 6).alias("correlation"))


def analysis_norm_bias(spark, sf_dir):
    """Distances between the norms of vectors of different labels, to three digits of the norm."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.round(V.norm(F.col("embedding")), 3).alias("x"))
    return A.wasserstein(rows, "label", "x").select("a", "b", F.round("distance", 6).alias("distance"))


def analysis_value_bias(spark, sf_dir):
    return A.wasserstein(table(spark, sf_dir, "events").where("value IS NOT NULL"), "event_type", "value").select("a", "b", F.round("distance", 6).alias("distance"))


def analysis_loglog_fit(spark, sf_dir):
    """How the number of orders falls with their price, for each priority."""
    rows = table(spark, sf_dir, "orders").withColumn("x", F.floor(F.col("o_totalprice") / 20000) + 1).groupBy("o_orderpriority", "x").agg(F.count("*").alias("y"))
    return A.loglog_fit(rows, "o_orderpriority", "x", "y").select("o_orderpriority", "n", F.round("slope", 6).alias("slope"), F.round("length", 4).alias("length"))


def analysis_reweighted(spark, sf_dir):
    """Weights of segments among customers with a negative balance against all."""
    share = lambda d: d.groupBy("c_mktsegment").agg(F.count("*").alias("n")).crossJoin(F.broadcast(d.agg(F.count("*").alias("t")))).select("c_mktsegment", (F.col("n") / F.col("t")).alias("share"))
    customers = table(spark, sf_dir, "customer")
    return A.reweighted(share(customers.where("c_acctbal < 0")), share(customers), "c_mktsegment", "share", threshold=0.001)


def analysis_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.as_double(F.col("embedding")), lambda x: x / 4).alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("goal"))
    return A.greedy_paths(rows, "vec_id", "v", asked).select("start", "goal", "hop", F.round("total", 6).alias("total"))


def analysis_quotient(spark, sf_dir):
    """Types of nodes that edges join."""
    kinds = G.distinct_nodes(table(spark, sf_dir, "nodes")).select(F.col("id").alias("node"), F.col("type").alias("class"))
    return A.quotient(table(spark, sf_dir, "edges"), kinds)


def analysis_multiplex(spark, sf_dir):
    edges = table(spark, sf_dir, "edges")
    layer = lambda r: P.sheaf_laplacian(P.signed_pairs(edges.where(F.lower("relation") == r), F.lit(1)))
    return A.multiplex([(layer("has_chunk"), 1.0), (layer("next_chunk"), 2.0), (layer("similar_to"), 1.0)]).select("i", "j", F.round("v", 6).alias("v"))


def analysis_regressions(spark, sf_dir):
    """Mean values of the later half of events against the earlier half, by type."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    middle = rows.agg(F.floor(F.max("event_id") / 2).alias("m"))
    halves = rows.crossJoin(F.broadcast(middle)).groupBy("event_type").agg(F.avg(F.when(F.col("event_id") > F.col("m"), F.col("value"))).alias("now"), F.avg(F.when(F.col("event_id") <= F.col("m"), F.col("value"))).alias("before"))
    return halves.select("event_type", A.regression_status(F.col("now"), F.col("before")).alias("status"))


def analysis_level_means(spark, sf_dir):
    """Mean vectors of levels, a row a level and dimension, and the share of vectors with a level."""
    rows = table(spark, sf_dir, "embeddings").withColumn("level", F.when(F.col("vec_id") % 7 != 0, F.pmod("label", F.lit(3))))
    return mean_vector(rows.where("level IS NOT NULL"), "embedding", ["level"]).select("level", "d", F.round("mean", 6).alias("mean"))


def analysis_level_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("level", F.when(F.col("vec_id") % 7 != 0, F.pmod("label", F.lit(3))))
    return rows.agg(F.round(F.avg(F.col("level").isNotNull().cast("double")), 6).alias("coverage"))


def analysis_hard_samples(spark, sf_dir):
    """Pairs whose loss (one less the confidence) lies above the 90th percentile, with two variants each."""
    rows = table(spark, sf_dir, "qa").where("question IS NOT NULL AND confidence IS NOT NULL").select("pos", "question", (1 - F.col("confidence")).alias("loss"))
    bound = rows.agg(F.percentile("loss", F.lit(0.9)).alias("bound"))
    hard = rows.crossJoin(F.broadcast(bound)).where("loss > bound")
    variants = sampling.synonym_variants(F.col("question"), {"report": ["account", "statement"], "list": ["roll"]}, 2)
    return hard.select("pos", F.posexplode(variants).alias("n", "variant"))


def analysis_random_graph(spark, sf_dir):
    return A.random_graph(spark, 200, 600, 7).agg(F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("different"), F.max("dst").alias("last"))


def analysis_predicted_hyperedges(spark, sf_dir):
    """Pairs of suppliers' nations whose sets of ordered parts' sizes are alike (Jaccard of at least 0.8)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.select(F.col("s_nationkey").alias("n"), F.col("p_size").alias("s")).distinct()
    sizes = sets.groupBy("n").agg(F.count("*").alias("k"))
    shared = sets.withColumnRenamed("n", "a").join(sets.withColumnRenamed("n", "b"), "s").where("a < b").groupBy("a", "b").agg(F.count("*").alias("m"))
    both = shared.join(sizes.select(F.col("n").alias("a"), F.col("k").alias("ka")), "a").join(sizes.select(F.col("n").alias("b"), F.col("k").alias("kb")), "b")
    return both.select("a", "b", F.round(F.col("m") / (F.col("ka") + F.col("kb") - F.col("m")), 6).alias("similarity")).where("similarity >= 0.8")


QUERIES = {
    f.__name__: f
    for f in (
        analysis_description_length, analysis_coverage, analysis_alignment, analysis_norm_bias, analysis_value_bias, analysis_loglog_fit, analysis_reweighted, analysis_paths, analysis_quotient, analysis_multiplex,
        analysis_regressions, analysis_level_means, analysis_level_coverage, analysis_hard_samples, analysis_random_graph, analysis_predicted_hyperedges,
    )
}

_W = "c AS (SELECT g, x, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT g, sum(n) AS t FROM c GROUP BY 1), p AS (SELECT a.g AS a, b.g AS b, a.t AS ta, b.t AS tb FROM t a JOIN t b ON a.g < b.g), s AS (SELECT a, b, x, n / ta AS m FROM p JOIN c ON g = a UNION ALL SELECT a, b, x, -n / tb FROM p JOIN c ON g = b), z AS (SELECT a, b, x, sum(m) AS m FROM s GROUP BY 1, 2, 3), q AS (SELECT a, b, sum(m) OVER w AS gap, lead(x) OVER w - x AS width FROM z WINDOW w AS (PARTITION BY a, b ORDER BY x)) SELECT a, b, round(sum(abs(gap) * coalesce(width, 0)), 6) AS distance FROM q GROUP BY 1, 2"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))"
_PW = "p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst)"
_DOTV = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def _dist(a, b):
    sq = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    x = f"(1 + 2 * {sq} / ((1 - {_DOTV.format(a=a, b=a)}) * (1 - {_DOTV.format(a=b, b=b)})))"
    return f"ln({x} + sqrt({x} * {x} - 1))"


def _layer(relation, weight):
    pairs = f"(SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst AND lower(relation) = '{relation}')"
    off = f"(SELECT u AS i, v AS j FROM {pairs} UNION ALL SELECT v, u FROM {pairs})"
    return f"SELECT i, j, -1.0::DOUBLE * {weight} AS v FROM {off} UNION ALL SELECT i, i, count(*) * {weight}::DOUBLE FROM {off} GROUP BY 1"


ORACLES = {
    "analysis_description_length": f"WITH {_PW}, m AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst AND lower(relation) = 'mentions'), x AS (SELECT (SELECT count(DISTINCT dst) FROM edges WHERE lower(relation) = 'mentions') AS motifs, (SELECT count(*) FROM p WHERE (u, v) NOT IN (SELECT (u, v) FROM m)) AS residual, (SELECT count(*) FROM p) AS e, (SELECT count(*) FROM (SELECT u FROM p UNION SELECT v FROM p)) AS v) SELECT motifs, residual, round(motifs * ln(v + 1) + residual * ln(e + 1) * 1.1::DOUBLE, 4) AS length FROM x",
    "analysis_alignment": "WITH e AS (SELECT vec_id, unnest(range(1, 33)) AS i, embedding FROM embeddings), x AS (SELECT i, embedding[i]::DOUBLE AS a, embedding[i + 32]::DOUBLE AS b FROM e), c AS (SELECT a - avg(a) OVER (PARTITION BY i) AS a, b - avg(b) OVER (PARTITION BY i) AS b FROM x) SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS correlation FROM c",
    "analysis_norm_bias": f"WITH v AS (SELECT label AS g, round({_NORM}, 3) AS x FROM embeddings), {_W}",
    "analysis_value_bias": f"WITH v AS (SELECT event_type AS g, value AS x FROM events WHERE value IS NOT NULL), {_W}",
    "analysis_loglog_fit": "WITH r AS (SELECT o_orderpriority, ln(floor(o_totalprice / 20000) + 1) AS a, ln(count(*)) AS b FROM orders GROUP BY o_orderpriority, floor(o_totalprice / 20000) + 1), f AS (SELECT o_orderpriority, count(*) AS n, regr_slope(b, a) AS s, regr_syy(b, a) AS syy, regr_sxy(b, a) AS sxy FROM r GROUP BY 1) SELECT o_orderpriority, n, round(s, 6) AS slope, round(n * ln(greatest(syy - s * sxy, 0) / n + 1e-12) + 2 * ln(n), 4) AS length FROM f",
    "analysis_reweighted": "WITH w AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) AS w FROM customer GROUP BY 1), l AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS l FROM customer WHERE c_acctbal < 0 GROUP BY 1), b AS (SELECT w.c_mktsegment, w, coalesce(l, 0) AS l FROM w LEFT JOIN l ON l.c_mktsegment = w.c_mktsegment), d AS (SELECT avg(abs(x.l - y.w)) AS d FROM (SELECT l, row_number() OVER (ORDER BY l) AS i FROM b) x JOIN (SELECT w, row_number() OVER (ORDER BY w) AS i FROM b) y ON x.i = y.i) SELECT c_mktsegment, CASE WHEN d > 0.001 AND l < w THEN 1.2 ELSE 1.0 END::DOUBLE AS weight FROM b, d",
    "analysis_paths": f"WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / 4) AS v FROM embeddings), m AS (SELECT s.vec_id AS start, g.vec_id AS goal, k.vec_id AS hop, {_dist('s.v', 'k.v')} + {_dist('k.v', 'g.v')} AS total FROM v s JOIN v g ON s.vec_id % 50 = 0 AND g.vec_id = s.vec_id + 1 JOIN v k ON k.vec_id NOT IN (s.vec_id, g.vec_id)) SELECT start, goal, hop, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY total, hop) AS n FROM m) WHERE n = 1",
    "analysis_quotient": "WITH k AS (SELECT id, arg_min(lower(type), pos) AS t FROM nodes GROUP BY id) SELECT DISTINCT least(a.t, b.t) AS u, greatest(a.t, b.t) AS v FROM edges JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE a.t <> b.t",
    "analysis_multiplex": f"SELECT i, j, round(sum(v), 6) AS v FROM ({_layer('has_chunk', 0.25)} UNION ALL {_layer('next_chunk', 0.5)} UNION ALL {_layer('similar_to', 0.25)}) GROUP BY 1, 2",
    "analysis_regressions": "WITH h AS (SELECT event_type, avg(value) FILTER (event_id > m) AS now, avg(value) FILTER (event_id <= m) AS before FROM events, (SELECT floor(max(event_id) / 2) AS m FROM events WHERE value IS NOT NULL) WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, CASE WHEN now > before * 1.05 THEN 'worse' WHEN now < before * 0.95 THEN 'better' ELSE 'same' END AS status FROM h",
    "analysis_level_means": "WITH e AS (SELECT label % 3 AS level, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id % 7 <> 0) SELECT level::INT AS level, (i - 1)::INT AS d, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM e GROUP BY 1, 2",
    "analysis_level_coverage": "SELECT round(avg((vec_id % 7 <> 0)::INT), 6)::DOUBLE AS coverage FROM embeddings",
    "analysis_predicted_hyperedges": "WITH s AS (SELECT DISTINCT s_nationkey AS n, p_size AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), k AS (SELECT n, count(*) AS k FROM s GROUP BY 1), h AS (SELECT x.n AS a, y.n AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.n < y.n GROUP BY 1, 2) SELECT a, b, round(m / (p.k + q.k - m), 6)::DOUBLE AS similarity FROM h JOIN k p ON p.n = a JOIN k q ON q.n = b WHERE round(m / (p.k + q.k - m), 6) >= 0.8",
}
