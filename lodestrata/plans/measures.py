"""Measures over graphs, pairs, vectors and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import graph as G
from lodestrata.operators import measures as M
from lodestrata.tables import table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def measure_trust(spark, sf_dir):
    return M.trust(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")).withColumn("trust", F.round("trust", 6))


def measure_centrality(spark, sf_dir):
    return M.degree_centrality(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")).withColumn("centrality", F.round("centrality", 9))


def measure_graph_entropy(spark, sf_dir):
    return M.graph_entropy(table(spark, sf_dir, "edges")).select(F.round("entropy", 6).alias("entropy"))


def measure_subgraph_entropy(spark, sf_dir):
    chunks = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'chunk'").select("id")
    edges = table(spark, sf_dir, "edges").join(chunks.withColumnRenamed("id", "src"), "src", "left_semi").join(chunks.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return M.graph_entropy(edges).select(F.round("entropy", 6).alias("entropy"))


def measure_structural_entropy(spark, sf_dir):
    return M.structural_entropy(table(spark, sf_dir, "edges"), 2).select(F.round("entropy", 6).alias("entropy"))


def measure_hyper_adamic_adar(spark, sf_dir):
    """Suppliers that share parts: orders as hyperedges of their suppliers' nations."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    return M.hyper_adamic_adar(lines, "l_orderkey", "s_nationkey").withColumn("score", F.round("score", 4))


def measure_hyperedge_attention(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return lines.groupBy("l_orderkey").agg(F.round(1 / F.count("*"), 6).alias("attention"))


def measure_curation(spark, sf_dir):
    return M.curation_metrics(table(spark, sf_dir, "qa"), 7.0)


def measure_rated_pairs(spark, sf_dir):
    rating = F.when(F.isnan("rating"), F.lit(None)).otherwise(F.col("rating"))
    return table(spark, sf_dir, "qa").where(rating >= 7).select("pos", "rating")


def measure_p95(spark, sf_dir):
    return M.indexed_percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


def measure_p99(spark, sf_dir):
    return M.indexed_percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.99, shift=1)


def measure_percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


def measure_snr_threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(6 + 0.5 * F.coalesce(F.stddev_pop("value"), F.lit(0.0)), 6).alias("threshold"))


def measure_mean_vectors(spark, sf_dir):
    return M.mean_vector(_vectors(spark, sf_dir), "embedding", ["label"]).select("label", "d", F.round("mean", 6).alias("mean"))


def measure_mmd(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return M.linear_mmd(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"), "embedding").select(F.round("mmd", 8).alias("mmd"))


def measure_vector_entropy(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(F.round(-F.avg(F.log(V.norm(F.col("embedding")) + 1e-12)), 6).alias("entropy"))


def measure_hyperbolic_radius(spark, sf_dir):
    inside = F.least(V.norm(F.col("embedding")) / 2, F.lit(1 - 1e-7))
    return _vectors(spark, sf_dir).groupBy("label").agg(F.round(F.avg(0.5 * F.log((1 + inside) / (1 - inside))), 6).alias("radius"))


def measure_bias_scaled(spark, sf_dir):
    """Mean norm of each group, the mean of the groups, and the scale between them."""
    groups = _vectors(spark, sf_dir).groupBy("label").agg(F.avg(V.norm(F.col("embedding"))).alias("mean_norm"))
    target = groups.agg(F.avg("mean_norm").alias("target"))
    return groups.crossJoin(F.broadcast(target)).select("label", F.round("mean_norm", 6).alias("mean_norm"), F.round(F.col("target") / F.col("mean_norm"), 6).alias("scale"))


def measure_renyi(spark, sf_dir):
    spent = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("e"))
    return M.renyi_epsilon(spent, "user_id", "e").select("user_id", F.round("epsilon", 4).alias("epsilon"))


def measure_lacunarity(spark, sf_dir):
    return M.lacunarity(table(spark, sf_dir, "edges")).select(F.round("lacunarity", 6).alias("lacunarity"))


def measure_mttr(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    return M.mean_hours_between(errors, "user_id", "ts").select("user_id", F.round("hours", 6).alias("hours"))


def measure_verified_triplets(spark, sf_dir):
    """Share of the mentions of each document's chunks that name an entity which another document mentions too."""
    pairs = G.document_entities(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))
    known = pairs.groupBy("entity").agg(F.count("*").alias("n"))
    return pairs.join(known, "entity").groupBy("document").agg(F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("verified"))


def _difficulty(spark, sf_dir):
    """0.5 hops + 0.3 length + 0.2 centrality of each pair."""
    pairs = table(spark, sf_dir, "qa").where("question IS NOT NULL")
    hops = F.coalesce(F.regexp_extract("chunk", r"_chunk_(\d+)$", 1).try_cast("int"), F.lit(0))
    return pairs.select("pos", F.round(0.5 * hops + 0.3 * F.length("question") + 0.2 * F.coalesce("confidence", F.lit(0.0)), 6).alias("difficulty"))


def measure_difficulty(spark, sf_dir):
    """Difficulty of each pair, and how many pairs have the same."""
    rows = _difficulty(spark, sf_dir)
    counts = rows.groupBy("difficulty").agg(F.count("*").alias("n"))
    return rows.join(counts, "difficulty").select("pos", "difficulty", F.col("n").alias("tied"))


def measure_curriculum(spark, sf_dir):
    """Curriculum order: ascending difficulty, ties by ``pos``, in batches of 64."""
    rows = _difficulty(spark, sf_dir)
    # the position of a row in the order of all rows, by counting lower values: the only global window is over distinct values
    counts = rows.groupBy("difficulty").agg(F.count("*").alias("n"))
    lower = counts.select("difficulty", (F.sum("n").over(Window.orderBy("difficulty")) - F.col("n")).alias("lower"))
    among = F.row_number().over(Window.partitionBy("difficulty").orderBy("pos")) - 1
    placed = rows.withColumn("among", among).join(lower, "difficulty").withColumn("position", F.col("lower") + F.col("among"))
    return placed.select("pos", "difficulty", "position", F.floor(F.col("position") / 64).alias("batch"))


def measure_community_summaries(spark, sf_dir):
    """The first twenty words of the texts of each source's chunks, in order."""
    rows = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'chunk' AND length(text) > 0 AND source IS NOT NULL")
    # twenty words never need more than the first twenty chunks of a source
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).where("i <= 20")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return first.groupBy("source").agg(F.array_join(F.slice(F.filter(F.split(listed, r"[ \n\r\t]+"), lambda w: w != ""), 1, 20), " ").alias("summary"))


QUERIES = {
    f.__name__: f
    for f in (
        measure_trust, measure_centrality, measure_graph_entropy, measure_subgraph_entropy, measure_structural_entropy, measure_hyper_adamic_adar, measure_hyperedge_attention, measure_curation, measure_rated_pairs,
        measure_p95, measure_p99, measure_percentile, measure_snr_threshold, measure_mean_vectors, measure_mmd, measure_vector_entropy, measure_hyperbolic_radius, measure_bias_scaled, measure_renyi, measure_lacunarity,
        measure_mttr, measure_verified_triplets, measure_difficulty, measure_curriculum, measure_community_summaries,
    )
}

_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))"
_PAIRS = "p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM {e} WHERE src <> dst), g AS (SELECT id, count(*) AS d FROM (SELECT u AS id FROM p UNION ALL SELECT v FROM p) GROUP BY 1)"
_ENTROPY = "SELECT round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT d, count(*) AS n FROM g GROUP BY 1))"

ORACLES = {
    "measure_trust": "SELECT source, count(*) AS n, round(least(1.0, count(*) / 3), 6)::DOUBLE AS trust FROM (SELECT source FROM nodes UNION ALL SELECT provenance FROM edges) WHERE source IS NOT NULL GROUP BY 1",
    "measure_centrality": "WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), i AS (SELECT DISTINCT id FROM nodes) SELECT i.id, round(coalesce(d, 0) / greatest((SELECT count(*) - 1 FROM i), 1), 9)::DOUBLE AS centrality FROM i LEFT JOIN d ON d.id = i.id",
    "measure_graph_entropy": f"WITH {_PAIRS.format(e='edges')} {_ENTROPY}",
    "measure_subgraph_entropy": f"WITH c AS (SELECT id FROM nodes GROUP BY id HAVING arg_min(lower(type), pos) = 'chunk'), ce AS (SELECT * FROM edges WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)), {_PAIRS.format(e='ce')} {_ENTROPY}",
    "measure_structural_entropy": "WITH p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst), t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM p x JOIN p y ON y.u = x.v JOIN p z ON z.u = x.u AND z.v = y.v), k AS (SELECT id FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1 HAVING count(*) >= 2), q AS (SELECT * FROM p WHERE u IN (SELECT id FROM k) AND v IN (SELECT id FROM k)), ids AS (SELECT u AS id FROM p UNION SELECT v FROM p), g AS (SELECT ids.id, count(q.u) AS d FROM ids LEFT JOIN q ON q.u = ids.id OR q.v = ids.id GROUP BY 1) "
    + _ENTROPY,
    "measure_hyper_adamic_adar": "WITH m AS (SELECT DISTINCT l_orderkey AS e, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), s AS (SELECT e, n, count(*) OVER (PARTITION BY e) AS size FROM m) SELECT a.n AS u, b.n AS v, round(sum(CASE WHEN a.size > 2 THEN 1 / ln(a.size - 1) ELSE 0 END), 4) AS score FROM s a JOIN s b ON a.e = b.e AND a.n < b.n GROUP BY 1, 2",
    "measure_hyperedge_attention": "SELECT l_orderkey, round(1 / count(DISTINCT l_suppkey), 6)::DOUBLE AS attention FROM lineitem GROUP BY 1",
    "measure_curation": "WITH r AS (SELECT CASE WHEN isnan(rating) THEN NULL ELSE rating END AS r FROM qa) SELECT count(*) AS total, count(*) FILTER (r >= 7) AS filtered, round_even(count(*) FILTER (r >= 7) / count(*), 2)::DOUBLE AS retention_rate, round_even(coalesce(sum(r), 0) / count(*), 1)::DOUBLE AS avg_over_all, round_even(avg(r), 1)::DOUBLE AS avg_over_rated FROM r",
    "measure_rated_pairs": "SELECT pos, rating FROM qa WHERE rating >= 7 AND NOT isnan(rating)",
    "measure_p95": "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = floor(0.95::DOUBLE * (n - 1))",
    "measure_p99": "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = greatest(floor(0.99::DOUBLE * n) - 1, 0)",
    "measure_percentile": "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "measure_snr_threshold": "SELECT event_type, round(6 + 0.5 * coalesce(stddev_pop(value), 0), 6) AS threshold FROM events GROUP BY 1",
    "measure_mean_vectors": "WITH e AS (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) SELECT label, (i - 1)::INT AS d, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM e GROUP BY 1, 2",
    "measure_mmd": "WITH e AS (SELECT label % 2 AS g, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT g, i, avg(embedding[i]::DOUBLE) AS m FROM e GROUP BY 1, 2) SELECT round(sum((a.m - b.m) * (a.m - b.m)), 8) AS mmd FROM m a JOIN m b ON a.i = b.i AND a.g = 0 AND b.g = 1",
    "measure_vector_entropy": f"SELECT round(-avg(ln({_NORM} + 1e-12)), 6) AS entropy FROM embeddings",
    "measure_hyperbolic_radius": f"SELECT label, round(avg(0.5 * ln((1 + r) / (1 - r))), 6) AS radius FROM (SELECT label, least({_NORM} / 2, 1 - 1e-7::DOUBLE) AS r FROM embeddings) GROUP BY 1",
    "measure_bias_scaled": f"WITH g AS (SELECT label, avg({_NORM}) AS m FROM embeddings GROUP BY 1) SELECT label, round(m, 6) AS mean_norm, round((SELECT avg(m) FROM g) / m, 6) AS scale FROM g",
    "measure_renyi": "WITH e AS (SELECT user_id, value / 100 AS e, unnest(range(2, 33)) AS a FROM events), x AS (SELECT user_id, a, max((a - 1) * e) AS m FROM e GROUP BY 1, 2), s AS (SELECT e.user_id, e.a, m, sum(exp((e.a - 1) * e.e - m)) AS s FROM e JOIN x ON x.user_id = e.user_id AND x.a = e.a GROUP BY 1, 2, 3) SELECT user_id, round(min((m + ln(s)) / (a - 1)), 4) AS epsilon FROM s GROUP BY 1",
    "measure_lacunarity": f"WITH {_PAIRS.format(e='edges')} SELECT round(var_pop(d + 1) / (avg(d + 1) * avg(d + 1)) + 1, 6) AS lacunarity FROM g",
    "measure_mttr": "SELECT user_id, round(avg(gap) / 3.6e9, 6)::DOUBLE AS hours FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events WHERE event_type = 'error') GROUP BY 1",
    "measure_verified_triplets": "WITH dn AS (SELECT id, arg_min(lower(type), pos) AS type FROM nodes GROUP BY id), de AS (SELECT DISTINCT src, dst, lower(relation) AS relation FROM edges), me AS (SELECT src AS chunk, dst AS entity FROM de WHERE relation = 'mentions' AND src IN (SELECT id FROM dn WHERE type = 'chunk') AND dst IN (SELECT id FROM dn WHERE type = 'entity')), doe AS (SELECT src AS document, dst AS entity FROM de WHERE relation = 'mentions' AND src IN (SELECT id FROM dn WHERE type = 'document') UNION SELECT h.src, entity FROM me JOIN de h ON h.relation = 'has_chunk' AND h.dst = chunk), k AS (SELECT entity, count(*) AS n FROM doe GROUP BY 1) SELECT document, round(avg((n > 1)::INT), 6)::DOUBLE AS verified FROM doe JOIN k USING (entity) GROUP BY 1",
    "measure_difficulty": r"WITH r AS (SELECT pos, round(0.5 * coalesce(try_cast(regexp_extract(chunk, '_chunk_(\d+)$', 1) AS INT), 0) + 0.3 * length(question) + 0.2 * coalesce(confidence, 0), 6) AS difficulty FROM qa WHERE question IS NOT NULL) SELECT pos, difficulty, count(*) OVER (PARTITION BY difficulty) AS tied FROM r",
    "measure_curriculum": r"WITH r AS (SELECT pos, round(0.5 * coalesce(try_cast(regexp_extract(chunk, '_chunk_(\d+)$', 1) AS INT), 0) + 0.3 * length(question) + 0.2 * coalesce(confidence, 0), 6) AS difficulty FROM qa WHERE question IS NOT NULL), o AS (SELECT pos, difficulty, row_number() OVER (ORDER BY difficulty, pos) - 1 AS position FROM r) SELECT pos, difficulty, position, position // 64 AS batch FROM o",
    "measure_community_summaries": r"WITH dn AS (SELECT id, min(pos) AS pos, arg_min(lower(type), pos) AS type, arg_min({'v': text}, pos).v AS text, arg_min({'v': source}, pos).v AS source FROM nodes GROUP BY id), t AS (SELECT source, string_agg(text, ' ' ORDER BY pos) AS t FROM dn WHERE type = 'chunk' AND length(text) > 0 AND source IS NOT NULL GROUP BY 1) SELECT source, array_to_string(list_filter(regexp_split_to_array(t, '[ \n\r\t]+'), lambda w: w <> '')[1:20], ' ') AS summary FROM t",
}
