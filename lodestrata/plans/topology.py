"""Topology, sheaves, hypergraphs, spectra and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.functions import vectors as V
from lodestrata.operators import numeric as N
from lodestrata.operators import shapes as Z
from lodestrata.operators import topology as P
from lodestrata.streaming import edges as E
from lodestrata.tables import table

TIMES = [5.0 * i for i in range(1, 12)]


def _diagram(spark, sf_dir):
    """Lives of events: born at the value, dying some units later, a diagram a type."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.select("event_type", F.col("value").alias("birth"), (F.col("value") + F.pmod("event_id", F.lit(7)) + 1).alias("death"))


def _pairs(spark, sf_dir):
    return P.signed_pairs(table(spark, sf_dir, "edges"), F.when(F.lower("relation") == "similar_to", -1).otherwise(1))


def _document_graphs(spark, sf_dir):
    """Edges of each document with its chunks."""
    edges = G.distinct_edges(table(spark, sf_dir, "edges"))
    owner = G.chunk_documents(table(spark, sf_dir, "edges"))
    own = edges.where("relation = 'has_chunk'").select(F.col("src").alias("graph"), "src", "dst")
    chain = edges.where("relation = 'next_chunk'").join(owner.withColumnRenamed("chunk", "src"), "src").select(F.col("document").alias("graph"), "src", "dst")
    return own.unionByName(chain)


def topology_entropy(spark, sf_dir):
    return P.diagram_entropy(_diagram(spark, sf_dir), "event_type").select("event_type", F.round("entropy", 6).alias("entropy"))


def topology_betti(spark, sf_dir):
    return P.betti_curve(_diagram(spark, sf_dir), "event_type", TIMES)


def topology_landscape(spark, sf_dir):
    return P.landscape(_diagram(spark, sf_dir), "event_type", TIMES, 3).select("event_type", "t", "k", F.round("height", 6).alias("height"))


def topology_silhouette(spark, sf_dir):
    return P.silhouette(_diagram(spark, sf_dir), "event_type", TIMES).select("event_type", "t", F.round("height", 6).alias("height"))


def topology_image(spark, sf_dir):
    return P.persistence_image(_diagram(spark, sf_dir), "event_type", [10.0, 20.0, 30.0, 40.0], 4.0).select("event_type", "x", "y", F.round("v", 4).alias("v"))


def sheaf_laplacian(spark, sf_dir):
    return P.sheaf_laplacian(_pairs(spark, sf_dir))


def sheaf_incidence(spark, sf_dir):
    return P.sheaf_incidence(_pairs(spark, sf_dir))


def sheaf_convolution(spark, sf_dir):
    features = G.distinct_nodes(table(spark, sf_dir, "nodes")).select(F.col("id").alias("node"), F.coalesce(F.length("text"), F.lit(0)).alias("x"))
    return P.sheaf_convolution(_pairs(spark, sf_dir), features, 0.1).select("node", F.round("x", 6).alias("x"))


def sheaf_network(spark, sf_dir):
    features = G.distinct_nodes(table(spark, sf_dir, "nodes")).select(F.col("id").alias("node"), F.coalesce(F.length("text"), F.lit(0)).alias("x"))
    return P.sheaf_convolution(_pairs(spark, sf_dir), features, 0.1, layers=2, rectified=True).select("node", F.round("x", 4).alias("x"))


def hypergraph_laplacian(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return P.hypergraph_laplacian(lines.select(F.col("l_orderkey").alias("edge"), F.col("s_nationkey").alias("node"))).select("i", "j", F.round("v", 8).alias("v"))


def hypergraph_largest_eigenvalue(spark, sf_dir):
    matrix = hypergraph_laplacian(spark, sf_dir)
    return P.power_iteration(matrix).select(F.round("lambda", 3).alias("lambda"))


def mapper_members(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return P.mapper_intervals(rows, "event_id", "value", 8, 0.25, 0.05)


def mapper_nerve(spark, sf_dir):
    return P.nerve(mapper_members(spark, sf_dir), "event_id")


def spectral_measures(spark, sf_dir):
    found = N.per_graph(_document_graphs(spark, sf_dir), "graph", N.spectral_measures, "nodes bigint, entropy double, gap double, energy double, dimension double, largest double")
    return found.select("graph", "nodes", *[F.round(c, 5).alias(c) for c in ("entropy", "gap", "energy", "dimension", "largest")])


def spectral_graphwave(spark, sf_dir):
    found = N.per_graph(_document_graphs(spark, sf_dir), "graph", N.graphwave, "node string, vec array<double>")
    return found.select("graph", "node", F.size("vec").alias("dimensions"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x), 4).alias("square"))


def spectral_fourier(spark, sf_dir):
    return N.per_graph(_document_graphs(spark, sf_dir), "graph", N.fourier, "k bigint, energy double").select("graph", "k", F.round("energy", 4).alias("energy"))


def fractal_dimension(spark, sf_dir):
    found = N.per_graph(_document_graphs(spark, sf_dir), "graph", N.box_dimension, "boxes1 bigint, boxes2 bigint, boxes3 bigint, dimension double")
    return found.withColumn("dimension", F.round("dimension", 6))


def fractal_contracted(spark, sf_dir):
    return N.per_graph(_document_graphs(spark, sf_dir), "graph", N.contracted, "node string, box string")


def topology_persistence(spark, sf_dir):
    found = N.per_graph(_document_graphs(spark, sf_dir), "graph", N.persistence, "dim bigint, birth double, death double")
    return found.groupBy("graph", "dim").agg(F.count("*").alias("features"), F.round(F.sum(F.col("death") - F.col("birth")), 6).alias("life"))


def graph_betweenness(spark, sf_dir):
    return N.per_graph(_document_graphs(spark, sf_dir), "graph", N.betweenness, "node string, value double").select("graph", "node", F.round("value", 6).alias("value"))


def graph_orbits(spark, sf_dir):
    return N.per_graph(_document_graphs(spark, sf_dir), "graph", N.orbits, "node string, orbit string")


def sheaf_balance(spark, sf_dir):
    """Cohomology of the whole graph, a row a component: similar_to is negative, all other relations positive."""
    return P.balanced_components(_pairs(spark, sf_dir))


def sheaf_consistency(spark, sf_dir):
    """One over one more than the first cohomology of each component, and of the whole graph."""
    found = P.balanced_components(_pairs(spark, sf_dir))
    each = found.select("component", F.col("first"))
    whole = found.agg(F.sum("first").alias("first")).select(F.lit("all").alias("component"), "first")
    return each.unionByName(whole).select("component", F.round(1 / (1 + F.col("first")), 9).alias("score"))


def _norm_cover(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("value"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    return rows, P.mapper_intervals(rows, "vec_id", "x", 6, 0.2, 0.02)


def mapper_inverse(spark, sf_dir):
    """Edges between vectors that share a set of the cover."""
    return P.inverse_mapper(_norm_cover(spark, sf_dir)[1], "vec_id")


def mapper_silhouette(spark, sf_dir):
    rows, cover = _norm_cover(spark, sf_dir)
    return P.cover_silhouette(cover, "vec_id", rows, "x").select(F.round("silhouette", 6).alias("silhouette"))


def hypergraph_filtered(spark, sf_dir):
    """Chebyshev convolution of the nations' balances over the hypergraph of orders."""
    balances = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.avg("s_acctbal").alias("x"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    matrix = P.hypergraph_laplacian(lines.select(F.col("l_orderkey").alias("edge"), F.col("s_nationkey").alias("node")))
    return P.chebyshev_filtered(matrix, balances, [0.5, 0.3, 0.2]).select("node", F.round("x", 3).alias("x"))


def spectral_signal_back(spark, sf_dir):
    """Degrees after the transform and its inverse."""
    return N.per_graph(_document_graphs(spark, sf_dir), "graph", Z.signal_back, "node string, value double").select("graph", "node", F.round("value", 6).alias("value"))


def fractal_hierarchy(spark, sf_dir):
    """Boxes of boxes of each document's graph until nothing shrinks."""
    return N.per_graph(_document_graphs(spark, sf_dir), "graph", Z.hierarchy, "level bigint, node string, box string")


def stream_late_events(spark, sf_dir):
    rows = E.late_events(table(spark, sf_dir, "edges_in"))
    return rows.select("arrival", "late")


def stream_hot_edges(spark, sf_dir):
    return E.hot_edges(table(spark, sf_dir, "edges_in"))


def stream_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "edges_in").where("ts IS NOT NULL")
    return rows.groupBy(F.window("ts", "30 seconds").alias("w")).agg(F.count("*").alias("events"), F.countDistinct("src", "dst").alias("edges")).select(F.unix_seconds("w.start").alias("start"), "events", "edges")


def stream_neighbours(spark, sf_dir):
    return E.hot_edges(table(spark, sf_dir, "edges_in")).groupBy("src").agg(F.count("*").alias("neighbours"))


QUERIES = {
    f.__name__: f
    for f in (
        topology_entropy, topology_betti, topology_landscape, topology_silhouette, topology_image, sheaf_laplacian, sheaf_incidence, sheaf_convolution, sheaf_network, hypergraph_laplacian, hypergraph_largest_eigenvalue,
        mapper_members, mapper_nerve, sheaf_balance, sheaf_consistency, mapper_inverse, mapper_silhouette, hypergraph_filtered, spectral_signal_back, fractal_hierarchy, spectral_measures, spectral_graphwave, spectral_fourier, fractal_dimension, fractal_contracted, topology_persistence, graph_betweenness, graph_orbits,
        stream_late_events, stream_hot_edges, stream_windows, stream_neighbours,
    )
}

_D = "d AS (SELECT event_type, value AS birth, value + event_id % 7 + 1 AS death FROM events WHERE value IS NOT NULL), t AS (SELECT unnest(range(1, 12)) * 5.0::DOUBLE AS t)"
_TENT = "greatest(least(t - birth, death - t), 0)"
_SIGNED = "p AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(CASE WHEN lower(relation) = 'similar_to' THEN -1 ELSE 1 END) AS sign FROM edges WHERE src <> dst GROUP BY 1, 2)"
_LAP = f"{_SIGNED}, off AS (SELECT u AS i, v AS j, -sign::DOUBLE AS v FROM p UNION ALL SELECT v, u, -sign FROM p), l AS (SELECT * FROM off UNION ALL SELECT i, i, count(*)::DOUBLE FROM off GROUP BY 1)"
_FEATURES = "f0 AS (SELECT id AS node, coalesce(length(arg_min({'v': text}, pos).v), 0)::DOUBLE AS x FROM nodes GROUP BY id)"


def _layer(new, old, rectified=False):
    value = "coalesce(x, 0) - 0.1::DOUBLE * coalesce(lx, 0)"
    return f"{new} AS (SELECT coalesce(a.node, b.node) AS node, {f'greatest({value}, 0)' if rectified else value} AS x FROM {old} a FULL JOIN (SELECT i AS node, sum(v * x) AS lx FROM l JOIN {old} ON node = j GROUP BY 1) b ON b.node = a.node)"


_DOCS = "de AS (SELECT DISTINCT src, dst, lower(relation) AS relation FROM edges), hc AS (SELECT src, dst FROM de WHERE relation = 'has_chunk'), g AS (SELECT src AS graph, src, dst FROM hc UNION ALL SELECT hc.src, n.src, n.dst FROM de n JOIN hc ON hc.dst = n.src WHERE n.relation = 'next_chunk')"
_MEMBERS = "b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 8 AS w FROM events), m AS (SELECT event_id, i AS interval, value AS x FROM events, b, range(0, 8) r(i) WHERE value >= lo + i * w - w * 0.25 AND value <= lo + (i + 1) * w + w * 0.25), dx AS (SELECT DISTINCT interval, x FROM m), c AS (SELECT interval, x, sum(n) OVER (PARTITION BY interval ORDER BY x) AS cluster FROM (SELECT interval, x, CASE WHEN x - lag(x) OVER (PARTITION BY interval ORDER BY x) > 0.05 THEN 1 ELSE 0 END AS n FROM dx)), mm AS (SELECT event_id, m.interval::INT AS interval, cluster::BIGINT AS cluster FROM m JOIN c ON c.interval = m.interval AND c.x = m.x)"
_LATE = "e AS (SELECT *, coalesce(ts < max(ts) OVER (ORDER BY arrival) - INTERVAL 10 MINUTE, true) AS late FROM edges_in)"
_BALANCE = f"""{_SIGNED}, und AS (SELECT u AS a, v AS b FROM p UNION SELECT v, u FROM p), walk(id, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM und) UNION SELECT und.b, walk.root FROM walk JOIN und ON und.a = walk.id AND und.b > walk.root),
lab AS (SELECT id, min(root) AS component FROM walk GROUP BY 1),
dbl AS (SELECT u || x AS a, v || CASE WHEN sign < 0 THEN CASE x WHEN '+' THEN '-' ELSE '+' END ELSE x END AS b FROM p, (VALUES ('+'), ('-')) s(x)), dun AS (SELECT a, b FROM dbl UNION SELECT b, a FROM dbl),
wd(id, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM dun) UNION SELECT dun.b, wd.root FROM wd JOIN dun ON dun.a = wd.id AND dun.b > wd.root), ld AS (SELECT id, min(root) AS part FROM wd GROUP BY 1),
pt AS (SELECT component, count(DISTINCT part) AS parts FROM ld JOIN lab ON lab.id = substr(ld.id, 1, length(ld.id) - 1) GROUP BY 1), nn AS (SELECT component, count(*) AS nodes FROM lab GROUP BY 1), ee AS (SELECT component, count(*) AS edges FROM p JOIN lab ON id = u GROUP BY 1),
bal AS (SELECT component, nodes, edges, parts = 2 AS balanced, edges - nodes + (parts = 2)::INT AS first FROM nn JOIN ee USING (component) JOIN pt USING (component))"""
_COVER = "r AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings), b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 6 AS w FROM r), m AS (SELECT vec_id, i AS interval, x FROM r, b, range(0, 6) t(i) WHERE x >= lo + i * w - w * 0.2 AND x <= lo + (i + 1) * w + w * 0.2), dx AS (SELECT DISTINCT interval, x FROM m), o AS (SELECT interval, x, CASE WHEN x - lag(x) OVER (PARTITION BY interval ORDER BY x) > 0.02 THEN 1 ELSE 0 END AS n FROM dx), cl AS (SELECT interval, x, sum(n) OVER (PARTITION BY interval ORDER BY x) AS cluster FROM o), sets AS (SELECT DISTINCT m.interval || ':' || cluster AS s, vec_id, m.x FROM m JOIN cl ON cl.interval = m.interval AND cl.x = m.x)"
_HYPER = "m AS (SELECT DISTINCT l_orderkey AS e, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), z AS (SELECT e, n, count(*) OVER (PARTITION BY e) AS de FROM m), dg AS (SELECT n, count(*) AS dv FROM m GROUP BY 1), sh AS (SELECT a.n AS i, b.n AS j, sum(1 / (a.de + 1e-12)) AS s FROM z a JOIN m b ON b.e = a.e GROUP BY 1, 2), sc AS (SELECT i, j, (CASE WHEN i = j THEN 1 ELSE 0 END - s / sqrt((x.dv + 1e-12) * (y.dv + 1e-12))) - CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM sh JOIN dg x ON x.n = i JOIN dg y ON y.n = j)"

ORACLES = {
    "topology_entropy": f"WITH {_D}, l AS (SELECT event_type, (death - birth) / sum(death - birth) OVER (PARTITION BY event_type) AS s FROM d WHERE death > birth) SELECT event_type, round(-sum(s * ln(s)), 6) AS entropy FROM l GROUP BY 1",
    "topology_betti": f"WITH {_D} SELECT event_type, t, count(*) FILTER (birth <= t AND t < death) AS betti FROM d, t GROUP BY 1, 2",
    "topology_landscape": f"WITH {_D} SELECT event_type, t, k::INT AS k, round(h, 6) AS height FROM (SELECT event_type, t, {_TENT} AS h, row_number() OVER (PARTITION BY event_type, t ORDER BY {_TENT} DESC) AS k FROM d, t) WHERE k <= 3",
    "topology_silhouette": f"WITH {_D} SELECT event_type, t, round(sum((death - birth) * {_TENT}) / sum(death - birth), 6) AS height FROM d, t GROUP BY 1, 2",
    "topology_image": f"WITH {_D}, g AS (SELECT unnest([10.0, 20.0, 30.0, 40.0])::DOUBLE AS c) SELECT event_type, gx.c AS x, gy.c AS y, round(sum((death - birth) * exp(-((birth - gx.c) * (birth - gx.c) + (death - gy.c) * (death - gy.c)) / 32)), 4) AS v FROM d, g gx, g gy GROUP BY 1, 2, 3",
    "sheaf_laplacian": f"WITH {_LAP} SELECT i, j, v FROM l",
    "sheaf_incidence": f"WITH {_SIGNED} SELECT u || '|' || v AS edge, u AS node, 1 AS v FROM p UNION ALL SELECT u || '|' || v, v, -sign FROM p",
    "sheaf_convolution": f"WITH {_LAP}, {_FEATURES}, {_layer('f1', 'f0')} SELECT node, round(x, 6) AS x FROM f1",
    "sheaf_network": f"WITH {_LAP}, {_FEATURES}, {_layer('f1', 'f0', True)}, {_layer('f2', 'f1', True)} SELECT node, round(x, 4) AS x FROM f2",
    "hypergraph_laplacian": "WITH m AS (SELECT DISTINCT l_orderkey AS e, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), s AS (SELECT e, n, count(*) OVER (PARTITION BY e) AS de FROM m), d AS (SELECT n, count(*) AS dv FROM m GROUP BY 1), h AS (SELECT a.n AS i, b.n AS j, sum(1 / (a.de + 1e-12)) AS s FROM s a JOIN m b ON a.e = b.e GROUP BY 1, 2) SELECT i, j, round(CASE WHEN i = j THEN 1 ELSE 0 END - s / sqrt((x.dv + 1e-12) * (y.dv + 1e-12)), 8) AS v FROM h JOIN d x ON x.n = i JOIN d y ON y.n = j",
    "mapper_members": f"WITH {_MEMBERS} SELECT event_id, interval, cluster FROM mm",
    "mapper_nerve": f"WITH {_MEMBERS}, s AS (SELECT DISTINCT event_id, interval || ':' || cluster AS k FROM mm) SELECT DISTINCT a.k AS a, b.k AS b FROM s a JOIN s b ON a.event_id = b.event_id AND a.k < b.k",
    "fractal_contracted": f"WITH {_DOCS} SELECT DISTINCT graph, node, graph AS box FROM (SELECT graph, src AS node FROM g UNION SELECT graph, dst FROM g)",
    "fractal_dimension": f"WITH {_DOCS} SELECT DISTINCT graph, 1::BIGINT AS boxes1, 1::BIGINT AS boxes2, 1::BIGINT AS boxes3, 0.0::DOUBLE AS dimension FROM g",
    "fractal_hierarchy": f"WITH {_DOCS} SELECT DISTINCT graph, 1::BIGINT AS level, node, graph AS box FROM (SELECT graph, src AS node FROM g UNION SELECT graph, dst FROM g)",
    "spectral_signal_back": f"WITH {_DOCS}, u AS (SELECT DISTINCT graph, least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst) SELECT graph, node, count(*)::DOUBLE AS value FROM (SELECT graph, a AS node FROM u UNION ALL SELECT graph, b FROM u) GROUP BY 1, 2",
    "sheaf_balance": f"WITH RECURSIVE {_BALANCE} SELECT component, nodes, edges, balanced, first FROM bal",
    "sheaf_consistency": f"WITH RECURSIVE {_BALANCE} SELECT component, round(1 / (1 + first), 9) AS score FROM bal UNION ALL SELECT 'all', round(1 / (1 + sum(first)), 9) FROM bal",
    "mapper_inverse": f"WITH {_COVER} SELECT DISTINCT x.vec_id AS u, y.vec_id AS v FROM sets x JOIN sets y ON y.s = x.s AND x.vec_id < y.vec_id",
    "mapper_silhouette": f"WITH {_COVER}, d AS (SELECT a.s AS own, a.vec_id, b.s, sum(abs(a.x - b.x)) AS d, count(*) AS n FROM sets a JOIN sets b ON true GROUP BY 1, 2, 3), e AS (SELECT own, vec_id, max(CASE WHEN s = own AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN s <> own THEN d / n END) AS b FROM d GROUP BY 1, 2) SELECT round(avg(CASE WHEN greatest(a, b) > 1e-12 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM e WHERE a IS NOT NULL AND b IS NOT NULL",
    "hypergraph_filtered": f"WITH {_HYPER}, x0 AS (SELECT s_nationkey AS node, avg(s_acctbal) AS x FROM supplier GROUP BY 1), x1 AS (SELECT i AS node, sum(v * x) AS x FROM sc JOIN x0 ON node = j GROUP BY 1), x2 AS (SELECT node, sum(x) AS x FROM (SELECT i AS node, 2 * v * x AS x FROM sc JOIN x1 ON node = j UNION ALL SELECT node, -x FROM x0) GROUP BY 1) SELECT node, round(sum(x), 3) AS x FROM (SELECT node, 0.5 * x AS x FROM x0 UNION ALL SELECT node, 0.3 * x FROM x1 UNION ALL SELECT node, 0.2 * x FROM x2) GROUP BY 1",
    "stream_late_events": f"WITH {_LATE} SELECT arrival, late FROM e",
    "stream_hot_edges": f"WITH {_LATE} SELECT DISTINCT src, dst FROM e WHERE NOT late AND dst IS NOT NULL",
    "stream_windows": "SELECT (floor(epoch(ts) / 30) * 30)::BIGINT AS start, count(*) AS events, count(DISTINCT (src, dst)) FILTER (dst IS NOT NULL) AS edges FROM edges_in WHERE ts IS NOT NULL GROUP BY 1",
    "stream_neighbours": f"WITH {_LATE} SELECT src, count(DISTINCT dst) AS neighbours FROM e WHERE NOT late AND dst IS NOT NULL GROUP BY 1",
}
