"""Quality passes, reviews, upkeep by what changed, and choices among vectors, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import graph as G
from lodestrata.operators import layers as Y
from lodestrata.operators import numeric as N
from lodestrata.plans import topology
from lodestrata.plans.analysis import _dist
from lodestrata.plans.graph import _COMPONENTS, _sql
from lodestrata.plans.search import _V, _dot, _norm
from lodestrata.plans.topology import _DOCS
from lodestrata.tables import table


def layer_quality(spark, sf_dir):
    """Nodes with a fault: small components, repeated texts."""
    return Y.quality_faults(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))


def graph_annotated_levels(spark, sf_dir):
    """Nodes with the box that holds them at the first level of their document's graph; those without edges have none."""
    boxes = topology.fractal_hierarchy(spark, sf_dir).where("level = 1").groupBy(F.col("node").alias("id")).agg(F.min("box").alias("box"))
    return G.distinct_nodes(table(spark, sf_dir, "nodes")).join(boxes, "id", "left").select("id", "type", "box")


def mapper_balls(spark, sf_dir):
    """Balls of radius 1 that cover each document's graph, by their first node; they may overlap."""
    return N.per_graph(topology._document_graphs(spark, sf_dir), "graph", N.overlapping_balls, "ball string, node string")


def keep_upserted(spark, sf_dir):
    """Balances of customers with those of every seventh set anew, and a new customer."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changes = rows.where("c_custkey % 7 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).unionByName(spark.createDataFrame([(-1, 1.0)], "c_custkey bigint, c_acctbal double"))
    return Y.upserted(rows, changes, "c_custkey")


def stream_review_queue(spark, sf_dir):
    """Edges of a similarity above 0.8 that wait for a review; those with a provenance count as reviewed."""
    edges = table(spark, sf_dir, "edges")
    return Y.pending(edges, edges.where("provenance IS NOT NULL AND similarity IS NOT NULL"), "similarity", 0.8).select("src", "dst", F.round("similarity", 9).alias("similarity"))


def stream_changed_nodes(spark, sf_dir):
    """Nodes whose neighbours change when similar_to edges come."""
    edges = table(spark, sf_dir, "edges")
    return Y.changed_nodes(edges.where(F.lower("relation") != "similar_to"), edges)


def vector_prototypes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))
    return Y.prototypes(rows, "vec_id", "label", "v").select("label", "vec_id", F.round("cosine", 6).alias("cosine"))


def search_diverse_vectors(spark, sf_dir):
    """Four vectors as far apart as a greedy choice makes them."""
    return Y.farthest_first(table(spark, sf_dir, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v")), "vec_id", "v", 4)


def graph_path_curvatures(spark, sf_dir):
    """The best single stop between each fiftieth vector and the next by the mean of the distances under two curvatures."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.as_double(F.col("embedding")), lambda x: x / 4).alias("v"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("start"), F.col("v").alias("s"))
    goals = rows.select((F.col("vec_id") - 1).alias("start"), F.col("vec_id").alias("goal"), F.col("v").alias("g"))
    met = rows.crossJoin(F.broadcast(asked.join(goals, "start"))).where("vec_id <> start AND vec_id <> goal")
    half = lambda c: F.transform(c, lambda x: x / 2)
    # a quarter of the curvature is the distance of halved vectors, doubled
    mean = lambda a, b: 0.5 * V.poincare_distance(F.col(a), F.col(b)) + V.poincare_distance(half(a), half(b))
    total = mean("s", "v") + mean("v", "g")
    best = met.groupBy("start", "goal").agg(F.min_by(F.struct("vec_id", total.alias("t")), F.struct(F.round(total, 9), "vec_id")).alias("r"))
    return best.select("start", "goal", F.col("r.vec_id").alias("hop"), F.round("r.t", 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (layer_quality, graph_annotated_levels, mapper_balls, keep_upserted, stream_review_queue, stream_changed_nodes, vector_prototypes, search_diverse_vectors, graph_path_curvatures)
}

_NEAR = "SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst"
_APART = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _farthest(step: int) -> str:
    """The ``step``-th choice, given those before it."""
    chosen = " UNION ALL ".join(f"SELECT vec_id FROM f{i}" for i in range(step))
    return f"f{step} AS (SELECT a.vec_id FROM v a, v b WHERE b.vec_id IN ({chosen}) GROUP BY 1 HAVING min({_APART}) > 0 ORDER BY min(round({_APART}, 9)) DESC, 1 LIMIT 1)"


def _mean_distance(a, b):
    halves = [f"list_transform({x}, lambda z: z / 2)" for x in (a, b)]
    return f"(0.5 * {_dist(a, b)} + {_dist(*halves)})"


ORACLES = {
    "layer_quality": _sql("SELECT id, 'small component' AS fault FROM al JOIN sz USING (component) WHERE size < 3 UNION ALL SELECT id, 'repeated text' FROM (SELECT id, pos, min(pos) OVER (PARTITION BY text) AS f FROM dn WHERE type = 'chunk' AND text IS NOT NULL) WHERE pos > f", _COMPONENTS, recursive=True),
    "graph_annotated_levels": f"WITH {_DOCS}, b AS (SELECT node, min(graph) AS box FROM (SELECT graph, src AS node FROM g UNION SELECT graph, dst FROM g) GROUP BY 1) SELECT id, type, box FROM (SELECT id, arg_min({{'v': lower(type)}}, pos).v AS type FROM nodes GROUP BY id) LEFT JOIN b ON node = id",
    "mapper_balls": f"WITH {_DOCS} SELECT DISTINCT graph, graph AS ball, node FROM (SELECT graph, src AS node FROM g UNION SELECT graph, dst FROM g)",
    "keep_upserted": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 1.0",
    "stream_review_queue": "SELECT src, dst, round(max(similarity), 9) AS similarity FROM edges WHERE similarity > 0.8 AND (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE provenance IS NOT NULL AND similarity IS NOT NULL) GROUP BY 1, 2",
    "stream_changed_nodes": f"WITH o AS ({_NEAR} AND lower(relation) <> 'similar_to'), n AS ({_NEAR}), d AS (SELECT * FROM n EXCEPT SELECT * FROM o) SELECT u AS id FROM d UNION SELECT v FROM d",
    "vector_prototypes": f"WITH {_V}, e AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY 1, 2), m AS (SELECT label, list(m ORDER BY i) AS m FROM e GROUP BY 1), s AS (SELECT v.label, vec_id, round({_dot('v', 'm')} / ({_norm('v')} * {_norm('m')}), 9) AS c FROM v JOIN m ON m.label = v.label) SELECT label, vec_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS n FROM s) WHERE n = 1",
    "search_diverse_vectors": f"WITH {_V}, f0 AS (SELECT min(vec_id) AS vec_id FROM v), {', '.join(_farthest(i) for i in (1, 2, 3))} " + " UNION ALL ".join(f"SELECT {i} AS n, vec_id FROM f{i}" for i in range(4)),
    "graph_path_curvatures": f"WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / 4) AS v FROM embeddings), m AS (SELECT s.vec_id AS start, g.vec_id AS goal, k.vec_id AS hop, {_mean_distance('s.v', 'k.v')} + {_mean_distance('k.v', 'g.v')} AS total FROM v s JOIN v g ON s.vec_id % 50 = 0 AND g.vec_id = s.vec_id + 1 JOIN v k ON k.vec_id NOT IN (s.vec_id, g.vec_id)) SELECT start, goal, hop, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY round(total, 9), hop) AS n FROM m) WHERE n = 1",
}
