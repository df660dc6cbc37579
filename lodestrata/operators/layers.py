"""Passes over a graph that several operators make together, upkeep of tables by what changed, and choices among vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import graph as G
from lodestrata.operators.measures import mean_vector
from lodestrata.session import cut


def quality_faults(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(``id``, ``fault``): nodes in components of fewer than ``least``, and chunks whose text an earlier one has."""
    small = G.component_sizes(nodes, edges).where(F.col("size") < least).select("id", F.lit("small component").alias("fault"))
    chunks = G.distinct_nodes(nodes).where("type = 'chunk' AND text IS NOT NULL").select("id", "pos", "text")
    first = chunks.groupBy("text").agg(F.min("pos").alias("first"))
    repeated = chunks.join(first, "text").where("pos > first").select("id", F.lit("repeated text").alias("fault"))
    return small.unionByName(repeated)


def upserted(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``changes`` (of the same columns, each key once) in place of their own, and the new ones."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def pending(edges: DataFrame, reviewed: DataFrame, value: str, least: float) -> DataFrame:
    """(``src``, ``dst``, ``value``): edges above ``least`` that no review (src, dst) has settled, each pair once with its greatest value."""
    found = edges.where(F.col(value) > least).groupBy("src", "dst").agg(F.max(value).alias(value))
    return found.join(reviewed.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def neighbourhood_digests(edges: DataFrame) -> DataFrame:
    """(``id``, ``digest``) of each node's distinct neighbours, in order; sums of two hashes, so that a hub's neighbours are never gathered."""
    pairs = G.undirected(edges)
    both = pairs.select(F.col("u").alias("id"), F.col("v").alias("near")).unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("near")))
    part = lambda n: F.sum(F.xxhash64(F.lit(n), "near").cast("decimal(38,0)"))
    return both.groupBy("id").agg(F.concat_ws(":", F.count("*"), part(1), part(2)).alias("digest"))


def changed_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(``id``): nodes whose neighbours aren't what they were, gone and new ones among them."""
    old, new = neighbourhood_digests(before), neighbourhood_digests(after).withColumnRenamed("digest", "now")
    return old.join(new, "id", "full").where(~F.col("digest").eqNullSafe(F.col("now"))).select("id")


def prototypes(vectors: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    """(``label``, ``key``, ``cosine``): of each label the vector most like the mean of all of it, the least key among equals."""
    means = mean_vector(vectors, vec, [label]).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "mean"))), lambda s: s["mean"]).alias("_m"))
    scored = vectors.join(means, label).withColumn("cosine", F.round(V.cosine(F.col(vec), F.col("_m")), 9))
    return scored.groupBy(label).agg(F.min_by(F.struct(key, "cosine"), F.struct(-F.col("cosine"), key)).alias("p")).select(label, f"p.{key}", "p.cosine")


def farthest_first(vectors: DataFrame, key: str, vec: str, count: int) -> DataFrame:
    """(``n``, ``key``): the least key, then ``count`` - 1 times the vector farthest from all chosen (the least key among equals): a pass over the table each."""
    rows = vectors.select(key, F.col(vec).alias("v"))
    chosen = [rows.orderBy(key).first()]
    if chosen[0] is None:
        return vectors.sparkSession.createDataFrame([], f"n int, {key} {vectors.schema[key].dataType.simpleString()}")
    apart = rows.withColumn("d", F.lit(float("inf")))
    while len(chosen) < count:
        last = F.array(*map(F.lit, [float(x) for x in chosen[-1]["v"]]))
        apart = cut(apart.withColumn("d", F.least("d", F.round(F.sqrt(V.squared_distance(F.col("v"), last)), 9))))
        best = apart.where("d > 0").orderBy(F.desc("d"), key).first()
        if best is None:
            break
        chosen.append(best)
    return vectors.sparkSession.createDataFrame([(n, r[key]) for n, r in enumerate(chosen)], f"n int, {key} {vectors.schema[key].dataType.simpleString()}")


def steep_radius(counts: dict[float, int], target: float) -> float | None:
    """The least radius at which the slope of the logarithms of box counts up to it reaches the ``target``, by halving the range; None if none does."""
    from numpy import log, polyfit

    radii = sorted(counts)
    slope = lambda k: -polyfit(log(radii[: k + 1]), log([counts[r] for r in radii[: k + 1]]), 1)[0] if k else 0.0
    low, high = 1, len(radii) - 1
    if high < 1 or slope(high) < target:
        return None
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if slope(middle) >= target else (middle + 1, high)
    return radii[low]
