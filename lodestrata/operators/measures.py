"""Measures of graphs, pairs and vectors: aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import degrees, triangles, undirected


def entropy_of(values: DataFrame, column: str) -> DataFrame:
    """(``entropy``): Shannon entropy in bits of the distribution of ``column``."""
    counts = values.groupBy(column).agg(F.count("*").alias("n"))
    share = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select((F.col("n") / F.col("all")).alias("p"))
    return share.agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)).alias("entropy"))


def graph_entropy(edges: DataFrame) -> DataFrame:
    """Entropy of the degrees of nodes with edges."""
    return entropy_of(degrees(edges), "degree")


def structural_entropy(edges: DataFrame, tau: int) -> DataFrame:
    """Entropy of degrees after edges at nodes in fewer than ``tau`` triangles are dropped; their nodes stay with degree 0."""
    corners = triangles(edges)
    members = corners.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t")).where(F.col("t") >= tau).select("id")
    pairs = undirected(edges)
    kept = pairs.join(members.withColumnRenamed("id", "u"), "u", "left_semi").join(members.withColumnRenamed("id", "v"), "v", "left_semi")
    own = degrees(kept.withColumnsRenamed({"u": "src", "v": "dst"}))
    every = degrees(edges).select("id").join(own, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return entropy_of(every, "degree")


def trust(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``source``, ``n``, ``trust``): how often a source occurs on nodes and edges, a third each, 1 at most."""
    seen = nodes.select("source").unionByName(edges.select(F.col("provenance").alias("source"))).where("source IS NOT NULL")
    return seen.groupBy("source").agg(F.count("*").alias("n")).withColumn("trust", F.least(F.lit(1.0), F.col("n") / 3))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``id``, ``centrality``): in- and out-edges of each distinct node over the number of other nodes."""
    directed = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    ends = directed.select(F.col("src").alias("id")).unionByName(directed.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    ids = nodes.select("id").distinct()
    total = ids.agg((F.count("*") - 1).alias("others"))
    return ids.join(ends, "id", "left").crossJoin(F.broadcast(total)).select("id", (F.coalesce("d", F.lit(0)) / F.greatest("others", F.lit(1))).alias("centrality"))


def hyper_adamic_adar(members: DataFrame, edge: str, node: str) -> DataFrame:
    """(``u``, ``v``, ``score``): for pairs in a hyperedge of n > 2 nodes 1 / ln(n - 1), summed; pairs of two alone score 0."""
    rows = members.select(F.col(edge).alias("e"), F.col(node).alias("n")).distinct()
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("e")))
    weight = F.when(F.col("size") > 2, 1 / F.log((F.col("size") - 1).cast("double"))).otherwise(0.0)
    left = sized.withColumn("w", weight).withColumnRenamed("n", "u")
    right = sized.select("e", F.col("n").alias("v"))
    return left.join(right, "e").where("u < v").groupBy("u", "v").agg(F.sum("w").alias("score"))


def curation_metrics(pairs: DataFrame, threshold: float, rating: str = "rating") -> DataFrame:
    """Counts, retention and both average scores (over all pairs, and over rated ones); halves round to even."""
    if not 0 <= threshold <= 10:
        raise ValueError("threshold must be between 0 and 10")
    value = F.when(F.isnan(rating), F.lit(None)).otherwise(F.col(rating))
    kept = F.count_if(value >= threshold)
    total = F.count("*")
    return pairs.agg(
        total.alias("total"),
        kept.alias("filtered"),
        F.bround(kept / F.greatest(total, F.lit(1)), 2).alias("retention_rate"),
        F.bround(F.coalesce(F.sum(value), F.lit(0.0)) / F.greatest(total, F.lit(1)), 1).alias("avg_over_all"),
        F.bround(F.avg(value), 1).alias("avg_over_rated"),
    )


def indexed_percentile(values: DataFrame, key: str, column: str, share: float, shift: int = 0) -> DataFrame:
    """(``key``, ``value``): the element at int(share (n - 1)) - or int(share n) - 1 with ``shift`` - of each sorted group, without interpolation."""
    # equal values are counted before the window, so that it holds distinct values only
    counts = values.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("c"))
    window = Window.partitionBy(key)
    summed = counts.withColumn("upto", F.sum("c").over(window.orderBy(column))).withColumn("n", F.sum("c").over(window))
    at = F.greatest(F.floor(F.lit(share) * F.col("n")) - 1, F.lit(0)) if shift else F.floor(F.lit(share) * (F.col("n") - 1))
    return summed.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(key, F.col(column).alias("value"))


def mean_vector(vectors: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """(``by``..., ``d``, ``mean``): the mean of each dimension, a row each."""
    by = by or []
    rows = vectors.select(*by, F.posexplode(vec).alias("d", "x"))
    return rows.groupBy(*by, "d").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def linear_mmd(one: DataFrame, other: DataFrame, vec: str) -> DataFrame:
    """(``mmd``): squared distance of the mean vectors."""
    a, b = mean_vector(one, vec).withColumnRenamed("mean", "a"), mean_vector(other, vec).withColumnRenamed("mean", "b")
    return a.join(b, "d").agg(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("mmd"))


def renyi_epsilon(budgets: DataFrame, key: str, epsilon: str, orders: range = range(2, 33)) -> DataFrame:
    """(``key``, ``epsilon``): least over the orders a of ln(sum exp((a - 1) e)) / (a - 1), by log-sum-exp."""
    rows = budgets.select(F.col(key).alias("k"), F.col(epsilon).cast("double").alias("e"))
    # orders exceed 1, so the greatest e has the greatest exponent of every order: a row a key, and no row is repeated for each order
    peak = rows.groupBy("k").agg(F.max("e").alias("m"))
    x = lambda a, c: (a - 1) * F.col(c)
    sums = [F.sum(F.exp(x(a, "e") - x(a, "m"))).alias(f"s{a}") for a in orders]
    # sorted rather than hashed or broadcast: keys grow with the rows
    summed = rows.join(peak.hint("merge"), "k").groupBy("k", "m").agg(*sums)
    return summed.select(F.col("k").alias(key), F.array_min(F.array(*[(x(a, "m") + F.log(f"s{a}")) / (a - 1) for a in orders])).alias("epsilon"))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(``recall``): mean over queries with truth of the share of it among the first ``k`` found (query, item, rank)."""
    sizes = truth.groupBy("query").agg(F.count("*").alias("n"))
    hits = found.where(F.col("rank") <= k).join(truth, ["query", "item"], "left_semi").groupBy("query").agg(F.count("*").alias("h"))
    return sizes.join(hits, "query", "left").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def lacunarity(edges: DataFrame) -> DataFrame:
    """(``lacunarity``): variance over squared mean, plus 1, of the numbers of nodes within one step (the node counts)."""
    mass = degrees(edges).select((F.col("degree") + 1).alias("m"))
    return mass.agg((F.var_pop("m") / F.pow(F.avg("m"), F.lit(2.0)) + 1).alias("lacunarity"))


def mean_hours_between(failures: DataFrame, key: str, ts: str) -> DataFrame:
    """(``key``, ``hours``): mean time between consecutive failures."""
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(Window.partitionBy(key).orderBy(ts)))
    return failures.select(key, gap.alias("gap")).groupBy(key).agg((F.avg("gap") / 3.6e9).alias("hours"))
