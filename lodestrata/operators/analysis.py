"""Description length, coverage, alignment, fits and navigation: further measures of graphs and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators.components import connected_components
from lodestrata.operators.graph import undirected
from lodestrata.session import cut


def description_length(edges: DataFrame, motifs: DataFrame, delta: float = 0.0) -> DataFrame:
    """(``motifs``, ``residual``, ``length``): motifs ln(V + 1) + residual ln(E + 1)(1 + delta), the residual being edges in no motif (motif, src, dst)."""
    pairs = undirected(edges)
    inside = undirected(motifs.select("src", "dst"))
    nodes = pairs.select(F.col("u").alias("n")).unionByName(pairs.select(F.col("v").alias("n"))).distinct().agg(F.count("*").alias("v"))
    counts = pairs.agg(F.count("*").alias("e")).crossJoin(pairs.join(inside, ["u", "v"], "left_anti").agg(F.count("*").alias("residual")))
    rows = nodes.crossJoin(counts).crossJoin(motifs.agg(F.countDistinct("motif").alias("motifs")))
    return rows.select("motifs", "residual", (F.col("motifs") * F.log(F.col("v") + 1.0) + F.col("residual") * F.log(F.col("e") + 1.0) * (1 + delta)).alias("length"))


def coverage(edges: DataFrame, used: DataFrame) -> DataFrame:
    """(``edges``, ``edge_coverage``, ``loops``, ``loop_coverage``): share of edges that were used, and of independent loops E - V + C."""
    every, some = undirected(edges), undirected(used)

    def loops(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.col("u").alias("n")).unionByName(pairs.select(F.col("v").alias("n"))).distinct().agg(F.count("*").alias("v"))
        parts = cut(connected_components(pairs, "u", "v")).select("component").distinct().agg(F.count("*").alias("c"))
        return pairs.agg(F.count("*").alias("e")).crossJoin(nodes).crossJoin(parts).select(F.col("e").alias(f"{name}_e"), (F.col("e") - F.col("v") + F.col("c")).alias(f"{name}_l"))

    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return loops(every, "all").crossJoin(loops(some, "some")).select(F.col("all_e").alias("edges"), share("some_e", "all_e").alias("edge_coverage"), F.col("all_l").alias("loops"), share("some_l", "all_l").alias("loop_coverage"))


def alignment(one: DataFrame, other: DataFrame, key: str, vec: str) -> DataFrame:
    """(``correlation``) of two views' vectors over common keys, each dimension centred, taken as one long vector."""
    a = one.select(F.col(key).alias("k"), F.posexplode(V.as_double(F.col(vec))).alias("d", "a"))
    b = other.select(F.col(key).alias("k"), F.posexplode(V.as_double(F.col(vec))).alias("d", "b"))
    both = a.join(b, ["k", "d"])
    means = both.groupBy("d").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    centred = both.join(F.broadcast(means), "d").select((F.col("a") - F.col("ma")).alias("x"), (F.col("b") - F.col("mb")).alias("y"))
    return centred.agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("correlation"))


def wasserstein(values: DataFrame, group: str, column: str) -> DataFrame:
    """(``a``, ``b``, ``distance``): W1 between the distributions of each pair of groups, as the area between their distribution functions.

    The functions are taken on a grid of the values' own quantile steps: every distinct value counts once for each group.
    """
    counts = values.groupBy(F.col(group).alias("g"), F.col(column).alias("x")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("g").agg(F.sum("n").alias("t"))
    pairs = totals.select(F.col("g").alias("a"), F.col("t").alias("ta")).crossJoin(totals.select(F.col("g").alias("b"), F.col("t").alias("tb"))).where("a < b")
    left = pairs.join(counts, F.col("a") == F.col("g")).select("a", "b", "x", (F.col("n") / F.col("ta")).alias("m"))
    right = pairs.join(counts, F.col("b") == F.col("g")).select("a", "b", "x", (-F.col("n") / F.col("tb")).alias("m"))
    steps = left.unionByName(right).groupBy("a", "b", "x").agg(F.sum("m").alias("m"))
    order = Window.partitionBy("a", "b").orderBy("x")
    area = steps.withColumn("gap", F.sum("m").over(order)).withColumn("width", F.lead("x").over(order) - F.col("x"))
    return area.groupBy("a", "b").agg(F.sum(F.abs("gap") * F.coalesce("width", F.lit(0.0))).alias("distance"))


def loglog_fit(counts: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(``by``, ``n``, ``slope``, ``length``): fit of ln y on ln x for each curve, and its description length n ln(RSS / n + 1e-12) + 2 ln n."""
    rows = counts.where((F.col(x) > 0) & (F.col(y) > 0)).select(by, F.log(x).alias("a"), F.log(y).alias("b"))
    found = rows.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope("b", "a").alias("slope"), F.regr_syy("b", "a").alias("syy"), F.regr_sxy("b", "a").alias("sxy"))
    rss = F.greatest(F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0)), F.lit(0.0))
    return found.select(by, "n", "slope", (F.col("n") * F.log(rss / F.col("n") + 1e-12) + 2 * F.log("n")).alias("length"))


def reweighted(local: DataFrame, whole: DataFrame, key: str, share: str, threshold: float = 0.1, factor: float = 1.2) -> DataFrame:
    """(``key``, ``weight``): ``factor`` for under-represented keys where the mean difference of the sorted shares exceeds the ``threshold``, else 1."""
    both = whole.select(key, F.col(share).alias("w")).join(local.select(key, F.col(share).alias("l")), key, "left").withColumn("l", F.coalesce("l", F.lit(0.0)))
    a = both.select("l", F.row_number().over(Window.orderBy("l")).alias("i"))
    b = both.select("w", F.row_number().over(Window.orderBy("w")).alias("i"))
    distance = a.join(b, "i").agg(F.avg(F.abs(F.col("l") - F.col("w"))).alias("d"))
    return both.crossJoin(F.broadcast(distance)).select(key, F.when((F.col("d") > threshold) & (F.col("l") < F.col("w")), factor).otherwise(1.0).alias("weight"))


def greedy_paths(vectors: DataFrame, key: str, vec: str, goals: DataFrame) -> DataFrame:
    """(``start``, ``goal``, ``hop``, ``total``): the best single stop between each asked pair (start, goal) by hyperbolic distance, the ends left out."""
    rows = vectors.select(F.col(key).alias("k"), F.col(vec).alias("v"))
    asked = goals.join(rows.select(F.col("k").alias("start"), F.col("v").alias("s")), "start").join(rows.select(F.col("k").alias("goal"), F.col("v").alias("g")), "goal")
    met = rows.crossJoin(F.broadcast(asked)).where("k <> start AND k <> goal")
    total = V.poincare_distance(F.col("s"), F.col("v")) + V.poincare_distance(F.col("v"), F.col("g"))
    return met.groupBy("start", "goal").agg(F.min_by(F.struct("k", total.alias("total")), F.struct(total, "k")).alias("r")).select("start", "goal", F.col("r.k").alias("hop"), F.col("r.total").alias("total"))


def quotient(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(``u``, ``v``): pairs of different classes (node, class) that an edge joins."""
    a, b = classes.select(F.col("node").alias("src"), F.col("class").alias("p")), classes.select(F.col("node").alias("dst"), F.col("class").alias("q"))
    return edges.join(a, "src").join(b, "dst").where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()


def multiplex(layers: list[tuple[DataFrame, float]]) -> DataFrame:
    """(``i``, ``j``, ``v``): the weighted sum of matrices, the weights made to sum to 1."""
    total = sum(w for _, w in layers)
    rows = [m.select("i", "j", (F.col("v") * (w / total)).alias("v")) for m, w in layers]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def regression_status(value: Column, baseline: Column, tolerance: float = 0.05) -> Column:
    """``worse`` beyond the tolerance above the baseline, ``better`` beyond it below, else ``same``."""
    return F.when(value > baseline * (1 + tolerance), "worse").when(value < baseline * (1 - tolerance), "better").otherwise("same")


def expected_recall(probes: int, cells: int, tables: int) -> float:
    return 1 - (1 - probes / cells) ** tables


def probes_for(cells: int, tables: int) -> int:
    return max(1, round(math.sqrt(cells / tables)))


def best_subset(items: list[tuple[str, float, int]], budget: int) -> tuple[list[str], float]:
    """Exact 0/1 knapsack of (name, benefit, whole risk): a small plan, made on the driver."""
    best: dict[int, tuple[float, tuple[str, ...]]] = {0: (0.0, ())}
    for name, benefit, risk in items:
        for spent, (value, chosen) in sorted(best.items(), reverse=True):
            now = spent + risk
            if now <= budget and (now not in best or best[now][0] < value + benefit):
                best[now] = (value + benefit, (*chosen, name))
    value, chosen = max(best.values(), key=lambda x: (x[0], -len(x[1])))
    return list(chosen), value


def random_graph(spark, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """(``src``, ``dst``): ``edges`` different pairs of ``nodes``, the same for the same seed.

    Pairs are taken in the order of a hash: all of them where many are asked for, drawn ones (until there are enough) where few are.
    """
    every = nodes * (nodes - 1) // 2
    if edges > every:
        raise ValueError(f"{nodes} nodes have {every} pairs only")
    order = F.xxhash64(F.lit(seed), "src", "dst")
    if edges * 4 > every:
        ids = spark.range(nodes)
        pairs = ids.withColumnRenamed("id", "src").join(ids.withColumnRenamed("id", "dst"), F.col("src") < F.col("dst"))
        return pairs.orderBy(order, "src", "dst").limit(edges)
    draws = edges * 2
    while True:
        drawn = spark.range(draws).select(F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(0)), F.lit(nodes)).alias("a"), F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(1)), F.lit(nodes)).alias("b"), "id")
        pairs = drawn.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "id").groupBy("src", "dst").agg(F.min("id").alias("id"))
        if pairs.count() >= edges:
            return pairs.orderBy("id").limit(edges).select("src", "dst")
        draws *= 2
