"""Persistence diagrams, sheaves, hypergraphs and covers as tables.

A diagram is (graph, birth, death); a matrix is (i, j, v) with absent entries 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def life(birth: str = "birth", death: str = "death") -> Column:
    return F.col(death) - F.col(birth)


def diagram_entropy(diagram: DataFrame, graph: str) -> DataFrame:
    """(``graph``, ``entropy``): natural entropy of the shares of positive lives."""
    rows = diagram.withColumn("l", life()).where("l > 0")
    total = rows.groupBy(graph).agg(F.sum("l").alias("total"))
    share = F.col("l") / F.col("total")
    return rows.join(total, graph).groupBy(graph).agg((-F.sum(share * F.log(share))).alias("entropy"))


def _on_grid(diagram: DataFrame, times: list[float]) -> DataFrame:
    return diagram.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])))


def betti_curve(diagram: DataFrame, graph: str, times: list[float]) -> DataFrame:
    """(``graph``, ``t``, ``betti``): features alive at each time."""
    alive = (F.col("birth") <= F.col("t")) & (F.col("t") < F.col("death"))
    return _on_grid(diagram, times).groupBy(graph, "t").agg(F.count_if(alive).alias("betti"))


def landscape(diagram: DataFrame, graph: str, times: list[float], layers: int) -> DataFrame:
    """(``graph``, ``t``, ``k``, ``height``): the k largest tents at each time."""
    tent = F.greatest(F.least(F.col("t") - F.col("birth"), F.col("death") - F.col("t")), F.lit(0.0))
    rows = _on_grid(diagram, times).withColumn("height", tent)
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(graph, "t").orderBy(F.desc("height"))))
    return ranked.where(F.col("k") <= layers).select(graph, "t", "k", "height")


def silhouette(diagram: DataFrame, graph: str, times: list[float], power: float = 1.0) -> DataFrame:
    """(``graph``, ``t``, ``height``): tents averaged with the weights life^power."""
    tent = F.greatest(F.least(F.col("t") - F.col("birth"), F.col("death") - F.col("t")), F.lit(0.0))
    weight = F.pow(life(), F.lit(power))
    return _on_grid(diagram, times).groupBy(graph, "t").agg((F.sum(weight * tent) / F.sum(weight)).alias("height"))


def persistence_image(diagram: DataFrame, graph: str, cells: list[float], sigma: float) -> DataFrame:
    """(``graph``, ``x``, ``y``, ``v``): Gaussians at (birth, death), weighted by life, summed at each cell."""
    axis = F.array(*[F.lit(float(c)) for c in cells])
    rows = diagram.withColumn("x", F.explode(axis)).withColumn("y", F.explode(axis))
    square = F.pow(F.col("birth") - F.col("x"), F.lit(2.0)) + F.pow(F.col("death") - F.col("y"), F.lit(2.0))
    return rows.groupBy(graph, "x", "y").agg(F.sum(life() * F.exp(-square / (2 * sigma * sigma))).alias("v"))


def signed_pairs(edges: DataFrame, sign: Column) -> DataFrame:
    """(``u``, ``v``, ``sign``): each pair of different ends once, with the least sign of its edges."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), sign.alias("sign"))
    return rows.groupBy("u", "v").agg(F.min("sign").alias("sign"))


def sheaf_laplacian(pairs: DataFrame) -> DataFrame:
    """(``i``, ``j``, ``v``): degrees on the diagonal, minus the sign beside it."""
    both = pairs.select(F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("sign")).alias("v")).unionByName(pairs.select(F.col("v").alias("i"), F.col("u").alias("j"), (-F.col("sign")).alias("v")))
    diagonal = both.groupBy("i").agg(F.count("*").cast("double").alias("v")).select("i", F.col("i").alias("j"), "v")
    return both.withColumn("v", F.col("v").cast("double")).unionByName(diagonal)


def sheaf_incidence(pairs: DataFrame) -> DataFrame:
    """(``edge``, ``node``, ``v``): 1 at the first end, minus the sign at the other."""
    edge = F.concat_ws("|", "u", "v").alias("edge")
    return pairs.select(edge, F.col("u").alias("node"), F.lit(1).alias("v")).unionByName(pairs.select(edge, F.col("v").alias("node"), (-F.col("sign")).cast("int").alias("v")))


def sheaf_convolution(pairs: DataFrame, features: DataFrame, alpha: float, layers: int = 1, rectified: bool = False) -> DataFrame:
    """(``node``, ``x``) after ``layers`` of x - alpha L x; nodes without a feature count as 0."""
    matrix = sheaf_laplacian(pairs)
    current = features.select("node", F.col("x").cast("double").alias("x"))
    for _ in range(layers):
        pushed = matrix.join(current.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("v") * F.col("x")).alias("lx"))
        new = F.coalesce("x", F.lit(0.0)) - alpha * F.coalesce("lx", F.lit(0.0))
        current = current.join(pushed, "node", "full").select("node", (F.greatest(new, F.lit(0.0)) if rectified else new).alias("x"))
    return current


def hypergraph_laplacian(members: DataFrame) -> DataFrame:
    """(``i``, ``j``, ``v``) of I - Dv^-1/2 B W De^-1 B' Dv^-1/2 for ``members`` (edge, node) with unit weights."""
    rows = members.select("edge", "node").distinct()
    sizes = rows.groupBy("edge").agg(F.count("*").alias("de"))
    degrees = rows.groupBy("node").agg(F.count("*").alias("dv"))
    left = rows.join(sizes, "edge").withColumnRenamed("node", "i")
    right = rows.withColumnRenamed("node", "j")
    shared = left.join(right, "edge").groupBy("i", "j").agg(F.sum(1 / (F.col("de") + 1e-12)).alias("s"))
    with_i = shared.join(degrees.select(F.col("node").alias("i"), F.col("dv").alias("di")), "i")
    both = with_i.join(degrees.select(F.col("node").alias("j"), F.col("dv").alias("dj")), "j")
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - F.col("s") / F.sqrt((F.col("di") + 1e-12) * (F.col("dj") + 1e-12))
    return both.select("i", "j", value.alias("v"))


def power_iteration(matrix: DataFrame, rounds: int = 20) -> DataFrame:
    """(``lambda``): the largest eigenvalue of a symmetric (i, j, v) matrix by power iteration as joins."""
    from lodestrata.session import cut

    x = matrix.select(F.col("i").alias("n")).distinct().select("n", (1 + F.pmod(F.xxhash64("n"), F.lit(7)) / 7.0).alias("x"))
    for n in range(rounds):
        y = matrix.join(x.withColumnRenamed("n", "j"), "j").groupBy(F.col("i").alias("n")).agg(F.sum(F.col("v") * F.col("x")).alias("x"))
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        x = y.crossJoin(F.broadcast(norm)).select("n", (F.col("x") / F.col("norm")).alias("x"))
        if n % 2:
            x = cut(x)
    y = matrix.join(x.withColumnRenamed("n", "j"), "j").groupBy(F.col("i").alias("n")).agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return y.join(x, "n").agg(F.sum(F.col("y") * F.col("x")).alias("lambda"))


def mapper_intervals(values: DataFrame, key: str, lens: str, n: int, overlap: float, gap: float) -> DataFrame:
    """(``key``, ``interval``, ``cluster``): members of overlapping intervals of the lens, split where sorted values lie more than ``gap`` apart."""
    bounds = values.agg(F.min(lens).alias("lo"), F.max(lens).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n
    spread = values.select(key, F.col(lens).alias("x")).crossJoin(F.broadcast(bounds)).withColumn("interval", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.col("lo") + F.col("interval") * width - width * overlap
    end = F.col("lo") + (F.col("interval") + 1) * width + width * overlap
    inside = spread.where((F.col("x") >= start) & (F.col("x") <= end)).select(key, "interval", "x")
    # clusters of distinct values, so that repeated values don't crowd a window
    distinct = inside.select("interval", "x").distinct()
    order = Window.partitionBy("interval").orderBy("x")
    opened = distinct.withColumn("new", F.when(F.col("x") - F.lag("x").over(order) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("new").over(order))
    return inside.join(opened.select("interval", "x", "cluster"), ["interval", "x"]).select(key, "interval", "cluster")


def nerve(members: DataFrame, key: str) -> DataFrame:
    """(``a``, ``b``): cover sets (interval, cluster) that share a member."""
    sets = members.select(key, F.concat_ws(":", "interval", "cluster").alias("a")).distinct()
    return sets.join(sets.withColumnRenamed("a", "b"), key).where("a < b").select("a", "b").distinct()


def balanced_components(pairs: DataFrame) -> DataFrame:
    """(``component``, ``nodes``, ``edges``, ``balanced``, ``first``) of the graph of signed ``pairs`` (u, v, sign).

    A component is balanced if its nodes can be told apart so that just the negative edges join different ones: then its signed
    Laplacian has a vector it sends to 0, and ``first`` (the dimension of the first cohomology) is edges - nodes + 1, else edges - nodes.
    It is balanced just if the graph of doubled nodes (v, +), (v, -), which positive edges join straight and negative ones across, falls
    into two parts over it.  So whole graphs of any size are settled by connected components, with no matrix.
    """
    from lodestrata.operators.components import connected_components
    from lodestrata.session import cut

    plain = cut(connected_components(pairs, "u", "v"))
    side = lambda c, s: F.concat(F.col(c).cast("string"), F.lit(s))
    across = F.col("sign") < 0
    doubled = pairs.select(side("u", "+").alias("a"), F.when(across, side("v", "-")).otherwise(side("v", "+")).alias("b")).unionByName(
        pairs.select(side("u", "-").alias("a"), F.when(across, side("v", "+")).otherwise(side("v", "-")).alias("b"))
    )
    parts = cut(connected_components(doubled, "a", "b")).withColumn("node", F.expr("substring(node, 1, length(node) - 1)"))
    labelled = plain.withColumn("node", F.col("node").cast("string"))
    counts = parts.join(labelled.withColumnRenamed("component", "own"), "node").groupBy("own").agg(F.countDistinct("component").alias("parts"))
    nodes = plain.groupBy("component").agg(F.count("*").alias("nodes"))
    edges = pairs.join(plain.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.count("*").alias("edges"))
    found = nodes.join(edges, "component").join(counts.withColumnRenamed("own", "component"), "component")
    balanced = F.col("parts") == 2
    return found.select("component", "nodes", "edges", balanced.alias("balanced"), (F.col("edges") - F.col("nodes") + balanced.cast("int")).alias("first"))


def inverse_mapper(members: DataFrame, key: str) -> DataFrame:
    """(``u``, ``v``): members of one set of a cover (interval, cluster), each pair once."""
    sets = members.select(F.concat_ws(":", "interval", "cluster").alias("s"), key).distinct()
    return sets.withColumnRenamed(key, "u").join(sets.withColumnRenamed(key, "v"), "s").where("u < v").select("u", "v").distinct()


def cover_silhouette(members: DataFrame, key: str, lens: DataFrame, x: str) -> DataFrame:
    """(``silhouette``): the mean over members of sets of more than one of how much nearer on the ``lens`` (key, x) the own set lies than the next.

    Sums over sorted values stand in for distances to every member: each set costs its distinct members times the sets, not their pairs.
    """
    rows = members.select(F.concat_ws(":", "interval", "cluster").alias("s"), key).distinct().join(lens.select(key, F.col(x).cast("double").alias("x")), key)
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    # all members against all sets: the sum of distances to a set follows from how many of it lie below and their sum
    asked = rows.select(F.col("s").alias("own"), key, F.col("x").alias("at")).crossJoin(F.broadcast(sizes))
    marks = rows.select("s", "x", F.lit(1).alias("one"))
    order = Window.partitionBy("s").orderBy("x")
    below = marks.groupBy("s", "x").agg(F.sum("one").alias("c")).withColumn("count", F.sum("c").over(order)).withColumn("sum", F.sum(F.col("c") * F.col("x")).over(order)).select(F.col("s"), "x", "count", "sum")
    # the last value of the set not above the member's
    both = asked.select("s", "own", key, "at", "n", "total", F.col("at").alias("x"), F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("double").alias("sum"))
    known = below.select("s", F.lit(None).cast("string").alias("own"), F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(None).cast("double").alias("at"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("total"), "x", "count", "sum")
    carried = Window.partitionBy("s").orderBy("x", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.unionByName(known).withColumn("k", F.coalesce(F.last("count", ignorenulls=True).over(carried), F.lit(0))).withColumn("below", F.coalesce(F.last("sum", ignorenulls=True).over(carried), F.lit(0.0)))
    summed = filled.where("own IS NOT NULL").withColumn("d", F.col("at") * F.col("k") - F.col("below") + (F.col("total") - F.col("below")) - F.col("at") * (F.col("n") - F.col("k")))
    inside = F.max(F.when(F.col("s") == F.col("own"), F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)))).alias("a")
    nearest = F.min(F.when(F.col("s") != F.col("own"), F.col("d") / F.col("n"))).alias("b")
    each = summed.groupBy("own", key).agg(inside, nearest).where("a IS NOT NULL AND b IS NOT NULL")
    value = F.when(F.greatest("a", "b") > 1e-12, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return each.agg(F.avg(value).alias("silhouette"))


def chebyshev_filtered(matrix: DataFrame, features: DataFrame, weights: list[float], largest: float = 2.0) -> DataFrame:
    """(``node``, ``x``): the weighted sum of Chebyshev polynomials of a matrix (i, j, v), scaled to [-1, 1] by its ``largest`` eigenvalue, of the features."""
    scaled = matrix.select("i", "j", (F.col("v") * (2 / largest) - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("v"))
    push = lambda x: scaled.join(x.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("v") * F.col("x")).alias("x"))
    terms = [features.select("node", F.col("x").cast("double").alias("x"))]
    if len(weights) > 1:
        terms.append(push(terms[0]))
    while len(terms) < len(weights):
        before = terms[-2].select("node", (-F.col("x")).alias("x"))
        terms.append(push(terms[-1]).select("node", (2 * F.col("x")).alias("x")).unionByName(before).groupBy("node").agg(F.sum("x").alias("x")))
    weighted = [t.select("node", (F.col("x") * w).alias("x")) for t, w in zip(terms, weights)]
    out = weighted[0]
    for t in weighted[1:]:
        out = out.unionByName(t)
    return out.groupBy("node").agg(F.sum("x").alias("x"))
