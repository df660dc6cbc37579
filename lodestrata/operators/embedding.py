"""Embeddings and clusters: walks, Word2Vec, k-means, projections and contrastive losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators.graph import undirected
from lodestrata.session import cut
from lodestrata.tables import share_package

MOST_ANCHORS = 20_000


def random_walks(edges: DataFrame, length: int, walks: int, seed: int = 0) -> DataFrame:
    """(``walk``, ``path``): from every node ``walks`` paths of ``length`` nodes; each step is drawn by a hash, so walks repeat exactly.

    A step joins with the node's neighbours numbered in order, so a step touches one neighbour a walk and not all of them.
    """
    pairs = undirected(edges)
    both = pairs.select(F.col("u").alias("at"), F.col("v").alias("to")).unionByName(pairs.select(F.col("v").alias("at"), F.col("u").alias("to")))
    numbered = cut(both.withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy("to")) - 1))
    degree = numbered.groupBy("at").agg(F.count("*").alias("d"))
    current = degree.select("at", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w")).select(F.concat_ws("#", "at", "w").alias("walk"), "at", F.array("at").alias("path"))
    for step in range(length - 1):
        drawn = current.join(degree, "at").withColumn("n", F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "walk"), F.col("d")).cast("int"))
        current = drawn.join(numbered, ["at", "n"]).select("walk", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    return current.select("walk", "path")


def node2vec(edges: DataFrame, dimensions: int = 16, length: int = 8, walks: int = 4, seed: int = 0, part: int = 1_000_000) -> DataFrame:
    """(``node``, ``vec``) of Word2Vec over random walks, trained on a partition for each ``part`` walks."""
    paths = cut(random_walks(edges, length, walks, seed))
    partitions = max(1, -(-paths.count() // part))
    model = Word2Vec(vectorSize=dimensions, minCount=1, seed=seed, inputCol="path", windowSize=4, maxIter=1, numPartitions=partitions).fit(paths)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vec"))


def clusters(vectors: DataFrame, vec: str, k: int, seed: int = 1) -> DataFrame:
    """``vectors`` with ``cluster``; rows without a vector are left out before clustering."""
    rows = vectors.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(V.as_double(F.col(vec))))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def principal(vectors: DataFrame, vec: str, k: int) -> DataFrame:
    rows = vectors.withColumn("_v", array_to_vector(V.as_double(F.col(vec))))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")


def contrastive_loss(one: DataFrame, other: DataFrame, key: str, vec: str, tau: float = 0.1) -> DataFrame:
    """(``loss``): InfoNCE of the anchors in ``one`` (key, vec) against all of the ``other`` view, over the anchors that it has.

    Anchors are a stated set of ``MOST_ANCHORS`` rows at most (more is an error), which tasks hold; each task passes on one sum an anchor.
    """
    share_package(other.sparkSession)
    held = one.select(F.col(key).alias("k"), V.as_double(F.col(vec)).alias("x")).limit(MOST_ANCHORS + 1).toArrow()
    if held.num_rows > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    ids = held["k"].combine_chunks()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    anchors = unit(np.array(held["x"].to_pylist(), dtype=float)) if len(ids) else np.zeros((0, 1))
    place = {k: i for i, k in enumerate(ids.to_pylist())}
    step = max(1, 4_000_000 // max(1, len(ids)))

    def run(batches):
        total, own = np.zeros(len(place)), np.full(len(place), np.nan)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for begin in range(0, len(keys), step):
                part = unit(np.array(batch.column(1)[begin : begin + step].to_pylist(), dtype=float))
                score = anchors @ part.T / tau
                total += np.exp(score).sum(1)
                for j, k in enumerate(keys[begin : begin + step]):
                    if k in place:
                        own[place[k]] = score[place[k], j]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(place)), pa.int64()), pa.array(total), pa.array(own, from_pandas=True)], names=["k", "total", "own"])

    rows = other.select(F.col(key).alias("k"), V.as_double(F.col(vec)).alias("y")).mapInArrow(run, "k bigint, total double, own double")
    summed = rows.groupBy("k").agg(F.log(F.sum("total")).alias("z"), F.max("own").alias("own"))
    return summed.where("own IS NOT NULL").agg(F.avg(F.col("z") - F.col("own")).alias("loss"))


def neighbour_means(edges: DataFrame, features: DataFrame, layers: int = 2) -> DataFrame:
    """(``node``, ``d``, ``x``): features averaged with those of the neighbours, layer by layer."""
    pairs = undirected(edges)
    both = pairs.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("near")))
    current = features
    for _ in range(layers):
        near = both.join(current.withColumnRenamed("node", "near"), "near").groupBy("node", "d").agg(F.avg("x").alias("m"))
        current = current.join(near, ["node", "d"], "left").select("node", "d", ((F.col("x") + F.coalesce("m", "x")) / 2).alias("x"))
    return current
