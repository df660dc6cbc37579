"""Lexical, vector and hybrid search as joins and ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.tables import share_package

#: Queries that tasks may hold, and vectors of a part where there are more.
BROADCAST_QUERIES, TILE_VECTORS = 20_000, 100_000
#: Words of two letters, digits or marks and more.
TERM = r"[\p{L}\p{N}\p{M}_]{2,}"
#: Scores computed at once.
SCORES = 4_000_000


def tfidf(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``term``, ``weight``): words of two letters and more, smooth idf, unit length."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    terms = texts.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy("k", "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = texts.select(key).distinct().agg(F.count("*").alias("n"))
    idf = frequency.crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def lexical_scores(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(``query``, ``key``, ``score``): cosine of query texts (query, text) with the rows of a tf-idf ``index``."""
    terms = queries.select("query", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    hits = index.join(terms, "term").groupBy("query", key).agg(F.sum(F.col("weight") * F.col("tf")).alias("score"))
    return hits


def top_k(scores: DataFrame, by: str, k: int, score: str, tie: str, ascending: bool = False) -> DataFrame:
    """The first ``k`` rows of each ``by``, with their ``rank``."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, tie))).where(F.col("rank") <= k)


class _Nearest:
    """Picks, batch by batch, the vectors that can be among the ``k`` best of each query; a task's bounds rise as it goes on."""

    def __init__(self, q: np.ndarray, k: int, measure: str):
        self.k, self.measure = k, measure
        self.q = q / np.linalg.norm(q, axis=1, keepdims=True) if measure == "cosine" else q
        self.square = (q * q).sum(1)
        self.best = np.full((len(q), k), -np.inf)

    def _scores(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if self.measure == "cosine":
                return self.q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            dots = self.q @ x.T
            if self.measure == "dot":
                return dots
            square = (x * x).sum(1)
            inner = (1 - self.square)[:, None] * (1 - square)[None, :]
            return np.where(inner > 0, (2 * dots - self.square[:, None] - square[None, :]) / inner, -np.inf)

    def pick(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, SCORES // max(1, len(self.q)))
        found = []
        for begin in range(0, len(x), step):
            scores = np.nan_to_num(self._scores(x[begin : begin + step]), nan=-np.inf)
            every = np.concatenate([self.best, scores], axis=1)
            self.best = np.partition(every, every.shape[1] - self.k, axis=1)[:, -self.k :]
            # rounding may put equals in another order, so what is as good but for that stays too
            i, j = np.nonzero(scores >= self.best.min(1)[:, None] - 1e-9)
            found.append((i, j + begin))
        i, j = zip(*found)
        return np.concatenate(i), np.concatenate(j)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


def _held_candidates(held: pa.Table, vectors: DataFrame, k: int, schema: str, measure: str) -> DataFrame:
    """Candidates of queries that every task holds; vectors are read once and not shuffled."""
    ids = held["query"].combine_chunks()
    q = _matrix(held["q"].combine_chunks(), len(ids))

    def run(batches):
        work = _Nearest(q, k, measure)
        for batch in batches:
            if batch.num_rows and len(ids):
                i, j = (pa.array(x, pa.int64()) for x in work.pick(_matrix(batch.column(1), batch.num_rows)))
                yield pa.RecordBatch.from_arrays([ids.take(i), batch.column(0).take(j), batch.column(1).take(j)], names=["query", "near", "v"])

    return vectors.mapInArrow(run, schema)


def _tiled_candidates(queries: DataFrame, vectors: DataFrame, k: int, schema: str, measure: str, asked: int) -> DataFrame:
    """Candidates of more queries: both sides are cut into parts, and a task compares one part of each."""
    down, across = -(-asked // BROADCAST_QUERIES), max(1, -(-vectors.count() // TILE_VECTORS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(part("query", down).alias("row"), each(across).alias("col"), F.col("query"), F.lit(None).cast(vectors.schema["near"].dataType).alias("near"), F.col("q").alias("v"))
    right = vectors.select(each(down).alias("row"), part("near", across).alias("col"), F.lit(None).cast(queries.schema["query"].dataType).alias("query"), "near", "v")
    placed = left.unionByName(right).select((F.col("row") * across + F.col("col")).alias("tile"), "query", "near", "v")

    def run(batches):
        tile, ids, rows, work = None, [], [], None
        for batch in batches:
            tiles = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]])) if len(tiles) else []
            for begin, end in zip(starts, [*starts[1:], len(tiles)]):
                piece = batch.slice(begin, end - begin)
                if tiles[begin] != tile:
                    tile, ids, rows, work = tiles[begin], [], [], None
                asks = piece.column(1).is_valid()
                own, other = piece.filter(asks), piece.filter(pc.invert(asks))
                if own.num_rows:  # queries come first
                    ids.append(own.column(1))
                    rows.append(_matrix(own.column(3), own.num_rows))
                if other.num_rows and ids:
                    if work is None:
                        ids, work = [pa.concat_arrays(ids)], _Nearest(np.concatenate(rows), k, measure)
                    i, j = (pa.array(x, pa.int64()) for x in work.pick(_matrix(other.column(3), other.num_rows)))
                    yield pa.RecordBatch.from_arrays([ids[0].take(i), other.column(2).take(j), other.column(3).take(j)], names=["query", "near", "v"])

    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(down * across, 20_000))
    return placed.repartition(tasks, "tile").sortWithinPartitions("tile", F.col("query").isNull()).mapInArrow(run, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str, vec: str, measure: str = "cosine", held: int | None = None) -> DataFrame:
    """(``query``, ``key``, ``score``, ``rank``): exact nearest vectors of a stated set of ``queries`` (query, q), themselves aside.

    Vectors of other lengths than the queries', and null ones, count for nothing.  Up to ``BROADCAST_QUERIES`` queries are held by
    the tasks; more are compared part by part.  Either way a task passes on what can be among the best only; those few are scored and ranked.
    """
    share_package(vectors.sparkSession)
    score = {"cosine": V.cosine, "dot": V.dot, "poincare": V.poincare_distance}[measure](F.col("q"), F.col("v"))
    asked = queries.select("query", V.as_double(F.col("q")).alias("q")).where("size(q) > 0")
    length = asked.agg(F.max(F.size("q"))).first()[0] or 0
    asked = asked.where(F.size("q") == length)
    rows = vectors.select(F.col(key).alias("near"), V.as_double(F.col(vec)).alias("v")).where(F.size("v") == length)
    schema = f"query {queries.schema['query'].dataType.simpleString()}, near {vectors.schema[key].dataType.simpleString()}, v array<double>"
    most = BROADCAST_QUERIES if held is None else held
    table = asked.limit(most + 1).toArrow()
    if table.num_rows <= most:
        found = _held_candidates(table, rows, k + 1, schema, measure).join(F.broadcast(asked), "query")
    else:
        found = _tiled_candidates(asked, rows, k + 1, schema, measure, asked.count()).join(asked, "query")
    met = found.where(F.col("near") != F.col("query")).select("query", F.col("near").alias(key), score.alias("score"))
    return top_k(met, "query", k, "score", key, ascending=measure == "poincare")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key once, its first row by ``order``; ties between equal orders are settled by all columns."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*key, "r.*")
