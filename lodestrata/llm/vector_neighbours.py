"""Problem 2: for every vector the most similar ones of its space.

Cells of random directions on unit vectors.  A table has two sets of signed axes of random rotations.  A vector is sent under
the ``SENT`` axes of the first set that lie nearest to it, as a code of four bits a number; where it arrives it is entered under the
``ENTERED`` nearest axes of the second set, at no further cost of shuffling.  So each table has it in ``SENT * ENTERED`` cells, and all vectors of a cell
are compared by their codes, in one product of matrices.  Pairs whose codes come within ``MARGIN`` of the limit are verified by their exact cosine;
only vectors that occur in such a pair (a bitmap of fixed size tells most others) are shuffled whole.

The number of axes follows from the number of vectors in a space, so that a cell of evenly spread vectors keeps some ``CELL`` of them; a small space is one cell,
which compares all of it.  Whether two vectors meet depends on their angle and the number of axes only, as rotations are random.

``p2_neighbours`` has no limit: vectors with fewer than ``k`` verified neighbours are compared with every vector of their space, tile by tile (quadratic in them).

Vectors that are null, empty, of another length than their space, not finite or all zero are left out;
a node counts once for each space (of different vectors, the least in order counts); equal vectors share one representative.
"""

from __future__ import annotations

import gc
import time
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.llm.eval_leaks import BITMAP_BITS, _bitmap
from lodestrata.session import cut
from lodestrata.tables import table

COSINE = 0.9
NEIGHBOURS = 5
#: Tables, axes of the first set that a vector is sent under in each, and axes of the second that it is entered under.
TABLES, SENT, ENTERED = 7, 2, 3
#: Vectors in a cell, and fewest axes of a set; a space with fewer is one cell.
CELL, LEAST_AXES = 1_250, 4
#: What codes may take off a cosine: more than four times the standard error of four bits in 33 dimensions.  Shorter vectors have eight bits.
MARGIN, EIGHT_BITS = 0.09, 32
#: Rows that are placed at once, rows of a cell compared at once, and pairs held at once.
PLACED, CELL_ROWS, HELD_PAIRS = 32_768, 512, 1_000_000
#: Nodes with several vectors that tasks may hold; more are joined.
HELD_NODES = 200_000
#: Seconds after which the JVM has heard of what Python let go.
RELEASE_S = 2
_SEED = 77_003
#: Vectors on a side of a tile, rows of a tile compared at once, and how many more than k single precision may put in another order.
TILE, TILE_ROWS, SPARE = 16_384, 512, 4


def _units(rows: DataFrame, given: bool = False) -> DataFrame:
    """(``space``, ``node``, ``vec``, ``many``, ``rep``): unit vectors of ``rows`` that are finite and not all zero, and with ``given`` the vectors as they were."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            vecs = batch.column(2)
            sizes = vecs.value_lengths().to_numpy()
            which, units = [], []
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                x = vecs.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), n).astype(np.float64)
                most = np.abs(x).max(axis=1)
                sound = np.isfinite(most) & (most > 0)
                own, x = own[sound], x[sound] / most[sound, None]
                which.append(own)
                # no negative zeros: equal vectors have equal hashes
                units.append((x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32) + np.float32(0))
            if not which:
                return None
            taken = pa.array(np.concatenate(which))
            lengths = np.concatenate([np.full(len(u), u.shape[1]) for u in units])
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            unit = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([u.ravel() for u in units])))
            columns = [batch.column(0).take(taken), batch.column(1).take(taken), unit, batch.column(3).take(taken)]
            return pa.RecordBatch.from_arrays([*columns, vecs.take(taken)] if given else columns, names=["space", "node", "vec", "many", *["given"] * given])

        return run

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("space", "node", "vec")}
    schema = f"space {kinds['space']}, node {kinds['node']}, vec array<float>, many bigint" + f", given {kinds['vec']}" * given
    return map_batches(rows.select("space", "node", "vec", "many"), make, schema).withColumn("rep", F.xxhash64("space", "vec"))


def usable_vectors(vectors: DataFrame, space: str = "space", node: str = "node_id", vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Rows (``space``, ``node``, ``vec``, ``many``, ``rep``) of unit vectors, in which a node and vector may be repeated, and (``space``, ``node``, ``rep``), each node once a space.

    ``rep`` is shared by equal vectors; ``many`` is about how many vectors the space has.
    """
    rows = vectors.select(F.col(space).alias("space"), F.col(node).alias("node"), F.col(vec).alias("vec")).where("space IS NOT NULL AND node IS NOT NULL AND size(vec) > 0")
    # a space's length is that of most of its vectors; one small row a space and length
    lengths = rows.groupBy("space", F.size("vec").alias("n")).agg(F.count("*").alias("rows"))
    full = lengths.groupBy("space").agg(F.max_by(F.struct("n", F.col("rows").alias("many")), F.struct("rows", "n")).alias("most")).select("space", "most.*")
    full = rows.join(F.broadcast(full), "space").where(F.size("vec") == F.col("n"))
    rows = _units(full)
    nodes = rows.groupBy("space", "node").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).persist(StorageLevel.DISK_ONLY)
    mixed = nodes.where("rep <> last").select("space", "node")
    if count := mixed.count():
        held = F.broadcast if count <= HELD_NODES else lambda df: df
        given = _units(full.join(held(mixed), ["space", "node"]), given=True)
        least = cut(given.groupBy("space", "node").agg(F.min_by("rep", "given").alias("least")))
        rows = rows.join(held(least), ["space", "node"], "left").where("least IS NULL OR rep = least").drop("least")
        if count > HELD_NODES:
            rows = rows.persist(StorageLevel.DISK_ONLY)
        nodes = nodes.join(held(least), ["space", "node"], "left").withColumn("rep", F.coalesce("least", "rep"))
    return rows, nodes.select("space", "node", "rep")


def axes_for(rows: int) -> int:
    """Axes of each of the two sets of a table for so many vectors in a space: 1 where all are compared."""
    axes = round((rows * SENT * ENTERED / CELL) ** 0.5)
    return axes if axes >= LEAST_AXES else 1


@lru_cache(maxsize=64)
def _axes(dimensions: int, count: int, number: int) -> np.ndarray:
    """``count`` signed axes of as many random rotations as that takes."""
    rng = np.random.default_rng((_SEED, dimensions, number))
    turns = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0].T for _ in range(-(-count // (2 * dimensions)))]
    both = np.concatenate([part for turn in turns for part in (turn, -turn)]).astype(np.float32)
    return np.ascontiguousarray(both[rng.permutation(len(both))[:count]])


@lru_cache(maxsize=8)
def _turn(dimensions: int) -> np.ndarray:
    """A random rotation, so that numbers are of a size whatever the vectors."""
    return np.linalg.qr(np.random.default_rng((_SEED, dimensions)).standard_normal((dimensions, dimensions)))[0].astype(np.float32)


def _nearest_axes(x: np.ndarray, axes: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` of ``axes`` nearest to each vector, nearest first."""
    seen = x @ axes.T
    out = np.empty((len(x), min(count, len(axes))), dtype=np.int64)
    for i in range(out.shape[1]):
        out[:, i] = seen.argmax(axis=1)
        seen[np.arange(len(x)), out[:, i]] = -np.inf
    return out


#: The two numbers of a byte.
_FOUR_BITS = np.stack([np.arange(256) >> 4, np.arange(256) & 15], axis=1).astype(np.float32) - 8


def _coded(x: np.ndarray) -> np.ndarray:
    """Codes of turned vectors, in parts of their greatest number: fifteen values of four bits, or of eight where there are few dimensions."""
    most = np.abs(x).max(axis=1, keepdims=True)
    if x.shape[1] <= EIGHT_BITS:
        return (np.rint(x / most * 127) + 128).astype(np.uint8)
    codes = (np.rint(x / most * 7) + 8).astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.full((len(codes), 1), 8, dtype=np.uint8)], axis=1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def _decoded(codes: np.ndarray, dimensions: int) -> np.ndarray:
    if dimensions <= EIGHT_BITS:
        x = codes.astype(np.float32) - 128
    else:
        x = _FOUR_BITS[codes].reshape(len(codes), -1)[:, :dimensions]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sent(rows: DataFrame) -> DataFrame:
    """(``place``, ``number``, ``wide``, ``axes``, ``reps``, ``codes``): the codes of vectors for each axis that they are sent under, packed."""

    def place(salt: np.ndarray, number: np.ndarray, axis: np.ndarray) -> np.ndarray:
        out = salt.astype(np.int64).view(np.uint64)
        for part in (number, axis):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return out.view(np.int64)

    def packed(parts: list[pa.RecordBatch]):
        part = pa.Table.from_batches(parts).combine_chunks()
        salts, reps, vecs, many = (part.column(i).chunk(0) for i in range(4))
        salts, reps, many, sizes = salts.to_numpy(), reps.to_numpy(), many.to_numpy(), vecs.value_lengths().to_numpy()
        for salt in np.unique(salts):
            own = np.flatnonzero(salts == salt)
            # copies are sent once
            own = own[np.unique(reps[own], return_index=True)[1]]
            wide, axes = int(sizes[own[0]]), axes_for(int(many[own[0]]))
            x = vecs.take(pa.array(own)).flatten().to_numpy().reshape(len(own), wide) @ _turn(wide)
            codes, own_reps = _coded(x), reps[own]
            for number in range(TABLES if axes > 1 else 1):
                near = _nearest_axes(x, _axes(wide, axes, 2 * number + 1), SENT)
                order = np.argsort(near.ravel(), kind="stable")
                axis, which = near.ravel()[order], order // near.shape[1]
                starts = np.flatnonzero(np.concatenate([[True], axis[1:] != axis[:-1]]))
                ends = np.concatenate([starts, [len(axis)]]).astype(np.int64)
                binary = lambda data, size: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends * size), pa.py_buffer(np.ascontiguousarray(data))])  # noqa: B023, E731
                same = lambda value: pa.array(np.full(len(starts), value, dtype=np.int32))  # noqa: B023, E731
                places = place(np.full(len(starts), salt), np.full(len(starts), number), axis[starts])
                columns = [pa.array(places), same(number), same(wide), same(axes), binary(own_reps[which], 8).cast(pa.binary()), binary(codes[which], codes.shape[1]).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "number", "wide", "axes", "reps", "codes"])

    def run(batches):
        parts = []
        for batch in batches:
            for begin in range(0, batch.num_rows, PLACED):
                parts.append(batch.slice(begin, PLACED))
                if sum(p.num_rows for p in parts) >= PLACED:
                    yield from packed(parts)
                    parts = []
        if parts:
            yield from packed(parts)

    rows = rows.select(F.xxhash64("space").alias("salt"), "rep", "vec", "many")
    return rows.mapInArrow(run, "place bigint, number int, wide int, axes int, reps binary, codes binary")


def _close(sent: DataFrame, cosine: float) -> DataFrame:
    """(``a``, ``b``) that are in a cell together and whose codes come within ``MARGIN`` of ``cosine``; a pair for each place that has it."""
    limit = cosine - MARGIN

    def cells(x: np.ndarray, number: int, axes: int):
        """Pairs of rows of each cell."""
        if axes == 1:
            yield from within(x, np.arange(len(x)))
            return
        near = np.concatenate([_nearest_axes(x[begin : begin + PLACED], _axes(x.shape[1], axes, 2 * number + 2), ENTERED) for begin in range(0, len(x), PLACED)])
        order = np.argsort(near.ravel(), kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(near.ravel(), minlength=axes))])
        for begin, end in zip(ends[:-1], ends[1:]):
            which = order[begin:end] // near.shape[1]
            yield from within(x[which], which)

    def within(x: np.ndarray, which: np.ndarray):
        for begin in range(0, len(x) - 1, CELL_ROWS):
            part = x[begin : begin + CELL_ROWS]
            c = part @ x[begin:].T
            np.fill_diagonal(c, -2)
            some = np.flatnonzero(c.max(axis=1) >= limit)
            if len(some):
                i, j = np.nonzero(c[some] >= limit)
                # each pair once
                after = j > some[i]
                yield which[begin + some[i[after]]], which[begin + j[after]]

    def compared(number: int, wide: int, axes: int, reps: list[bytes], codes: list[bytes]):
        reps, first = np.unique(np.frombuffer(b"".join(reps), dtype=np.int64), return_index=True)
        if len(reps) < 2:
            return
        x = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, wide if wide <= EIGHT_BITS else (wide + 1) // 2)
        x = _decoded(x[first], wide)
        held, count = [], 0

        def pairs():
            # rows are in the order of their representatives
            i, j = (np.concatenate(side) for side in zip(*held))
            both = np.unique(np.minimum(i, j) * len(reps) + np.maximum(i, j))
            return pa.RecordBatch.from_arrays([pa.array(reps[both // len(reps)]), pa.array(reps[both % len(reps)])], names=["a", "b"])

        for pair in cells(x, number, axes):
            held.append(pair)
            count += len(pair[0])
            if count >= HELD_PAIRS:
                yield pairs()
                held, count = [], 0
        if held:
            yield pairs()

    def run(batches):
        current, kind, reps, codes = None, None, [], []
        for batch in batches:
            for at, number, wide, axes, own, code in zip(*(column.to_pylist() for column in batch.columns)):
                if at != current:
                    if reps:
                        yield from compared(*kind, reps, codes)
                    current, kind, reps, codes = at, (number, wide, axes), [], []
                reps.append(own)
                codes.append(code)
        if reps:
            yield from compared(*kind, reps, codes)

    partitions = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(partitions, "place").sortWithinPartitions("place").mapInArrow(run, "a bigint, b bigint")


def _cosines(pairs: DataFrame, points: DataFrame, least: float) -> DataFrame:
    vectors = points.select("rep", "space", "vec")
    both = pairs.join(vectors.select(F.col("rep").alias("a"), "space", F.col("vec").alias("x")), "a").join(vectors.select(F.col("rep").alias("b"), F.col("vec").alias("y")), "b")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return both.select("space", "a", "b", dot.alias("cosine")).where(F.col("cosine") >= least)


def _occurring(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(``rep``, ``space``, ``vec``) of ``rows`` that may occur in ``pairs``: all that do, and few others."""
    ids = pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash")))
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def make():
        bits = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            return batch.filter(pa.array((bits[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)))

        return run

    return map_batches(rows.select("rep", "space", "vec"), make, f"rep bigint, space {rows.schema['space'].dataType.simpleString()}, vec array<float>")


def similar_pairs(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(``space``, ``a``, ``b``, ``cosine``): the pairs of different representatives of at least ``cosine``, with the recall of the cells."""
    pairs = cut(_close(_sent(rows), cosine).distinct())
    # nothing refers to the shuffled codes any more; their files would stay until the driver happens to collect its garbage
    for _ in range(2):
        gc.collect()
        time.sleep(RELEASE_S)
        rows.sparkSession.sparkContext._jvm.System.gc()
    points = _occurring(rows, pairs).groupBy("rep").agg(F.first("space").alias("space"), F.first("vec").alias("vec")).persist(StorageLevel.DISK_ONLY)
    return cut(_cosines(pairs, points, cosine))


def neighbour_pairs(vectors: DataFrame, k: int = NEIGHBOURS, cosine: float = COSINE) -> DataFrame:
    """(``space``, ``id_a``, ``id_b``): pairs of nodes of at least ``cosine`` of which one is among the ``k`` most similar of the other."""
    rows, nodes = usable_vectors(vectors)
    pairs = similar_pairs(rows, cosine)
    both = pairs.select("space", F.col("a").alias("rep"), F.col("b").alias("other"), "cosine").unionByName(pairs.select("space", F.col("b").alias("rep"), F.col("a").alias("other"), "cosine"))
    # most similar first; copies of a vector (cosine 1) come before all, ties share a rank, so no tied node is lost
    copies = nodes.groupBy("rep").agg(F.count("*").alias("copies"))
    own = copies.where("copies > 1").select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"), (F.col("copies") - 1).alias("weight"))
    other = both.join(copies.withColumnRenamed("rep", "other"), "other").select("rep", "other", "cosine", F.col("copies").alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("rep").orderBy(F.desc("cosine")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("weight").over(Window.partitionBy("rep", "cosine"))
    near = own.unionByName(other).withColumn("before", before).where(F.col("before") < k).select("rep", "other")
    a = nodes.select("space", "rep", F.col("node").alias("x"))
    b = nodes.select(F.col("rep").alias("other"), F.col("node").alias("y"))
    rows = near.join(a, "rep").join(b, "other").where("x <> y")
    return rows.select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(table(spark, sf_dir, "embedding"))


def _tile_neighbours(asks: np.ndarray, ask_reps: np.ndarray, points: np.ndarray, reps: np.ndarray, k: int):
    """Batches of (``rep``, ``near``, ``cosine``): the ``k`` of ``points`` most similar to each of ``asks``, and a few more."""
    keep = min(k + 1 + SPARE, len(points))
    for begin in range(0, len(asks), TILE_ROWS):
        part = asks[begin : begin + TILE_ROWS]
        c = part @ points.T
        # what the first points leave is a lower bound for the place asked for
        some = c[:, : max(keep, len(points) // 8)]
        least = np.partition(some, some.shape[1] - keep, axis=1)[:, some.shape[1] - keep]
        i, j = np.nonzero(c >= least[:, None])
        order = np.lexsort((-c[i, j], i))
        i, j = i[order], j[order]
        starts = np.searchsorted(i, np.arange(len(part)))
        first = np.arange(len(i)) - starts[i] < keep
        i, j = i[first], j[first]
        other = ask_reps[begin + i] != reps[j]
        i, j = i[other], j[other]
        cosine = np.einsum("ij,ij->i", part[i].astype(np.float64), points[j].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(ask_reps[begin + i]), pa.array(reps[j]), pa.array(cosine)], names=["rep", "near", "cosine"])


def exact_neighbours(points: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(``rep``, ``near``, ``cosine``): the ``k`` most similar ``points`` (space, rep, vec) of each of ``asking``, and some more, by comparing all."""
    sides = points.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
    # one small row a space
    sizes = sides.groupBy("space").agg(parts(F.count_if("asks")).alias("down"), parts(F.count_if(~F.col("asks"))).alias("across"))
    tiles = sizes.agg(F.sum(F.col("down") * F.col("across"))).first()[0] or 1
    own = F.pmod("rep", F.when(F.col("asks"), F.col("down")).otherwise(F.col("across")))
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("across")).otherwise(F.col("down")) - 1))
    placed = sides.join(F.broadcast(sizes), "space").select("space", "asks", "rep", "vec", own.cast("int").alias("own"), every.alias("each"))
    row, column = (F.when(F.col("asks"), x).otherwise(y) for x, y in ((F.col("own"), F.col("each")), (F.col("each"), F.col("own"))))
    placed = placed.select(F.xxhash64("space", row, column).alias("tile"), "asks", "rep", "vec")

    def run(batches):
        current, held = None, []

        def finish():
            asks = np.concatenate([h[0] for h in held])
            reps = np.concatenate([h[1] for h in held])
            vecs = np.concatenate([h[2] for h in held])
            if asks.any() and not asks.all():
                yield from _tile_neighbours(vecs[asks], reps[asks], vecs[~asks], reps[~asks], k)

        for batch in batches:
            tile = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else []
            for begin, end in zip(starts, [*starts[1:], len(tile)]):
                if held and tile[begin] != current:
                    yield from finish()
                    held = []
                current = tile[begin]
                piece = batch.slice(begin, end - begin)
                vecs = piece.column(3).flatten().to_numpy().reshape(piece.num_rows, -1)
                held.append((piece.column(1).to_numpy(zero_copy_only=False), piece.column(2).to_numpy(), vecs))
        if held:
            yield from finish()

    partitions = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(tiles), 20_000))
    return placed.repartition(partitions, "tile").sortWithinPartitions("tile").mapInArrow(run, "rep bigint, near bigint, cosine double")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(``space``, ``id``, ``other``, ``cosine``, ``rank``): the ``k`` most similar vectors of each representative, copies aside, however far."""
    rows, nodes = usable_vectors(vectors)
    pairs = similar_pairs(rows)
    points = rows.groupBy("rep").agg(F.first("space").alias("space"), F.first("vec").alias("vec")).select("space", "rep", "vec").persist(StorageLevel.DISK_ONLY)
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("near"), "cosine").unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("near"), "cosine"))
    both = both.groupBy("rep", "near").agg(F.max("cosine").alias("cosine"))
    done = both.groupBy("rep").count().where(F.col("count") >= k)
    rest = exact_neighbours(points, points.join(done, "rep", "left_anti"), k)
    every = both.unionByName(rest).groupBy("rep", "near").agg(F.max("cosine").alias("cosine"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "near"))).where(F.col("rank") <= k)
    names = nodes.groupBy("rep").agg(F.first("space").alias("space"), F.min("node").alias("name"))
    own = names.select("rep", "space", F.col("name").alias("id"))
    return ranked.join(own, "rep").join(names.select(F.col("rep").alias("near"), F.col("name").alias("other")), "near").select("space", "id", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``NEIGHBOURS`` most similar vectors of every representative; fewer only where the space holds no more."""
    return nearest(table(spark, sf_dir, "embedding"))


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}

ORACLES = {
    "p2_found": r"""
WITH v AS (SELECT space, node_id, min(vec::DOUBLE[]) AS v FROM embedding WHERE len(vec) > 0 GROUP BY 1, 2, len(vec)),
f AS (SELECT space, arg_max(n, c) AS n FROM (SELECT space, len(vec) AS n, count(*) AS c FROM embedding WHERE len(vec) > 0 GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT v.space, node_id, v FROM v JOIN f ON f.space = v.space AND len(v) = n WHERE len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.space, a.node_id AS q, b.node_id AS o, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.space = b.space AND a.node_id <> b.node_id),
r AS (SELECT space, q, o, c, rank() OVER (PARTITION BY space, q ORDER BY c DESC) AS r FROM c)
SELECT DISTINCT space, least(q, o) AS id_a, greatest(q, o) AS id_b FROM r WHERE r <= 5 AND c >= 0.9""",
}
