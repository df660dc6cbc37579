"""Operators that depend on order: folds that accept or reject, greedy merges and deduplication.

A fold runs over each key's rows in order, in one task a key; a key's rows stream through it in Arrow batches sorted by
Spark, and only the state is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.components import connected_components
from lodestrata.session import cut
from lodestrata.tables import share_package

#: Words of 64 bits for the counts in a question and in an answer; rows on a side of a tile, and how many are compared at once.
CODE_LEVELS = (4, 8)
TILE, TILE_ROWS = 8_192, 64


def ordered_fold(rows: DataFrame, key: str, order: list[str], values: list[str], step: Callable, out: str, start: Callable[[], object]) -> DataFrame:
    """``rows`` with the columns of ``out``: ``step(state, *values)`` gives the new state and a tuple, in the order of each key."""
    share_package(rows.sparkSession)
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + out
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, object()
        for batch in batches:
            results = []
            data = batch.to_pydict()
            for k, *args in zip(data[key], *(data[v] for v in values)):
                if k != current:
                    state, current = start(), k
                state, result = step(state, *args)
                results.append(result)
            more = [pa.array([r[i] for r in results]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def ewma_drift(rows: DataFrame, key: str, order: list[str], value: str, decay: float = 0.2) -> DataFrame:
    """Adds ``mu``, ``sigma`` and ``alert`` (the value beyond mu + 3 sigma, both updated); the first row of a key never alerts."""

    def step(state, x):
        if state is None:
            return (x, 0.0), (float(x), 0.0, False)
        mu = decay * x + (1 - decay) * state[0]
        sigma = (decay * (x - mu) ** 2 + (1 - decay) * state[1] ** 2) ** 0.5
        return (mu, sigma), (mu, sigma, x > mu + 3 * sigma)

    return ordered_fold(rows.where(F.col(value).isNotNull()), key, order, [value], step, "mu double, sigma double, alert boolean", lambda: None)


def sliding_budget(rows: DataFrame, key: str, order: list[str], at: str, amount: str, budget: float, window: float = 86_400.0) -> DataFrame:
    """Adds ``accepted`` and ``remaining``: what is asked fits the budget of the last ``window`` seconds; only what was accepted counts, and what is exactly a window old no longer does."""
    from collections import deque

    def step(state, now, asked):
        events, spent = state
        while events and events[0][0] <= now - window:
            spent -= events.popleft()[1]
        if not events:
            spent = 0.0
        ok = spent + asked <= budget
        if ok:
            events.append((now, asked))
            spent += asked
        return (events, spent), (ok, budget - spent)

    return ordered_fold(rows, key, order, [at, amount], step, "accepted boolean, remaining double", lambda: (deque(), 0.0))


def token_bucket(rows: DataFrame, key: str, order: list[str], now: str, rate: float, burst: float) -> DataFrame:
    """Adds ``admitted``: a full bucket at first, refilled by time (never by steps back), one token an admission."""

    def step(state, t):
        tokens, before = state if state else (burst, t)
        tokens = min(burst, tokens + max(0.0, t - before) * rate)
        ok = tokens >= 1
        return (tokens - ok, t), (ok,)

    return ordered_fold(rows, key, order, [now], step, "admitted boolean", lambda: None)


def anchored_windows(rows: DataFrame, key: str, order: list[str], seconds: str, width: float) -> DataFrame:
    """Adds ``window_start`` and ``window``: tumbling windows anchored at the first event of each, not at the epoch."""

    def step(state, t):
        start, n = state if state else (t, 0)
        if t - start >= width:
            start, n = t, n + 1
        return (start, n), (float(start), n)

    return ordered_fold(rows, key, order, [seconds], step, "window_start double, window bigint", lambda: None)


def merged_points(vectors: DataFrame, key: str, order: str, vec: str, tolerance: float) -> DataFrame:
    """Adds ``cluster``: a vector joins the first centre within ``tolerance``, which moves half way to it; else it is a centre of its own."""

    def step(state, v):
        x = np.asarray(v, dtype=float)
        if state:
            d = np.linalg.norm(np.stack(state) - x, axis=1)
            near = np.flatnonzero(d <= tolerance)
            if len(near):
                i = int(near[0])
                state[i] = (state[i] + x) / 2
                return state, (i,)
        state.append(x)
        return state, (len(state) - 1,)

    return ordered_fold(vectors, key, [order], [vec], step, "cluster bigint", list)


def _unary(values: np.ndarray, buckets: int, levels: int) -> np.ndarray:
    """Counts of hashed ``values``, each cut at ``levels`` and written in ones: codes differ in no more bits than the counts differ."""
    hashed = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    counts = np.bincount((hashed % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return np.packbits(counts[:, None] > np.arange(levels)).view(np.uint64)


def _text_code(text: str, levels: int) -> np.ndarray:
    """A code of the text's characters (``levels`` words), then one of its neighbouring characters (``levels`` words)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.concatenate([_unary(points, 64, levels), _unary(points[:-1] * np.uint64(1 << 21) + points[1:], 64 * levels, 1)])


def _alike_codes(one: np.ndarray, other: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may reach the ratio; a row is two lengths, then both codes.

    A ratio of t leaves at most (1 - t) * (sum of lengths) characters unmatched; each changes the counts of characters
    by one and those of neighbours by three at most.
    """
    q, a = 2 * CODE_LEVELS[0], 2 * CODE_LEVELS[1]
    parts = [(0, 2, 2 + q // 2, 1), (0, 2 + q // 2, 2 + q, 3), (1, 2 + q, 2 + q + a // 2, 1), (1, 2 + q + a // 2, 2 + q + a, 3)]
    most = (2 - threshold) / threshold
    mine, theirs = one[:, :2].astype(np.float32), other[:, :2].astype(np.float32)
    low, high = mine / most - 1e-3, mine * most + 1e-3
    # rows come in the order of the answers' lengths, so those in reach lie together
    begin = int(np.searchsorted(theirs[:, 1], low[:, 1].min()))
    theirs = theirs[begin : int(np.searchsorted(theirs[:, 1], high[:, 1].max(), side="right"))]
    within = np.ones((len(one), len(theirs)), dtype=bool)
    for side in (0, 1):
        within &= theirs[None, :, side] >= low[:, None, side]
        within &= theirs[None, :, side] <= high[:, None, side]
    i, j = np.nonzero(within)
    j += begin
    for side, first, end, share in parts:
        room = share * (1 - threshold) * (one[i, side] + other[j, side]).astype(np.float32) + 1e-3
        differ = np.zeros(len(i), dtype=np.int16)
        for w in range(first, end):
            differ += np.bitwise_count(one[i, w] ^ other[j, w])
            # half a code settles most pairs
            if w % 2:
                keep = differ <= room
                i, j, differ, room = i[keep], j[keep], differ[keep], room[keep]
    return i, j


def _candidates(heads: DataFrame, threshold: float) -> DataFrame:
    """(``pos``, ``pos2``): all pairs that may reach the ratio in both texts, by comparing the codes of all pairs, tile by tile."""
    words = 2 + 2 * sum(CODE_LEVELS)

    def encode(batches):
        for batch in batches:
            rows = batch.to_pydict()
            codes = [np.concatenate([np.array([len(q), len(a)], np.uint64), _text_code(q, CODE_LEVELS[0]), _text_code(a, CODE_LEVELS[1])]).tobytes() for q, a in zip(rows["q"], rows["a"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["pos", "code"])

    def compare(batches):
        current, held = None, []

        def finish():
            left, pos, code = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(code[:, 1], kind="stable")
            left, pos, code = left[order], pos[order], code[order]
            # a tile on the diagonal has each row once, on the left
            one, pos1 = np.asfortranarray(code[left]), pos[left]
            other, pos2 = (np.asfortranarray(code[~left]), pos[~left]) if not left.all() else (one, pos1)
            for begin in range(0, len(one), TILE_ROWS):
                i, j = _alike_codes(one[begin : begin + TILE_ROWS], other, threshold)
                x, y = pos1[begin + i], pos2[j]
                once = (x != y) if other is not one else (x < y)
                x, y = x[once], y[once]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["pos", "pos2"])

        for batch in batches:
            tile = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else []
            for begin, end in zip(starts, [*starts[1:], len(tile)]):
                if held and tile[begin] != current:
                    yield from finish()
                    held = []
                current = tile[begin]
                piece = batch.slice(begin, end - begin)
                code = np.frombuffer(b"".join(piece.column(3).to_pylist()), dtype=np.uint64).reshape(piece.num_rows, words)
                held.append((piece.column(1).to_numpy(zero_copy_only=False), piece.column(2).to_numpy(), code))
        if held:
            yield from finish()

    codes = cut(heads.select("pos", "q", "a").mapInArrow(encode, "pos bigint, code binary"))
    parts = max(1, -(-codes.count() // TILE))
    # a row meets the parts after its own from the left, those before it from the right
    own = codes.withColumn("own", F.pmod(F.xxhash64("pos"), F.lit(parts))).withColumn("each", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = own.select((F.least("own", "each") * parts + F.greatest("own", "each")).alias("tile"), (F.col("own") <= F.col("each")).alias("left"), "pos", "code")
    tasks = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts * (parts + 1) // 2, 20_000))
    return placed.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(compare, "pos bigint, pos2 bigint")


def similar_pairs_dropped(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``pairs`` (pos, question, answer) without those whose question and answer are both alike to a kept earlier pair.

    Every pair of rows is compared by bounds of the matcher's ratio that lose none (lengths, counts of characters and of neighbours),
    links are by the ratio itself, and each group of linked pairs is walked in order of ``pos``; a pair is only compared with kept ones.
    """
    share_package(pairs.sparkSession)
    rows = pairs.select("pos", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    # equal pairs first: the earliest stands for all
    heads = rows.groupBy("q", "a").agg(F.min("pos").alias("pos"))
    other = heads.select(F.col("pos").alias("pos2"), F.col("q").alias("q2"), F.col("a").alias("a2"))
    met = _candidates(heads, threshold).join(heads, "pos").join(other, "pos2").select("pos", "pos2", "q", "q2", "a", "a2")

    def alike(x, y):
        if x == y:
            return True
        matcher = SequenceMatcher(None, x, y)  # its upper bounds are far cheaper than the ratio
        return matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold

    def ratios(batches):
        for batch in batches:
            d = batch.to_pydict()
            keep = [alike(q2, q) and alike(a2, a) for q, q2, a, a2 in zip(d["q"], d["q2"], d["a"], d["a2"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["pos", "pos2"]).filter(pa.array(keep, pa.bool_()))

    links = cut(met.mapInArrow(ratios, "pos bigint, pos2 bigint"))
    groups = connected_components(links, "pos", "pos2")
    arcs = links.join(groups.select(F.col("node").alias("pos2"), "component"), "pos2")
    earlier = arcs.groupBy("component", "pos2").agg(F.collect_list("pos").alias("before"))
    listed = groups.select(F.col("node").alias("pos2"), "component").join(earlier, ["component", "pos2"], "left")

    def step(kept, pos, before):
        drop = any(b in kept for b in before or ())
        if not drop:
            kept.add(pos)
        return kept, (drop,)

    folded = ordered_fold(listed, "component", ["pos2"], ["pos2", "before"], step, "dropped boolean", set)
    gone = folded.where("dropped").select(F.col("pos2").alias("pos"))
    return pairs.join(heads.select("pos").join(gone, "pos", "left_anti"), "pos", "left_semi")
