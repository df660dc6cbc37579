"""Small helpers shared by the problem modules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function is made once a task (``make``), so models and tables load once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, n: int, key: str) -> list[Row]:
    """``n`` rows at most, those of least hash of ``key``; the same for the same rows.

    Hashes are cut at a share that leaves some four times ``n`` rows in all, so what tasks send doesn't grow with their number.
    """
    share = min(1.0, 4 * n / max(1, rows.count()))
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 40)))
    return hashed.where(F.col("_h") <= int(share * (1 << 40))).orderBy("_h", key).limit(n).drop("_h").collect()
