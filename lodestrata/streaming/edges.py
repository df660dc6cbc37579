"""Edge streams with bounded lateness: the batch form, and the same as a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "10 minutes"
#: Arrivals that are scanned together; the running maximum goes over such blocks first.
BLOCK = 50_000


def running_maximum(events: DataFrame, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """``events`` with ``seen``: the greatest ``value`` up to and with each row, in the whole order, without one global sort."""
    blocked = events.withColumn("_block", F.floor(F.col(order) / block))
    tops = blocked.groupBy("_block").agg(F.max(value).alias("_top"))
    # one row a block, so this one window is a block's share of the rows
    before = tops.withColumn("_before", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).select("_block", "_before")
    local = blocked.withColumn("_local", F.max(value).over(Window.partitionBy("_block").orderBy(order)))
    return local.join(before, "_block").withColumn("seen", F.greatest("_local", "_before")).drop("_block", "_local", "_before")


def late_events(events: DataFrame, lateness: str = LATENESS, order: str = "arrival", ts: str = "ts") -> DataFrame:
    """``events`` with ``late``: before the watermark, which is the greatest time seen so far less the lateness.  Events without a time are late."""
    seen = running_maximum(events, order, ts)
    return seen.withColumn("late", F.coalesce(F.col(ts) < F.col("seen") - F.expr(f"INTERVAL {lateness}"), F.lit(True))).drop("seen")


def hot_edges(events: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the events on time."""
    return late_events(events).where(~F.col("late") & F.col("dst").isNotNull()).select("src", "dst").distinct()


def windowed_edges(events: DataFrame, width: str = "30 seconds", ts: str = "ts") -> DataFrame:
    """Distinct edges of each window of the epoch; works on streams with a watermark too."""
    return events.groupBy(F.window(ts, width).alias("w"), "src").agg(F.approx_count_distinct("dst").alias("about"), F.count("*").alias("events"))


def route_stream(stream: DataFrame, hot: str, late: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Writes a stream (arrival, src, dst, ts) to ``hot`` and late events to ``late`` as parquet.

    The watermark advances by event within a batch, as in the batch form.  Across batches it goes on from the greatest time of
    earlier ones, which stands in one small file a batch under ``checkpoint``, so no batch reads what was written before.
    Batches are written under their id: a batch that is run again replaces itself, and looks at earlier ids only.
    """
    log = os.path.join(checkpoint, "greatest")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        written = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        before = spark.read.schema("ts timestamp, batch bigint").parquet(log).where(F.col("batch") < number).agg(F.max("ts")).first()[0] if written else None
        seen = running_maximum(batch, "arrival", "ts")
        top = F.greatest("seen", F.lit(before).cast("timestamp")) if before is not None else F.col("seen")
        marked = seen.withColumn("late", F.coalesce(F.col("ts") < top - F.expr(f"INTERVAL {lateness}"), F.lit(True))).drop("seen").persist()
        for root, rows in ((hot, marked.where(~F.col("late"))), (late, marked.where("late"))):
            rows.drop("late").write.mode("overwrite").parquet(os.path.join(root, f"batch={number}"))
        marked.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(os.path.join(log, f"batch={number}"))
        marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(checkpoint, "stream")).trigger(availableNow=True).start()


def deduplicated_stream(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each (src, dst, ts) of a stream once within the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["src", "dst", "ts"])
