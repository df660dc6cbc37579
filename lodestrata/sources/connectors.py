"""Queues, graph files, snapshots and the upkeep of partitioned tables, by Spark's own sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def queue_stream(spark: SparkSession, servers: str, topic: str, schema: str, most: int = 100_000) -> DataFrame:
    """Messages of a Kafka topic as rows of ``schema``, ``most`` a batch at most; needs Spark's Kafka package on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).load()
    return parsed_messages(rows, schema)


def parsed_messages(rows: DataFrame, schema: str) -> DataFrame:
    """The JSON objects in the ``value`` of queue rows; those that don't parse are left out."""
    found = rows.select(F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"}).alias("m"), F.col("value"))
    return found.where("m IS NOT NULL").select("m.*")


def queue_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows as queue messages: the ``key`` and a JSON object of all columns."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def queue_sink(rows: DataFrame, key: str, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream to a Kafka topic."""
    return queue_rows(rows, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def write_graph_files(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Node and edge files with the headers that bulk importers of property graphs read."""
    typed = nodes.select(F.col("id").alias("id:ID"), *[c for c in nodes.columns if c not in ("id", "type")], F.col("type").alias(":LABEL"))
    linked = edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), *[c for c in edges.columns if c not in ("src", "dst", "relation")], F.col("relation").alias(":TYPE"))
    for name, rows in (("nodes", typed), ("edges", linked)):
        flat = rows.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in rows.schema])
        flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(os.path.join(root, name))


def read_graph_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of such files, all columns as text."""
    read = lambda name: spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(os.path.join(root, name))
    nodes = read("nodes").withColumnsRenamed({"id:ID": "id", ":LABEL": "type"})
    return nodes, read("edges").withColumnsRenamed({":START_ID": "src", ":END_ID": "dst", ":TYPE": "relation"})


def compacted(rows: DataFrame, path: str, keys: list[str], files: int) -> None:
    """Rewrites rows into ``files`` files of neighbouring ``keys``, so that filters on them skip most files."""
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def retained(rows: DataFrame, written: str, now: Column, days: int = 30) -> DataFrame:
    """Rows not older than ``days``; those without a time stay."""
    return rows.where(F.col(written).isNull() | (F.col(written) >= now - F.expr(f"INTERVAL {days} DAYS")))


def save_snapshot(frames: dict[str, DataFrame], root: str) -> None:
    """Each table of a dataset in a folder of its name; the last file written is a list of them, so a snapshot without it is unfinished."""
    for name, rows in frames.items():
        rows.write.mode("overwrite").parquet(os.path.join(root, name))
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(n,) for n in frames], "name string").coalesce(1).write.mode("overwrite").json(os.path.join(root, "_tables"))


def load_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    names = [r.name for r in spark.read.schema("name string").json(os.path.join(root, "_tables")).collect()]
    return {n: spark.read.parquet(os.path.join(root, n)) for n in names}
