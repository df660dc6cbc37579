"""Chunks by meaning over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators.segments import segmented
from lodestrata.tables import table


def chunk_semantic(spark, sf_dir):
    return segmented(table(spark, sf_dir, "documents"), "doc_id", "text", "semantic", 1200).select("doc_id", "n", F.length("chunk").alias("size"), F.md5("chunk").alias("fingerprint"))


def chunk_summary(spark, sf_dir):
    return segmented(table(spark, sf_dir, "documents"), "doc_id", "text", "summary", 1200).select("doc_id", "n", F.length("chunk").alias("size"), F.md5("chunk").alias("fingerprint"))


QUERIES = {f.__name__: f for f in (chunk_semantic, chunk_summary)}
ORACLES: dict[str, str] = {}
