"""The flagship: documents, chunked and deduplicated, counted for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import clean_text, normalized, sliding_windows
from lodestrata.tables import table


def slice_chunks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = (
        table(spark, sf_dir, "documents")
        .select("source", F.explode(sliding_windows(clean_text(F.col("text")), 512, 64)).alias("chunk"))
        .select("source", F.length("chunk").alias("size"), F.md5(normalized(F.col("chunk"))).alias("fingerprint"))
    )
    return chunks.groupBy("source").agg(
        F.count("*").alias("chunks"),
        F.countDistinct("fingerprint").alias("distinct_chunks"),
        F.round(F.avg("size"), 4).alias("avg_size"),
        F.round(F.least(F.lit(1.0), F.count("*") / 3.0), 6).alias("trust"),
    )


QUERIES = {"slice_chunks_per_source": slice_chunks_per_source}

ORACLES = {
    "slice_chunks_per_source": r"""
WITH clean AS (
  SELECT source, trim(regexp_replace(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t
  FROM documents WHERE text IS NOT NULL),
chunks AS (
  SELECT source, substr(t, (i * 448 + 1)::BIGINT, 512) AS chunk
  FROM (SELECT source, t, unnest(range(0, greatest(0, ceil((length(t) - 512) / 448.0))::BIGINT + 1)) AS i FROM clean WHERE length(t) > 0))
SELECT source, count(*)::BIGINT AS chunks, count(DISTINCT md5(lower(trim(chunk))))::BIGINT AS distinct_chunks,
       round(avg(length(chunk)), 4) AS avg_size, round(least(1.0, count(*) / 3.0), 6)::DOUBLE AS trust
FROM chunks GROUP BY source"""
}
