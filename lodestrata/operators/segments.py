"""Chunks by meaning, and measures of sound files: what needs a whole document or file at once."""

from __future__ import annotations

import io
import math
import re
import wave
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.tables import share_package

_WORD = re.compile(r"\b\w\w+\b")


def semantic_chunks(text: str | None, size: int, drop: float = 0.3) -> list[str]:
    """Sentences joined until the next is unlike the last (tf-idf cosine below ``drop``) or the chunk would exceed ``size`` characters."""
    sentences = [s.strip() for s in (text or "").split(".") if s.strip()]
    if not sentences:
        return []
    counts = [Counter(_WORD.findall(s.lower())) for s in sentences]
    frequency = Counter(w for c in counts for w in c)
    n = len(sentences)
    vectors = []
    for c in counts:
        v = {w: k * (math.log((1 + n) / (1 + frequency[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()} if norm else {})
    chunks, current = [], sentences[0]
    for i in range(1, n):
        alike = sum(x * vectors[i].get(w, 0.0) for w, x in vectors[i - 1].items())
        if len(current) + len(sentences[i]) > size or alike < drop:
            chunks.append(current)
            current = sentences[i]
        else:
            current += ". " + sentences[i]
    return [*chunks, current]


def summarized_chunks(text: str | None, size: int, words: int = 20) -> list[str]:
    """Semantic chunks, each after the last words of the one before."""
    out, before = [], ""
    for chunk in semantic_chunks(text, size):
        head = " ".join(before.split()[-words:])
        out.append(f"{head} {chunk}" if head else chunk)
        before = chunk
    return out


def segmented(docs: DataFrame, key: str, text: str, method: str, size: int) -> DataFrame:
    """(``key``, ``n``, ``chunk``) by ``semantic`` or ``summary`` chunks."""
    share_package(docs.sparkSession)
    work = {"semantic": semantic_chunks, "summary": summarized_chunks}[method]

    def run(batches):
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(*(x.to_pylist() for x in batch.columns)) for i, c in enumerate(work(t, size))]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int32(), pa.string()))], names=[key, "n", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n int, chunk string")


def sound_measures(content: bytes) -> tuple[int, float, float]:
    """Sample rate, seconds, and signal over noise in decibels (noise from differences of neighbours; infinite without any)."""
    with wave.open(io.BytesIO(content)) as file:
        rate, frames = file.getframerate(), file.getnframes()
        samples = np.frombuffer(file.readframes(frames), dtype=np.int16).astype(float)
    if len(samples) < 2:
        return rate, frames / rate, math.inf
    noise = math.sqrt(np.mean(np.diff(samples) ** 2)) / math.sqrt(2)
    return rate, frames / rate, 20 * math.log10(math.sqrt(np.mean(samples**2)) / noise) if noise else math.inf


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``rate``, ``seconds``, ``snr``, ``valid``) of WAV files; broken ones have nulls and aren't valid."""
    share_package(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append((name, *sound_measures(content)))
                except Exception:  # noqa: BLE001  a broken file is a row of nulls
                    rows.append((name, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.float64(), pa.float64()))], names=["path", "rate", "seconds", "snr"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "path string, rate int, seconds double, snr double")
    return found.withColumn("valid", F.coalesce((F.col("seconds") <= 14_400) & (F.col("snr") >= 10), F.lit(False)))
