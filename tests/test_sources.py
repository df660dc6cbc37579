"""Pictures, graph files, snapshots and queue messages."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.sources import connectors, images


def png(grey, kind=0):
    """A PNG of grey levels, each line with one kind of filter."""
    h, w = grey.shape
    lines, before = [], np.zeros(w, dtype=int)
    for row in grey.astype(int):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], before[:-1]])
        p = left + before - corner
        near = [abs(p - left), abs(p - before), abs(p - corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        before = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    smooth = np.add.outer(np.linspace(0, 120, 64), np.linspace(0, 100, 48)).astype(np.uint8)
    noise = rng.integers(0, 256, (64, 48)).astype(np.uint8)
    for kind in range(5):
        assert (images.decoded(png(noise, kind)) == noise).all()
    assert images.blur_score(smooth) > 0.9 > images.blur_score(noise) and images.caption_worthy(noise) and not images.caption_worthy(np.zeros((9, 9)))
    assert images.perceptual_hash(smooth) == images.perceptual_hash(np.repeat(np.repeat(smooth, 2, 0), 2, 1)) != images.perceptual_hash(noise)
    for name, content in (("a.png", png(smooth)), ("b.ppm", b"P6 48 64 255\n" + np.repeat(smooth[:, :, None], 3, 2).tobytes()), ("c.pgm", b"P5\n48 64\n255\n" + noise.tobytes()), ("d.png", b"no picture")):
        (tmp_path / name).write_bytes(content)
    found = images.read_images(spark, str(tmp_path)).cache()
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert (rows["a.png"].width, rows["a.png"].height) == (48, 64) and rows["a.png"].phash == rows["b.ppm"].phash and rows["d.png"].error
    assert sorted(r.path.rsplit("/", 1)[1] for r in images.first_of_alike(found).collect()) == ["a.png", "c.pgm", "d.png"]


def test_graph_files_and_snapshots(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "chunk", 'a "quoted",\ntext', 1), ("b", "entity", None, None)], "id string, type string, text string, page int")
    edges = spark.createDataFrame([("a", "b", "mentions", 3)], "src string, dst string, relation string, sequence int")
    connectors.write_graph_files(nodes, edges, str(tmp_path / "graph"))
    n, e = connectors.read_graph_files(spark, str(tmp_path / "graph"))
    assert sorted((r.id, r.type, r.text) for r in n.collect()) == [("a", "chunk", 'a "quoted",\ntext'), ("b", "entity", None)] and [(r.src, r.dst, r.relation, r.sequence) for r in e.collect()] == [("a", "b", "mentions", "3")]
    connectors.save_snapshot({"nodes": nodes, "edges": edges}, str(tmp_path / "snap"))
    back = connectors.load_snapshot(spark, str(tmp_path / "snap"))
    assert set(back) == {"nodes", "edges"} and back["nodes"].count() == 2
    connectors.compacted(spark.range(1000).withColumn("k", F.pmod("id", F.lit(7))), str(tmp_path / "z"), ["k"], 4)
    ranges = spark.read.parquet(str(tmp_path / "z")).groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("b")).collect()
    assert len(ranges) <= 4 and sum(r.b - r.a for r in ranges) <= 7


def test_messages(spark):
    rows = connectors.queue_rows(spark.createDataFrame([(1, "x"), (2, None)], "id bigint, name string"), "id")
    assert [r.key for r in rows.collect()] == ["1", "2"]
    more = rows.select(F.col("value").cast("binary").alias("value")).unionByName(spark.createDataFrame([(None,)], "value binary"))
    assert sorted((r.id, r.name) for r in connectors.parsed_messages(more, "id bigint, name string").collect()) == [(1, "x"), (2, None)]
    old = spark.sql("SELECT 1 AS i, TIMESTAMP '2024-01-01' AS t UNION ALL SELECT 2, TIMESTAMP '2024-03-01' UNION ALL SELECT 3, NULL")
    assert sorted(r.i for r in connectors.retained(old, "t", F.lit("2024-03-02").cast("timestamp")).collect()) == [2, 3]


def test_search_in_parts_is_the_same(spark):
    from lodestrata.operators import search

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, []), (303, [1.0])]
    vectors = spark.createDataFrame(rows, "id bigint, v array<double>")
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    for measure in ("cosine", "dot", "poincare"):
        small = vectors.withColumn("v", F.transform("v", lambda x: x / 8))
        held = {tuple(r) for r in search.nearest(asked.withColumn("q", F.transform("q", lambda x: x / 8)), small, 4, "id", "v", measure).collect()}
        parts = {tuple(r) for r in search.nearest(asked.withColumn("q", F.transform("q", lambda x: x / 8)), small, 4, "id", "v", measure, held=3).collect()}
        assert held == parts and len(held) == asked.count() * 4
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 6}
    best = sorted((-(unit[0] @ u), i) for i, u in unit.items() if i != 0)[:4]
    got = sorted((r["rank"], r.id) for r in search.nearest(asked, vectors, 4, "id", "v").where("query = 0").collect())
    assert [i for _, i in best] == [i for _, i in got]
    assert search.nearest(asked.limit(0), vectors, 4, "id", "v").count() == 0
