"""Pictures: a reader of PNG and PPM files without other libraries, their size, sharpness and perceptual hash."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.tables import share_package

#: Channels of a PNG by its kind of colour (grey, true, grey and alpha, true and alpha).
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
HASH_SIDE = 8


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Lines of a PNG after their filters (none, left, up, mean, Paeth) are undone."""
    out = np.zeros((height, stride), dtype=np.uint8)
    before = np.zeros(stride, dtype=np.int64)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind:
            for x in range(stride):
                left = line[x - step] if x >= step else 0
                corner = before[x - step] if x >= step else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + before[x]) // 2
                else:
                    p = left + before[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - before[x]), 1, before[x]), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        out[y] = before = line
    return out


def decoded(content: bytes) -> np.ndarray:
    """Grey levels 0 to 255 (height, width) of an 8-bit PNG without interlacing, or of a binary PPM or PGM."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at, data, head = 8, b"", None
        while at < len(content):
            size, name = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + size]
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif name == b"IDAT":
                data += body
            at += 12 + size
        width, height, depth, colour, _, _, interlace = head
        if depth != 8 or colour not in _CHANNELS or interlace:
            raise ValueError("only 8-bit PNG files without palette and interlacing are read")
        channels = _CHANNELS[colour]
        pixels = _unfiltered(zlib.decompress(data), height, width * channels, channels).reshape(height, width, channels).astype(float)
        pixels = pixels[:, :, : 3 if channels > 2 else 1]
    elif content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while content[at : at + 1].isspace():
                at += 1
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(int(content[at:end]))
            at = end
        width, height, _ = fields
        channels = 1 if content[:2] == b"P5" else 3
        pixels = np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels).astype(float)
    else:
        raise ValueError("no PNG, PPM or PGM file")
    return pixels @ (np.array([0.299, 0.587, 0.114]) if pixels.shape[2] == 3 else np.ones(1))


def _laplace(grey: np.ndarray) -> np.ndarray:
    """Differences from the four neighbours, edges wrapped around."""
    return sum(np.roll(grey, s, axis) for axis in (0, 1) for s in (1, -1)) - 4 * grey


def blur_score(grey: np.ndarray) -> float:
    """1 for an even picture, towards 0 for a sharp one."""
    return float(1 / (1 + (_laplace(grey / 255) ** 2).mean()))


def caption_worthy(grey: np.ndarray, threshold: float = 0.4) -> bool:
    """Whether sharpness and exposure together are enough for a caption to be asked for."""
    sharpness = min(1.0, float(_laplace(grey).var()) / 10)
    exposure = 1 - abs(float(grey.mean()) / 255 - 0.5) * 2
    return (sharpness * exposure) ** 0.5 > threshold


def perceptual_hash(grey: np.ndarray, side: int = HASH_SIDE) -> int:
    """Signs of the lowest frequencies of a small copy against their median, as a signed 64-bit number; much the same for resized and slightly changed pictures."""
    n = side * 4
    rows = np.clip((np.arange(n) + 0.5) * grey.shape[0] / n, 0, grey.shape[0] - 1).astype(int)
    columns = np.clip((np.arange(n) + 0.5) * grey.shape[1] / n, 0, grey.shape[1] - 1).astype(int)
    small = grey[np.ix_(rows, columns)]
    basis = np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(side)[:, None])
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">i8")[0])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``checksum``, ``width``, ``height``, ``blur_score``, ``caption``, ``phash``, ``error``) of the pictures below ``path``; one that can't be read says why."""
    share_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for batch in batches:
            rows = []
            for content in batch.column(2).to_pylist():
                try:
                    grey = decoded(content)
                    rows.append((grey.shape[1], grey.shape[0], blur_score(grey), caption_worthy(grey), perceptual_hash(grey), None))
                except Exception as wrong:  # noqa: BLE001  a broken file is a row that says so
                    rows.append((None, None, None, None, None, f"{type(wrong).__name__}: {wrong}"))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, types))], names=["path", "checksum", "width", "height", "blur_score", "caption", "phash", "error"])

    schema = "path string, checksum string, width int, height int, blur_score double, caption boolean, phash bigint, error string"
    return files.select("path", F.md5("content").alias("checksum"), "content").mapInArrow(run, schema)


def first_of_alike(images: DataFrame) -> DataFrame:
    """Pictures of one perceptual hash once, the first by path; those without a hash stay."""
    known = images.where("phash IS NOT NULL")
    columns = [c for c in images.columns if c != "phash"]
    first = known.groupBy("phash").agg(F.min_by(F.struct(*columns), "path").alias("r")).select("r.*", "phash")
    return first.select(images.columns).unionByName(images.where("phash IS NULL"))
