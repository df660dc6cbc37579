"""Gates, payload checks, quantisation and further measures, as column expressions and aggregates."""

from __future__ import annotations

import ast
import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators.graph import triangles
from lodestrata.operators.measures import entropy_of, mean_vector

# Limits of image and audio payloads.
LEAST_SIDE, MOST_BLUR, MOST_SECONDS, LEAST_SNR = 256, 0.2, 14_400, 10.0


def inside_root(path: str, root: str) -> str:
    """The real path, which must lie in ``root``; links and steps up are resolved first."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, base]) != base:
        raise ValueError("the path leaves the allowed folder")
    return real


def code_atoms(source: str) -> list[str]:
    """Top-level functions and classes of Python code; the whole source where there are none or it doesn't parse."""
    try:
        found = [ast.get_source_segment(source, n) for n in ast.parse(source).body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    except (SyntaxError, ValueError):
        found = []
    return [f for f in found if f] or [source]


def image_faults(width: Column, height: Column, blur: Column) -> Column:
    """Names of the rules that an image payload breaks; a missing value breaks its rule."""
    broken = [(~F.coalesce(width >= LEAST_SIDE, F.lit(False)), "width"), (~F.coalesce(height >= LEAST_SIDE, F.lit(False)), "height"), (~F.coalesce(blur <= MOST_BLUR, F.lit(False)), "blur_score")]
    return F.filter(F.array(*[F.when(c, name) for c, name in broken]), lambda x: x.isNotNull())


def audio_faults(duration: Column, snr: Column) -> Column:
    broken = [(~F.coalesce(duration <= MOST_SECONDS, F.lit(False)), "duration"), (~F.coalesce(snr >= LEAST_SNR, F.lit(False)), "snr")]
    return F.filter(F.array(*[F.when(c, name) for c, name in broken]), lambda x: x.isNotNull())


def gate_status(language_ok: Column, snr: Column, least_snr: Column, toxicity: Column, most_toxicity: float) -> Column:
    """What stops a text first: its language, its signal, its toxicity; ``ok`` if nothing does."""
    return F.when(~F.coalesce(language_ok, F.lit(False)), "language").when(~F.coalesce(snr >= least_snr, F.lit(False)), "snr").when(F.coalesce(toxicity > most_toxicity, F.lit(True)), "toxicity").otherwise("ok")


def drift_level(value: Column, warn: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warn, "warning").otherwise("ok")


def triangle_threshold(edges: DataFrame, weight: str, scale: float = 10.0) -> DataFrame:
    """(``threshold``): ``scale`` times the entropy in bits of the shares of the edges' weights, rounded half to even, 1 at least."""
    rows = edges.where(F.col(weight) > 0).select(F.col(weight).cast("double").alias("w"))
    total = rows.agg(F.sum("w").alias("total"))
    share = rows.crossJoin(F.broadcast(total)).select((F.col("w") / F.col("total")).alias("p"))
    return share.agg(F.greatest(F.lit(1.0), F.bround(-scale * F.sum(F.col("p") * F.log2("p")))).cast("int").alias("threshold"))


def invariants(edges: DataFrame) -> DataFrame:
    """(``entropy``, ``nodes``, ``edges``, ``triangles``, ``loops``): what a graph's dashboard watches; loops are independent cycles."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("n")).unionByName(pairs.select(F.col("v").alias("n")))
    degree = ends.groupBy("n").agg(F.count("*").alias("degree"))
    sizes = degree.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"))
    return entropy_of(degree, "degree").crossJoin(sizes).crossJoin(triangles(edges).agg(F.count("*").alias("triangles")))


def covering_motifs(edges: DataFrame, motifs: DataFrame) -> DataFrame:
    """(``motif``, ``gain``): motifs (motif, src, dst) by the edges that none before them covers, in the order of their own size.

    An edge goes to the largest motif that has it (the least name among equals), so the choice is one pass, not a loop.
    """
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    rows = motifs.select("motif", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().join(pairs, ["u", "v"], "left_semi")
    sized = rows.join(rows.groupBy("motif").agg(F.count("*").alias("size")), "motif")
    owner = sized.groupBy("u", "v").agg(F.min_by("motif", F.struct(-F.col("size"), "motif")).alias("motif"))
    return owner.groupBy("motif").agg(F.count("*").alias("gain"))


def exponential_map(v: Column, curvature: float = 1.0) -> Column:
    """From the tangent space at the origin into the ball; a zero vector stays."""
    root = curvature**0.5
    n = V.norm(v)
    return F.when(n > 0, F.transform(V.as_double(v), lambda x: F.tanh(root * n) * x / (root * n))).otherwise(V.as_double(v))


def logarithmic_map(y: Column, curvature: float = 1.0) -> Column:
    """From the ball to the tangent space at the origin."""
    root = curvature**0.5
    n = V.norm(y)
    z = F.least(root * n, F.lit(1 - 1e-9))
    return F.when(n > 0, F.transform(V.as_double(y), lambda x: 0.5 * F.log((1 + z) / (1 - z)) * x / (root * n))).otherwise(V.as_double(y))


def recentred(vectors: DataFrame, key: str, vec: str, curvature: float = 1.0) -> DataFrame:
    """``vectors`` moved by the Möbius sum with the mean's opposite, so that their mean lies near the origin."""
    mean = mean_vector(vectors, vec).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "mean"))), lambda s: -s["mean"]).alias("_m"))
    moved = vectors.crossJoin(F.broadcast(mean))
    return moved.select(key, V.clamped_to_ball(V.mobius_sum(V.clamped_to_ball(F.col("_m")), F.col(vec), curvature)).alias(vec))


def merged_weights(base: DataFrame, delta: DataFrame, key: str, weights: str) -> DataFrame:
    """``base`` with the ``delta`` of the same key added number by number; keys without one stay."""
    rows = base.select(key, V.as_double(F.col(weights)).alias("w")).join(delta.select(key, V.as_double(F.col(weights)).alias("d")), key, "left")
    return rows.select(key, F.when(F.col("d").isNull(), F.col("w")).otherwise(F.zip_with("w", "d", lambda x, y: x + y)).alias(weights))


def grouped_scales(a: Column, size: int) -> Column:
    """The greatest magnitude of each run of ``size`` numbers over 127."""
    runs = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))
    return F.transform(runs, lambda i: F.array_max(F.transform(F.slice(V.as_double(a), i * size + 1, F.lit(size)), lambda x: F.abs(x))) / 127)


def four_bit(a: Column, size: int) -> Column:
    """Each number in sevenths of its run's greatest magnitude, rounded half to even; a run of zeros gives zeros."""
    runs = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))

    def run(i):
        part = F.slice(V.as_double(a), i * size + 1, F.lit(size))
        most = F.array_max(F.transform(part, lambda x: F.abs(x)))
        return F.transform(part, lambda x: F.when(most > 0, F.bround(x / most * 7)).otherwise(F.lit(0.0)).cast("int"))

    return F.flatten(F.transform(runs, run))


#: Sixteen levels of a normal distribution's quantiles, 0 among them, scaled to 1 (a fixed table of the format).
NF4 = (-1.0, -0.6961928, -0.5250731, -0.3949175, -0.2844414, -0.1847734, -0.0910500, 0.0, 0.0795803, 0.1609302, 0.2461123, 0.3379152, 0.4407098, 0.5626170, 0.7229568, 1.0)


def normal_float(a: Column, size: int) -> Column:
    """The index of the nearest ``NF4`` level of each number over its run's greatest magnitude; the lower one of two as near."""
    levels = F.array(*map(F.lit, NF4))
    runs = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))

    def run(i):
        part = F.slice(V.as_double(a), i * size + 1, F.lit(size))
        most = F.greatest(F.array_max(F.transform(part, lambda x: F.abs(x))), F.lit(1e-12))
        return F.transform(part, lambda x: F.array_position(F.transform(levels, lambda y: F.abs(y - x / most)), F.array_min(F.transform(levels, lambda y: F.abs(y - x / most)))).cast("int") - 1)

    return F.flatten(F.transform(runs, run))


def minhash_of_diagram(diagram: DataFrame, graph: str, hashes: int = 8) -> DataFrame:
    """(``graph``, ``n``, ``value``): the least of the seeded hashes of a diagram's points, for each of ``hashes`` seeds; the first 15 hexadecimal digits of SHA-256 as a number."""
    points = diagram.select(graph, F.concat_ws(",", F.format_number("birth", 6), F.format_number("death", 6)).alias("p")).distinct()
    rows = points.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", "n", "p"), 256), 1, 15), 16, 10).cast("bigint")
    return rows.groupBy(graph, "n").agg(F.min(digest).alias("value"))


def classification_line(text: Column, label: Column, labels: Column, end: str) -> Column:
    """``text`` and its label; 0 and null fall back to ``labels``."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\t"), F.coalesce(F.nullif(label, F.lit(0)), labels).cast("string"), F.lit(end))


def task_of(columns: list[str], stated: str | None = None) -> str:
    """What a table is for: as stated, else by its columns."""
    if stated:
        return stated
    names = set(columns)
    if {"chosen", "rejected"} <= names:
        return "rlhf"
    return "classification" if {"label", "labels"} & names else "generation" if {"question", "answer"} <= names or {"instruction", "output"} <= names or "prompt" in names else "text"


def accumulation_steps(batch: int, available: float) -> int:
    return max(1, -(-batch // max(1, int(available)))) if available > 0 else batch


def matched_share(found: DataFrame, truth: DataFrame, key: str, name: str, aliases: DataFrame) -> DataFrame:
    """(``key``, ``reward``): the share of each key's ``found`` names that are true as they stand or by an alias (alias, name), case aside."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    rows = found.select(key, low(name).alias("n")).distinct()
    meant = aliases.select(low("alias").alias("n"), low("name").alias("m")).distinct()
    known = truth.select(key, low(name).alias("t")).distinct()
    exact = rows.join(known.withColumnRenamed("t", "n"), [key, "n"], "left_semi")
    by_alias = rows.join(meant, "n").join(known.withColumnRenamed("t", "m"), [key, "m"], "left_semi").select(key, "n")
    hits = exact.unionByName(by_alias).distinct().groupBy(key).agg(F.count("*").alias("h"))
    return rows.groupBy(key).agg(F.count("*").alias("k")).join(hits, key, "left").select(key, (F.coalesce("h", F.lit(0)) / F.col("k")).alias("reward"))


# Fields that the result of a step must have.
STEP_FIELDS = {"GENERATE_QA": ("question", "answer"), "GENERATE_COT": ("question", "reasoning", "answer"), "CURATE": ("question", "answer", "rating"), "LABEL_PAIRS": ("question", "chosen", "rejected"), "RANK_RESPONSES": ("question", "answers")}


def missing_fields(step: str, columns: list[str]) -> list[str]:
    """Fields that the result of a step lacks; a step without a rule lacks nothing."""
    return [f for f in STEP_FIELDS.get(step, ()) if f not in columns]


# Units and what one of them is in the unit of the international system.
UNITS = {"km": (1000.0, "m"), "cm": (0.01, "m"), "mm": (0.001, "m"), "miles": (1609.344, "m"), "ft": (0.3048, "m"), "g": (0.001, "kg"), "mg": (0.000001, "kg"), "tonnes": (1000.0, "kg"), "lb": (0.45359237, "kg"), "hours": (3600.0, "s"), "minutes": (60.0, "s"), "ms": (0.001, "s"), "litres": (0.001, "m3")}
_QUANTITY = re.compile(r"(?<![\w.])(\d+(?:\.\d+)?) ?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b")


def in_base_units(text: str | None) -> str | None:
    """Quantities written in base units, as far as their units are known."""

    def base(found: re.Match) -> str:
        factor, unit = UNITS[found[2]]
        return f"{float(found[1]) * factor:.9g} {unit}"

    return None if text is None else _QUANTITY.sub(base, text)


def lenient_pairs(text: str | None) -> list[tuple[str, str]]:
    """(question, answer) pairs of a model's text: JSON, else JSON with single quotes, bare keys, comments and trailing commas, else by pattern."""
    if not text:
        return []
    begin, end = text.find("["), text.rfind("]")
    body = text[begin : end + 1] if 0 <= begin < end else text
    mended = re.sub(r"//[^\n]*|/\*.*?\*/", "", body, flags=re.S)
    mended = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', mended)
    mended = re.sub(r"(?<=[\[{,:\s])'((?:[^'\\]|\\.)*)'(?=\s*[,:}\]])", lambda m: json.dumps(m[1].replace("\\'", "'")), mended)
    mended = re.sub(r",(\s*[}\]])", r"\1", mended)
    for candidate in (body, mended):
        try:
            rows = json.loads(candidate, strict=False)
        except ValueError:
            continue
        if isinstance(rows, list):
            return [(str(r["question"]), str(r["answer"])) for r in rows if isinstance(r, dict) and r.get("question") and r.get("answer")]
    found = re.findall(r'"question"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"answer"\s*:\s*"((?:[^"\\]|\\.)*)"', text, flags=re.S)
    return [(json.loads(f'"{q}"', strict=False), json.loads(f'"{a}"', strict=False)) for q, a in found]
