"""Stratified samples, randomised answers and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotas(k: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole quotas that sum to ``k``; what is left goes to the largest fractions, in the given order."""
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("the ratios must sum to 1")
    exact = {c: r * k for c, r in ratios.items()}
    found = {c: int(v) for c, v in exact.items()}
    for c in sorted(exact, key=lambda c: found[c] - exact[c])[: k - sum(found.values())]:
        found[c] += 1
    return found


def stratified_sample(rows: DataFrame, key: str, label: str, k: int, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """A uniform sample of each label up to its quota; the same for the same seed, whatever the partitions.

    Each task keeps its own least hashes before they are ranked, so no label gathers in one task.
    """
    found = quotas(k, ratios)
    quota: Column = F.lit(0)
    for name, n in found.items():
        quota = F.when(F.col(label) == name, F.lit(n)).otherwise(quota)
    hashed = rows.where(F.col(label).isin(*found)).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    first = Window.partitionBy(label, "_part").orderBy("_h", key)
    local = hashed.withColumn("_part", F.spark_partition_id()).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= quota)
    ranked = local.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", key))).where(F.col("_r") <= quota)
    return ranked.drop("_h", "_part", "_r")


def randomized_response(rows: DataFrame, column: str, pool: list[str], k: int, key: str, seed: int = 0) -> DataFrame:
    """Keeps a value with probability k / (k + 1), else draws one from the ``pool``; the draw is a hash of the key and the seed."""
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) / 1_000_003.0
    drawn = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(len(pool))) + 1).cast("int"))
    return rows.withColumn(column, F.when(chance < k / (k + 1), F.col(column)).otherwise(drawn))


def synonym_variants(text: Column, synonyms: dict[str, list[str]], k: int) -> Column:
    """``k`` variants; variant i uses the i-th synonym of each word, going round."""
    table = F.create_map(*[x for w, s in synonyms.items() for x in (F.lit(w), F.array(*map(F.lit, s)))])

    def variant(i: Column) -> Column:
        def swap(w: Column) -> Column:
            options = F.try_element_at(table, F.lower(w))
            return F.coalesce(F.element_at(options, (F.pmod(i, F.size(options)) + 1).cast("int")), w)

        return F.array_join(F.transform(F.split(text, " "), swap), " ")

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), variant)
