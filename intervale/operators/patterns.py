"""Aggregations of joined sites: pattern counts, counters, shrunken means, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_counts(sites: DataFrame, keys: list[str] = ["block_id", "cls", "maj_idx", "min_idx"], weight: str = "weight", length: str = "len") -> DataFrame:  # noqa: B006
    """Weighted number of positions with each pattern."""
    return sites.groupBy(*keys).agg(F.sum(F.col(weight) * F.col(length)).cast("long").alias("n"))


def expand_patterns(patterns: DataFrame) -> DataFrame:
    """One row per counted position; the inverse of ``pattern_counts``."""
    return patterns.where("n > 0").select(*[c for c in patterns.columns if c != "n"], F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy")


def site_counters(sites: DataFrame) -> DataFrame:
    """Positions of each class (M, L, H), counted once and by weight; one row."""
    made = []
    for c in "MLH":
        made.append(F.sum(F.when(F.col("cls") == c, F.col("len")).otherwise(0)).cast("long").alias(f"{c.lower()}_raw"))
        made.append(F.sum(F.when(F.col("cls") == c, F.col("len") * F.col("weight")).otherwise(0)).cast("long").alias(f"{c.lower()}_weighted"))
    return sites.agg(*made)


def loci_info(loci: DataFrame) -> DataFrame:
    """Number of intervals, positions, and positions by weight; one row."""
    length = F.col("en") - F.col("st")
    return loci.agg(F.count("*").alias("loci"), F.sum(length).cast("long").alias("positions"), F.sum(length * F.col("weight")).cast("long").alias("weighted"))


def shrunk_mean(df: DataFrame, value: str, weight: str, prior: float, prior_weight: float, scale: float = 1.0, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted mean with ``prior_weight`` pseudo-observations of ``prior``."""
    top = F.sum(F.col(weight) * F.col(value)) * scale + prior_weight * prior
    return df.groupBy(*keys).agg((top / (F.sum(weight) * scale + prior_weight)).alias("mean"))


def pseudocount_ratio(df: DataFrame, hit: str, weight: str, prior: float, prior_weight: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Share of weight where ``hit`` holds, with pseudo-counts."""
    top = F.sum(F.when(F.expr(hit), F.col(weight)).otherwise(0)) + prior_weight * prior
    return df.groupBy(*keys).agg((top / (F.sum(weight) + prior_weight)).alias("ratio"))


def class_matrix(sites: DataFrame, weight: str | None = None) -> DataFrame:
    """Expected ancestral alleles (major, minor, other) of each class."""
    w = F.col(weight) if weight else F.lit(1.0)
    other = 1.0 - F.col("p_maj") - F.col("p_min")
    return sites.groupBy("cls").agg(F.sum(w * F.col("p_maj")).alias("maj"), F.sum(w * F.col("p_min")).alias("min"), F.sum(w * other).alias("oth"))


def block_normalised_matrix(sites: DataFrame, block: str = "block_id") -> DataFrame:
    """``class_matrix`` in which every block counts as one site.

    The sites of a block are counted by aggregation and joined back, so a block of
    any size is summed on the map side.
    """
    per = sites.groupBy(block, "cls").agg(F.count("*").alias("n"), F.sum("p_maj").alias("a"), F.sum("p_min").alias("i"), F.sum(1.0 - F.col("p_maj") - F.col("p_min")).alias("o"))
    total = per.groupBy(block).agg(F.sum("n").alias("total"))
    shares = per.join(total, block)
    return shares.groupBy("cls").agg(*[F.sum(F.col(x) / F.col("total")).alias(n) for x, n in (("a", "maj"), ("i", "min"), ("o", "oth"))])


def pattern_totals(patterns: DataFrame) -> DataFrame:
    """Distinct patterns and sites of each class."""
    return patterns.groupBy("cls").agg(F.count("*").alias("patterns"), F.sum("n").cast("long").alias("sites"))
