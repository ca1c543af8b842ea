"""Tables ordered by position, and filters from loci that let a scan skip most of them.

Rows are dealt by ranges of (chrom, st) and sorted, so that a file, and a row group in it,
holds a stretch of one or a few chromosomes. A filter on stretches, made from the loci
before the scan, then reaches the files' statistics: what holds none of them is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a window whose loci make one stretch (a power of two), and stretches of a filter at most.
WINDOW_BITS, MOST = 22, 256


def write_clustered(df: DataFrame, path: str, files: int | None = None, group_bytes: int | None = None) -> None:
    """Write intervals (chrom, st, en) as Parquet in order of position; ``files`` as many files or fewer."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, "chrom", "st").sortWithinPartitions("chrom", "st", "en").write.mode("overwrite")
    (out.option("parquet.block.size", group_bytes) if group_bytes else out).parquet(path)


def stretches(loci: DataFrame, most: int = MOST) -> list[tuple[str, int, int]] | None:
    """At most ``most`` stretches that hold all loci: one a window with loci, or else one a chromosome.

    None where even the chromosomes are more than ``most``.
    """
    whole = loci.where("st < en")
    for window in ([F.expr(f"shiftright(st, {WINDOW_BITS})")], []):
        found = whole.groupBy("chrom", *window).agg(F.min("st").alias("lo"), F.max("en").alias("hi")).limit(most + 1).collect()
        if len(found) <= most:
            return sorted((r.chrom, r.lo, r.hi) for r in found if r.chrom is not None)
    return None


def within(held: list[tuple[str, int, int]] | None) -> Column:
    """Whether an interval (chrom, st, en) meets one of the stretches; all do where there are none to tell."""
    if held is None:
        return F.lit(True)
    tests = [(F.col("chrom") == c) & (F.col("st") < hi) & (F.col("en") > lo) for c, lo, hi in held]
    return reduce(Column.__or__, tests, F.lit(False)) if tests else F.lit(False)


def under(table: DataFrame, loci: DataFrame) -> DataFrame:
    """The rows of a clustered table that can meet the loci; an overlap join then settles which do."""
    return table.where(within(stretches(loci)))
