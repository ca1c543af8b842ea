"""Shared plumbing: tables of the shared folder, ranks and sums in levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_path, shared_root

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
__all__ = ["WORD_PATTERN", "materialize", "running_sums", "shared_path", "shared_root", "table", "two_level_sum"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Chunks of a group that one task puts in order.
FAN = 1024


def _before(totals: DataFrame, group: list[str], chunk: str, chunks: int) -> DataFrame:
    """``totals`` (group, chunk, _total) with _before, the sum of the group's earlier chunks."""
    if chunks <= FAN:
        outer = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumn("_before", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
    span = f"_{chunk}"  # a name of its own at every level
    spans = totals.withColumn(span, F.expr(f"{chunk} div {FAN}"))
    return two_level_sum(spans, group, span, [chunk], "_total", "_before", -(-chunks // FAN)).drop(span)


def two_level_sum(df: DataFrame, group: list[str], chunk: str, order: list, value: str, out: str, chunks: int = FAN) -> DataFrame:
    """Exclusive running sum of ``value`` over (chunk, order) within ``group``.

    A window per (group, chunk) sums inside chunks, numbered below ``chunks``, and the
    chunks' totals are summed in the same way, FAN at a time. No task holds a group.
    """
    inner = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = _before(df.groupBy(*group, chunk).agg(F.sum(value).alias("_total")), group, chunk, chunks).drop("_total")
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    left, right = inside.alias("l"), totals.alias("r")
    joined = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*group, chunk]])
    return joined.select("l.*", (F.col("_inside") + F.col("_before")).cast("long").alias(out)).drop("_inside")


def running_sums(df: DataFrame, order: list, **sums: Column) -> DataFrame:
    """Exclusive running sums over all rows in ``order``, which must tell all rows apart.

    Rows are dealt by ranges, summed within a range, and the ranges' totals, one a task,
    are summed before them. ``df`` is computed twice and stored.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumns({f"_{k}": c for k, c in sums.items()} | {"_range": F.spark_partition_id()}), "ranged")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(up), F.lit(0)).alias(f"_all_{k}") for k in sums])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(inner), F.lit(0)) for k in sums})
    joined = inside.join(F.broadcast(totals), "_range").withColumns({k: F.col(f"_{k}") + F.col(f"_all_{k}") for k in sums})
    return joined.select(*df.columns, *sums)
