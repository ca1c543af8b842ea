"""A log of tree growth that survives a crash.

Each level is a batch of tables (nodes, partitions, singles) with the level's number.
Its last write is one row under ``commits``, a single file that a job moves into place;
batches without that row are not read, and are written anew when growth goes on. The
replay of the log is the last row of every node.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class GrowthLog:
    """Batches of tables under ``path``, read up to the last whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def stage(self, level: int, **tables: DataFrame) -> None:
        """Write a level's tables; they count once ``seal`` has named the level."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/level={level}")

    def seal(self, level: int) -> None:
        one = self.spark.range(level, level + 1).select(F.col("id").cast("int").alias("level"))
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/at-{level}")

    def commit(self, level: int, **tables: DataFrame) -> None:
        self.stage(level, **tables)
        self.seal(level)

    def levels(self) -> list[int]:
        """The committed levels, one number each."""
        try:
            return sorted(r.level for r in self.spark.read.parquet(f"{self.path}/commits/*").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def read(self, name: str) -> DataFrame | None:
        """A table's rows of all committed levels, with ``level``; None where no level has it."""
        if not (levels := self.levels()):
            return None
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/{name}").option("mergeSchema", "true").parquet(f"{self.path}/{name}/level=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.where(F.col("level").isin(levels))

    def replay(self, name: str = "nodes", key: str = "node_id") -> DataFrame | None:
        """The last row of each key in the committed levels."""
        rows = self.read(name)
        if rows is None:
            return None
        last = Window.partitionBy(key).orderBy(F.desc("level"))
        return rows.withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at", "level")
