"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in local
    tests, the context's checkpoint folder takes its place; a local session gets a
    temporary one, and a cluster must name one.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    context = spark.sparkContext
    if not (root := context.getCheckpointDir()):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="intervale-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/intervale/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Remove what this session wrote to the shared folder."""
    while _paths:
        spark, path = _paths.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit; the cluster then clears its own folder
            return
