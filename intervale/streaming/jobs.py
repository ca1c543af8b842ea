"""A long-running service: every interval file that arrives is fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans.batch import fit_batch
from ..plans.engine import Config, Engine
from ..sources.sinks import model_table, model_values


def refusals(df: DataFrame) -> DataFrame:
    """Jobs whose files have a line that is no weighted interval: job, lines, reason."""
    reason = (
        F.when(F.expr("chrom IS NULL OR st IS NULL OR en IS NULL"), "a field is missing or no number")
        .when(F.expr("st < 0 OR en < st"), "an interval ends before it starts")
        .when(F.col("weight") < 0, "a weight is negative")
    )
    bad = df.withColumn("reason", reason).where("reason IS NOT NULL")
    return bad.groupBy("job").agg(F.count("*").alias("lines"), F.min("reason").alias("reason"))


def fit_arrivals(spark: SparkSession, engine: Engine, inbox: str, results: str, checkpoint: str, config: Config = Config(), once: bool = True, refused: str | None = None, files: int = 1000):  # noqa: B008
    """Watch ``inbox`` for weighted BED files and append a fit of each to ``results``.

    A file is a job, named by its path. The files of a batch, at most ``files``, are
    fitted together. Batches can be replayed after a failure; rows are written under the
    batch's number, so a replay replaces them. A file with a bad line is not fitted but
    listed under ``refused`` (``results`` with ``-refused`` after it), and the others of
    its batch are.
    """
    refused = refused or f"{results.rstrip('/')}-refused"
    stream = spark.readStream.schema(schemas.WEIGHTED_LOCUS).option("sep", "\t").option("maxFilesPerTrigger", files)
    arrivals = stream.csv(inbox).withColumn("job", F.col("_metadata.file_path"))

    def batch(df: DataFrame, number: int) -> None:
        df = df.withColumn("weight", F.coalesce("weight", F.lit(1)) if config.max_weight > 1 else F.lit(1)).persist()
        bad = refusals(df).persist()
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{refused}/batch={number}")
        found = fit_batch(engine, df.join(F.broadcast(bad.select("job")), "job", "left_anti"), config)  # one row a file
        if found:
            values = [v for job, (fit, stats) in found.items() for v in model_values(job, fit, stats)]
            model_table(spark, values).write.mode("overwrite").parquet(f"{results}/batch={number}")
        bad.unpersist()
        df.unpersist()

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
