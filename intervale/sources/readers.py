"""Readers with explicit schemas. Text may be gzip or bzip2, as Spark reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def _tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with theta and lambda in single precision, numbered in order of position."""
    fields = F.split(F.regexp_replace("value", r"\s+", "\t"), "\t")
    rows = spark.read.text(path).where(F.trim("value") != "")
    df = rows.select(*[F.try_element_at(fields, F.lit(i + 1)).cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.BLOCK)])
    return df.withColumn("block_id", F.concat_ws(":", "chrom", "st", "en"))


def read_polys(spark: SparkSession, path: str) -> DataFrame:
    """Polymorphic sites; a frequency class other than L or H is an error."""
    df = _tsv(spark, path, schemas.POLY)
    bad = F.raise_error(F.concat(F.lit("frequency class "), F.coalesce("freq", F.lit("null")))).cast("string")
    return df.withColumn("freq", F.when(F.col("freq").isin("L", "H"), F.col("freq")).otherwise(bad))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Codes with their tags, as text and as numbers."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(fields[0].cast("short").alias("idx"), fields[1].alias("tag"), fields[1].try_cast("double").alias("p"))


def _ranges(path: str):
    """The bytes of pieces (chrom, lo, s, e) of a file; a task seeks to each."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        if path.startswith("file:"):
            system, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        else:
            system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as file:
            for batch in batches:
                for chrom, lo, s, e in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    yield pa.RecordBatch.from_arrays([pa.array([chrom]), pa.array([lo]), pa.array([s]), pa.array([file.read_at(e - s, s)], pa.binary())], ["chrom", "lo", "s", "bytes"])

    return run


def read_mono(spark: SparkSession, base: str, chunk: int = 1 << 22) -> DataFrame:
    """Monomorphic sites, one byte a position, as runs of equal codes; code 0 has none.

    The chromosomes' order gives offsets into the byte file, whose length must match.
    Tasks read pieces of ``chunk`` bytes by their offsets, so a file of any size is read
    in parallel. The file system must be one that pyarrow opens (local, hdfs, s3, gs).
    """
    chroms = _tsv(spark, f"{base}.chroms", schemas.LOCUS).collect()  # one row a chromosome
    pieces, at = [], 0
    for r in chroms:
        top = at + r.en - r.st
        pieces += [(r.chrom, at, s, min(s + chunk, top)) for s in range(at, top, chunk)]
        at = top
    file = spark.read.format("binaryFile").load(f"{base}.db").select("path", "length").first()
    if file.length != at:
        raise ValueError(f"{base}.db has {file.length} bytes; its chromosomes have {at}")
    parts = spark.createDataFrame(pieces, "chrom string, lo long, s long, e long").repartition(max(1, min(len(pieces), 4096)))
    return read_mono_chunks(parts.mapInArrow(_ranges(file.path), "chrom string, lo long, s long, bytes binary"))


def read_mono_chunks(parts: DataFrame) -> DataFrame:
    """Chunks (chrom, lo: the chromosome's offset, s: the chunk's, bytes) as runs."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for chrom, lo, s, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                codes = np.frombuffer(blob, np.uint8)
                if not len(codes):
                    continue
                start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                end, code = np.append(start[1:], len(codes)), codes[start]
                keep = code != 0
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chrom] * n), pa.array(start[keep] + (s - lo)), pa.array(end[keep] + (s - lo)), pa.array(code[keep].astype(np.int16))], ["chrom", "st", "en", "idx"]
                )

    from ..operators.intervals import coalesce_runs

    return coalesce_runs(parts.mapInArrow(run, schemas.MONO_RUN), "idx", region=1 << 22)


def read_weighted_bed(spark: SparkSession, path: str, max_weight: int = 1) -> DataFrame:
    """Intervals with weights; these count only if the largest weight is over one.

    A missing weight is 1; columns after the fourth are let go.
    """
    fields = F.split("value", "\t")
    at = lambda i, kind: F.try_element_at(fields, F.lit(i)).cast(kind)
    weight = F.coalesce(at(4, "int"), F.lit(1)) if max_weight > 1 else F.lit(1)
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(at(1, "string").alias("chrom"), at(2, "long").alias("st"), at(3, "long").alias("en"), weight.alias("weight"))


def read_covariate_runs(spark: SparkSession, path: str, layout, cell: str | None = None) -> DataFrame:
    """Runs of covariate tags as one-hot bits."""
    df = _tsv(spark, path, schemas.COVARIATE_RUN)
    df = df.select("chrom", "st", "en", layout.encode(F.col("tags")).alias("tagb"))
    return df.withColumn("cell", F.lit(cell)) if cell is not None else df


def uncovered(runs: DataFrame, genome: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Chromosomes (and cells) whose runs do not tile the genome: covered and due positions."""
    w = Window.partitionBy(*keys, "chrom").orderBy("st")
    seamless = F.coalesce(F.lag("en").over(w), F.lit(0)) == F.col("st")
    got = runs.withColumn("_ok", seamless).groupBy(*keys, "chrom").agg(F.sum(F.col("en") - F.col("st")).alias("covered"), F.min("_ok").alias("seamless"))
    due = genome.select("chrom", (F.col("en") - F.col("st")).alias("due"))
    return got.join(due, "chrom", "full").where("NOT coalesce(seamless, false) OR covered IS DISTINCT FROM due")


def reference_genome(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Chromosome extents: those of a file, or the hg19 autosomes."""
    if path:
        return _tsv(spark, path, schemas.LOCUS)
    return spark.createDataFrame([(c, 0, n) for c, n in schemas.HG19_AUTOSOMES.items()], schemas.LOCUS)


def parse_model_text(text: str) -> dict[str, dict[str, list[str]]]:
    """A result file: an upper-case line heads a section of ``key: values`` lines."""
    out: dict[str, dict[str, list[str]]] = {}
    section = ""
    for line in text.splitlines():
        key, colon, rest = line.strip().partition(":")
        if key and key == key.upper() and not rest.strip():
            section = key
        elif colon:
            out.setdefault(section, {})[key.strip()] = rest.split()
    return out


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Result files as (job, section, key, value)."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("job"), "value")
    lines = files.select("job", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    key, value = F.regexp_extract("line", r"^\s*([^:]*?)\s*(:|$)", 1), F.regexp_extract("line", r"^[^:]*:\s*(.*?)\s*$", 1)
    heading = F.when((key != "") & (value == "") & (F.upper(key) == key), key)
    w = Window.partitionBy("job").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.select("job", "n", key.alias("key"), value.alias("value"), heading.alias("heading"))
    placed = placed.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("")))
    return placed.where("heading IS NULL AND key <> ''").select("job", "section", "key", "value")


# The fields without which a result file is not whole.
REQUIRED = (
    ("PRIORN_MODEL", "Beta3"), ("PARAMETERS", "Rho"), ("PARAMETERS", "Eta"), ("PARAMETERS", "Gamma"), ("ARGS", "maxSampW"),
    ("STATS", "InPosW"), ("STATS", "InfPosWM"), ("STATS", "InfPosWH"), ("STATS", "InfPosWL"),
)


def whole_models(models: DataFrame) -> DataFrame:
    """The rows of ``read_models`` of jobs whose files have every required field, as a number of zero or more."""
    good = F.split("value", r"\s+")[0].try_cast("double") >= 0
    named = F.struct("section", "key").isin(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key")) for s, k in REQUIRED])
    whole = models.where(named & good).groupBy("job").agg(F.count_distinct("section", "key").alias("n")).where(F.col("n") == len(REQUIRED))
    return models.join(whole.select("job"), "job", "left_semi")


def parse_block_header(line):
    """Columns of an interchange file's block line: ``block chrom:st-en theta x lambda y``."""
    pattern = r"^block\s+(\S+):(\d+)-(\d+)\s+theta\s+(\S+)\s+lambda\s+(\S+)"
    get = lambda i, kind: F.regexp_extract(line, pattern, i).try_cast(kind)
    return [get(1, "string").alias("chrom"), get(2, "long").alias("st"), get(3, "long").alias("en"), get(4, "float").alias("theta"), get(5, "float").alias("lambda")]


def as_table(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet by chromosome, in order of position, and read from there: the engine's cache format."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, "chrom", "st").sortWithinPartitions("chrom", "st", "en").write.mode("overwrite").partitionBy("chrom").parquet(path)
    return df.sparkSession.read.parquet(path)
