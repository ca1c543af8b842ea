"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns the columns of ``documents``, but for the last, which returns ids and text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale import ship
from intervale.llm import bpe, line_dedup, mixing, near_copies, toxicity
from intervale.llm.common import materialize, shared_path, table
from intervale.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources stay once; ``n_chars`` follows the text."""
    cleaned = line_dedup.dedup_lines(docs).drop("n_lines", "n_removed")
    kept = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Groups are what pairs with a five-word Jaccard similarity of 0.8 or more connect; SimHash
    fingerprints give the first candidates, the chosen-path join the others. Texts
    that share a doc_id but no group stay both; of equal ids in a group, the least text hash
    and then the least row. Rows without a doc_id cannot be named and stay.
    """
    named = near_copies.near_copies(docs).where("doc_id IS NOT NULL")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", F.col("content").alias("_content"))).alias("first")).select("first.*").distinct()
    held = docs.withColumn("_content", near_copies.content()).join(first, ["doc_id", "_content"], "left_semi")
    kept = held.groupBy("doc_id", "_content").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents, in the order of the schedule's slots.

    A document comes as often as the mix takes half of it or more: not at all, once or
    twice. Rows that share doc_id, source and text are taken alike, as often as the most
    taken of them.
    """
    _, _, stream = mixing.mixed(docs)
    chosen = mixing.whole_documents(stream).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "content", "slot", "at")])
    same = docs.doc_id.eqNullSafe(F.col("_doc_id")) & docs.source.eqNullSafe(F.col("_source")) & (mixing.content() == F.col("_content"))
    return docs.join(chosen, same).orderBy("_slot", "_at").select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``, the row's number in the order of its files and rows.

    Files come by the number that their writer gave them. Rows that do not come straight
    from Parquet files are stored, and numbered in the order of their partitions.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return materialize(docs.withColumn("place", F.monotonically_increasing_id()), "placed")
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = rows.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_number", number)
    up = Window.orderBy("_number", "_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = materialize(files.select("_file", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before")), "files")
    return rows.join(before, "_file").withColumn("place", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests, in the order of the rows, which ``place`` numbers."""
    rows = placed(docs).select("place", "doc_id", "text")
    made = bpe.digests(bpe.encode_decode(rows.select(F.col("place").alias("doc_id"), "text"), tokenizer_path("word_bpe_49k.json")))
    made = made.withColumnRenamed("doc_id", "place").join(rows.select("place", "doc_id"), "place")
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "place").orderBy("place")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Hash families, learned scores and a BPE vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
