"""Operator 9: removal of lines that spread over sites, DataFrame functions only.

Lines are texts cut at newlines; a site is a value of ``source`` (null is a site of
its own). HyperLogLog sketches of sites, one per line hash, are made from the
occurrences and merge by aggregation. Lines whose estimate is well over ``min_sites``
are boilerplate, those well under it are not, and only for those in between the
distinct sites are counted exactly. Of a boilerplate line its first occurrence stays
(least doc_id, then place), all others go, so no content leaves the corpus altogether.

Lines are known by two 64-bit hashes of different seeds, 128 bits in all: at 10^12 lines
the chance of any wrong merge is below 10^-14. A text is known by doc_id and a hash.

A line is on as many sites as it has occurrences at most, so occurrences of lines with
fewer than ``min_sites`` are let go before sketching, which changes no result. Where
occurrences meet a line, both sides are dealt over SALTS keys a line, so a line
that a third of all documents has does not meet in one task.

Defined cases: lines that are blank are never removed; a null text stays null; rows
with equal doc_id and text are one document for the choice of the first occurrence
and are treated alike; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SITES = 3
#: Sketch size (2^LG_K registers) and the band, as shares of min_sites, within which
#: an estimate is checked. The sketch is exact up to some dozen sites and off by two
#: to three percent above, so the band is many standard errors wide.
LG_K, BAND = 11, 0.5
SALTS = 16


def _hash(x: Column) -> Column:
    """128 bits: the second hash starts from the first's of a constant."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))


def lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: doc_id, content (hash of the text), site, place, line (hash), salt."""
    hashed = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0, _hash(x)))
    site = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    # The text's hash is taken before its lines part, once a text.
    whole = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("content"), site.alias("site"), hashed.alias("hashed"))
    rows = whole.select("doc_id", "content", "site", F.posexplode("hashed").alias("place", "line"))
    salt = F.pmod(F.xxhash64("doc_id", "content", "place"), F.lit(SALTS)).cast("int")
    return rows.where("line IS NOT NULL").withColumn("salt", salt)


def _salted(lines: DataFrame) -> DataFrame:
    """``lines`` once for every salt."""
    return lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def frequent(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Occurrences of lines that have at least ``min_sites`` of them."""
    often = found.groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    return found.join(_salted(often), ["line", "salt"])


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` sites, with their first occurrence."""
    first = F.min(F.struct("doc_id", "content", "place")).alias("first")
    sketches = found.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), first)
    often = sketches.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    often = materialize(often.where(F.col("sites") >= min_sites * (1 - BAND)), "sketched")
    sure = often.where(F.col("sites") > min_sites * (1 + BAND))
    near = often.where(F.col("sites") <= min_sites * (1 + BAND))
    met = found.select("line", "salt", "site").join(_salted(near.select("line")), ["line", "salt"]).select("line", "site").distinct()
    exact = met.groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    return sure.select("line", "first").unionByName(near.join(exact, "line").select("line", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cleaned text and n_lines, n_removed; all other columns stay."""
    found = materialize(frequent(materialize(lines(docs), "lines"), min_sites), "frequent")
    spread = materialize(boilerplate(found, min_sites), "boilerplate")
    hits = found.join(_salted(spread), ["line", "salt"]).where(~F.struct("doc_id", "content", "place").eqNullSafe(F.col("first")))
    removed = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("content").alias("_content")).agg(F.collect_set("place").alias("_places"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    # A text goes through the join as its lines, so they are not cut again for each that stays.
    cut = docs.select(*others, F.split("text", "\n").alias("_lines"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_text"))
    joined = cut.join(removed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_content")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    kept = F.when(F.col("_places").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda i: F.get("_lines", i)))
    return joined.select(
        *others,
        F.array_join(kept, "\n").alias("text"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).cast("long").alias("n_removed"),
    )


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
