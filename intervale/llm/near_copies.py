"""Near copies on five-word shingles for the pipeline: SimHash first, then the chosen-path join.

Operator 7's vantage-point search over fingerprints of five-word shingles gives the first
candidates: texts of one fingerprint, and fingerprints within two bits. They are held
against the full sets, and what is confirmed is one class from then on. Most pairs of
similarity 0.8 lie more bits apart than any shell divides a corpus at, so the chosen-path
join of operator 12 finds those that are left, at the same threshold and with the same
confirmation. So no link below 0.8 is made, and a pair at 0.8 is missed with a chance of
1 - RECALL at most.

Defined cases: words are lower-cased in ASCII and cut at ASCII white space; a text of
fewer words is one shingle; texts without words (null, empty) are copies of each other;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .chosen_path import RECALL, SHINGLE, Join, content
from .common import materialize

__all__ = ["LEAST", "content", "near_copies"]

#: The least similarity as a fraction, which keeps comparisons exact.
LEAST = (4, 5)


def fingerprint_pairs(docs: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints operator 7 links, as a forest.

    Sets of one fingerprint pair with the least of them, and these as the search links them.
    """
    marks = simhash.fingerprints(docs.select(content().alias("doc_id"), "text"), size=SHINGLE).select(F.col("doc_id").alias("content"), "fp")
    names = join.marked.groupBy("name").agg(F.min("content").alias("content")).join(join.sets.select("key", "name"), "name")
    keyed = materialize(names.join(marks.groupBy("content").agg(F.min("fp").alias("fp")), "content").select("key", "fp"), "keyed")
    first = materialize(keyed.groupBy("fp").agg(F.min("key").alias("first")), "firsts")
    same = keyed.join(first, "fp").where("key <> first").select(F.col("key").alias("x"), F.col("first").alias("y"))
    found = simhash.link_fingerprints(first.select("fp"))
    for side, name in (("a", "x"), ("b", "y")):
        found = found.join(first.select(F.col("fp").alias(side), F.col("first").alias(name)), side)
    both = same.unionByName(found.select("x", "y"))
    return materialize(both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "fingerprint_pairs")


def near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, content, root): rows of one root are copies."""
    join = Join(docs, LEAST, RECALL)
    join.add(fingerprint_pairs(docs, join))
    return join.classes().select("doc_id", "content", "root")
