"""Connected components of a link table, by alternating large and small stars.

Every round is a pair of shuffles over links; nothing but the number of changed
links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool, tasks: int | None = None) -> DataFrame:
    """Tie neighbours of a node to the least node among it and them, in ``tasks`` tasks if given."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        made = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    made = made.where("a <> b")
    return made.coalesce(tasks).distinct().coalesce(tasks) if tasks else made.distinct()


def connected(links: DataFrame, rounds: int = 60, task_rows: int | None = None) -> DataFrame:
    """``links`` (a, b) as (node, root): the least node reachable; linked nodes only.

    With ``task_rows`` a step runs in as many tasks as that many links each need, which
    saves the start of tasks where links are few.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = links.agg(F.count("*"), mark).first()
    for _ in range(rounds):
        if not before[0]:
            break
        tasks = -(-before[0] // task_rows) if task_rows else None
        links = materialize(_star(_star(links, True, tasks), False, tasks), "links")
        after = links.agg(F.count("*"), mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
