"""Sums over overlapping pairs, without the pairs."""

import datetime as dt
import random
from collections import Counter

import pytest
from intervale.operators import intervals
from intervale.plans.queries import queries

LEFT, RIGHT = "chrom string, st long, en long, weight int", "chrom string, st long, en long, block_id long"


def test_sums_equal_the_pairs(spark):
    rng = random.Random(5)
    made = lambda n, longest, last: [(rng.choice("ab"), s := rng.randrange(-90, 400), s + int(longest ** rng.random()) - rng.randrange(2), last()) for _ in range(n)]
    left = made(150, 300, lambda: rng.choice([None, 0, 1, 7])) + [("a", None, 5, 1), ("a", 5, None, 1), (None, 0, 9, 1), ("a", 4, 4, 9), ("a", 9, 3, 9), ("n", 10, 20, None), ("l", 1, 2, 3)]
    right = made(120, 90, lambda: rng.randrange(60)) + [("a", 0, 9, None), (None, 0, 9, 1), ("a", None, 9, 2), ("a", 4, 4, 3), ("n", 0, 99, 70), ("n", 15, 16, 71), ("z", 0, 9, 72), ("b", 500, 600, 73)]
    right += right[:9]
    want = []
    for c, s, e, i in right:
        met = [(min(e, le) - max(s, ls), w) for lc, ls, le, w in left if None not in (c, s, e, ls, le) and c == lc and ls < le and s < e and ls < e and s < le]
        held = [x * w for x, w in met if w is not None]
        if met:
            want.append((c, s, e, i, len(met), sum(x for x, _ in met), sum(held) if held else None))
    assert any(x[-1] is None for x in want) and len(want) > 100
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for region in (1, 16, 1 << 16):
        got = intervals.overlap_sums(a, b, region=region)
        assert got.dtypes == [("chrom", "string"), ("st", "bigint"), ("en", "bigint"), ("block_id", "bigint"), ("n", "bigint"), ("shared", "bigint"), ("weighted", "bigint")]
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert intervals.overlap_sums(a.limit(0), b).count() == intervals.overlap_sums(a, b.limit(0)).count() == 0


def most_rows(plan):
    """The most rows that a node of an executed plan gave."""
    held = plan.metrics().get("numOutputRows")
    below, own = plan.children(), held.get().value() if held.isDefined() else 0
    return max([own, *[most_rows(below.apply(i)) for i in range(below.size())]])


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """3,000 line items and 3,000 orders of one chromosome; most overlap, years or a day long."""
    path, day = str(tmp_path_factory.mktemp("crowded")), dt.datetime(1995, 3, 1)
    items = [(100 * i, 10 * i, 1 + i % 7, float(1 + i % 50), day + dt.timedelta(i % 2)) for i in range(3000)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(700 * i, day + dt.timedelta(1)) for i in range(3000)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["mixed_lengths", "overlap_join"])
def test_no_node_makes_pairs(spark, crowded, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = queries()[name](spark, crowded)
        rows = df.collect()
        assert len(rows) == 3000 and sum(r.n for r in rows) > 7_000_000
        assert most_rows(df._jdf.queryExecution().executedPlan()) <= 4 * 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ends_are_added_up_once(spark):
    """One scan of the left side and one aggregate of its ends serve the sums and those of the regions."""
    a, b = spark.createDataFrame([("a", 0, 9, 1)], LEFT), spark.createDataFrame([("a", 3, 4, 1)], RIGHT)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = intervals.overlap_sums(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan
