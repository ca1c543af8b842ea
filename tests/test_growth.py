"""Splits from single values, the log of growth, and the tree of bins."""

import random

import pytest
from intervale.operators import covset as cov
from intervale.operators import intervals as iv
from intervale.operators.covset import Layout, Subset
from intervale.plans import tree
from intervale.plans.growth_log import GrowthLog
from pyspark.sql import functions as F

from .test_tree_and_io import TRUTH, planted, tiny  # noqa: F401


def test_split_sums_equal_counts_by_target(spark, tiny):  # noqa: F811
    rng = random.Random(4)
    ann, cts = Layout.of(tiny.of(False)), Layout.of(tiny.of(True))
    aligned = [("c", at, at + 10, ann.bits("splice", [rng.randrange(3)]), f"e{k}", cts.bits("rna", [rng.randrange(4)]) | cts.bits("kind", [rng.randrange(3)])) for at in range(0, 2000, 10) for k in range(3)]
    sites = [("c", at, at + rng.randrange(1, 30), rng.choice("MLH"), rng.randrange(3) / 2, 0.0, 0.01, 0.001) for at in range(0, 2000, 7)]
    a = spark.createDataFrame(aligned, "chrom string, st long, en long, ann long, cell string, tagb long")
    s = spark.createDataFrame(sites, "chrom string, st long, en long, cls string, x_maj double, x_min double, lambda double, theta double")
    nodes = {"0h": Subset().with_values("rna", [1, 3]), "0l": Subset().with_values("rna", [2])}
    orders = {("0h", "rna"): [3, 1], ("0h", "splice"): [1, 2], ("0l", "kind"): [2, 1], ("0l", "splice"): [1, 2]}
    values = tree.value_patterns(a, cov.target_table(spark, nodes, ann, cts), tiny, s)
    subsets = {}
    for (n, c), order in orders.items():
        for cut in range(1, len(order)):
            for side, own in (("s", order[:cut]), ("c", order[cut:])):
                subsets[f"{n}/{c}/{cut}/{side}"] = nodes[n].with_values(c, own)
    want = tree.subset_sites(a, cov.target_table(spark, subsets, ann, cts), s)
    key = lambda df: sorted(tuple(r[c] for c in ("subset_id", *tree.PATTERN, "n")) for r in df.collect())
    assert key(tree.split_patterns(spark, values, orders)) == key(want) != []


def test_growth_survives_a_crash(spark, tiny, tmp_path, monkeypatch):  # noqa: F811
    aligned, sites = planted(spark, tiny)
    options = tree.Options(min_gain=-1e9, max_depth=3)  # every node splits
    want = {n.node_id: (n.status, n.subset.template(tiny)) for n in tree.grow(spark, tiny, aligned, sites, TRUTH, options)}
    log = GrowthLog(spark, f"file://{tmp_path}/log")
    fitted, calls = tree.fit_subsets, []

    def dies(patterns, starts, scale=1.0):
        calls.append(len(starts))
        if len(calls) == 6:  # the root has one call, each level two
            raise RuntimeError("lost")
        return fitted(patterns, starts, scale)

    monkeypatch.setattr(tree, "fit_subsets", dies)
    with pytest.raises(RuntimeError, match="lost"):
        tree.grow(spark, tiny, aligned, sites, TRUTH, options, log=log)
    assert log.levels() == [0, 1, 2]
    assert {r.status for r in log.replay().collect()} >= {"split", "pending"}
    log.stage(3, nodes=log.read("nodes").drop("level").withColumn("status", F.lit("half written")))
    assert log.replay().where("status = 'half written'").count() == 0
    monkeypatch.setattr(tree, "fit_subsets", fitted)
    nodes = tree.grow(spark, tiny, aligned, sites, TRUTH, options, log=log)
    assert {n.node_id: (n.status, n.subset.template(tiny)) for n in nodes} == want
    assert log.levels() == [0, 1, 2, 3] and log.replay().where("status = 'pending'").count() == 0
    assert log.read("partitions").select("level").distinct().count() == 3
    assert {n.node_id for n in tree.grow(spark, tiny, aligned, sites, TRUTH, options, log=log)} == set(want)  # nothing is open


def test_growth_from_a_subset(spark, tiny):  # noqa: F811
    aligned, sites = planted(spark, tiny)
    first = Subset.parse("ANN:*:CTS:{rna;2,3}", tiny)
    nodes = tree.grow(spark, tiny, aligned, sites, TRUTH, tree.Options(min_gain=25.0), first=first)
    assert [(n.status, n.subset.allowed["rna"]) for n in nodes] == [("leaf", (2, 3))]
    assert abs(nodes[0].params.rho - 0.7) < 0.1


def mixed(rng, n, longest):
    return [(rng.choice("ab"), st, st + int(longest ** rng.random()) + rng.randrange(-1, 2), i) for i in range(n) for st in [rng.randrange(-1000, 200_000)]]


@pytest.mark.parametrize("longest", [(1, 1), (3, 150_000), (150_000, 3), (70_000, 70_000)])
def test_bins_of_all_widths(spark, longest):
    rng = random.Random(sum(longest))
    left, right = mixed(rng, 300, longest[0]), mixed(rng, 400, longest[1])
    left += [("a", None, 5, 900), ("a", 64, 64, 901), ("a", 64, 128, 902), ("a", 64, 128, 902)]
    right += [("a", 64, 128, 900), ("a", 63, 65, 901), ("zz", 0, 10**9, 902), ("a", 0, 10**9, 903)]
    a, b = (spark.createDataFrame(rows, f"chrom string, st long, en long, {n} long") for rows, n in ((left, "x"), (right, "y")))
    want = sorted((lx, ry, max(ls, rs), min(le, re)) for lc, ls, le, lx in left for rc, rs, re, ry in right if ls is not None and lc == rc and ls < re and rs < le and ls < le and rs < re)
    got = iv.overlap_join(a, b)
    assert sorted((r.x, r.y, r.st, r.en) for r in got.collect()) == want
    hit = {x for x, *_ in want}
    assert sorted((r.x, r.hit) for r in iv.overlap_flags(a, b).collect()) == sorted((x, x in hit) for *_, x in left)


def test_long_intervals_are_not_cut_up(spark):
    """Rows that take part in the join are bounded by the levels of both sides."""
    rows = [("a", 0, 250_000_000, 1), ("a", 5, 100_000_000, 2)] + [("a", 10 * i, 10 * i + 1, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "chrom string, st long, en long, x long")
    levels = iv.levels_of(df)
    assert len(levels) == 2 or len(levels) == 3
    for left in (True, False):
        placed = df.select(F.size(iv.placed_bins(levels, levels, left)).alias("n"))
        assert placed.agg(F.max("n")).first()[0] <= 2 * (len(levels) + 1)
