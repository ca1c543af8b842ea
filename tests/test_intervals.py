"""Interval operators against positions counted one by one."""

import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as h
from intervale.operators import intervals, patterns
from pyspark.sql import functions as F

SPEC = "chrom string, st long, en long, v long"


def some(seed, n, top=300, longest=40):
    rng = random.Random(seed)
    return [(rng.choice("ab"), s := rng.randrange(top), s + rng.randrange(0, longest), rng.randrange(4)) for _ in range(n)]


def test_overlap_join(spark):
    a, b = some(1, 120), some(2, 90, longest=7) + [("c", 0, 10, 1), ("a", 5, 5, 0), ("a", None, 3, 1)]
    left, right = spark.createDataFrame(a, SPEC), spark.createDataFrame(b, SPEC)
    want = Counter((x[0], x[1], x[2], y[1], y[2], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if None not in y and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
    for width in (4, 64, 100_000):
        got = intervals.overlap_join(left, right, width)
        assert Counter((r.chrom, r.l_st, r.l_en, r.r_st, r.r_en, r.st, r.en) for r in got.collect()) == want
    hit = {k[:3] for k in want}
    semi = intervals.overlap_join(left, right, 16, "left_semi").collect()
    anti = intervals.overlap_join(left, right, 16, "left_anti").collect()
    assert Counter(map(tuple, semi)) == Counter(x for x in a if x[:3] in hit) and len(semi) + len(anti) == len(a)


def test_overlap_join_is_an_equi_join(spark):
    df = spark.createDataFrame(some(1, 5), SPEC)
    plan = intervals.overlap_join(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "_bin" in plan


def test_locate_and_positions(spark):
    blocks = spark.createDataFrame([("a", 0, 10, 1), ("a", 10, 25, 2), ("b", 3, 4, 3)], SPEC)
    points = spark.createDataFrame([("a", 9), ("a", 10), ("a", 25), ("b", 3), ("c", 1)], "chrom string, pos long")
    assert sorted((r.chrom, r.pos, r.v) for r in intervals.locate(points, blocks, width=8).collect()) == [("a", 9, 1), ("a", 10, 2), ("b", 3, 3)]
    assert intervals.positions(blocks).count() == 26


def test_clip_advance_compare(spark):
    df = spark.createDataFrame([("a", 2, 9, 0)], SPEC).withColumn("lo", F.lit(4)).withColumn("hi", F.lit(30))
    assert tuple(intervals.clip(df, "lo", "hi").select("st", "en").first()) == (4, 9)
    assert tuple(intervals.advance(df, "hi").select("st", "en").first()) == (9, 9)
    pair = df.alias("a").join(spark.createDataFrame([("a", 9, 12, 1), ("a", 8, 9, 2), ("b", 0, 1, 3), ("a", 0, 2, 4)], SPEC).alias("b"))
    assert {r[0]: r[1] for r in pair.select("b.v", intervals.compare("a", "b")).collect()} == {1: -1, 2: 0, 3: -1, 4: 1}


def depth_runs(rows):
    return [(c, p, p + 1, v) for c, p, v in rows]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(h.dictionaries(h.tuples(h.sampled_from("ab"), h.integers(0, 60)), h.integers(0, 2), max_size=60), h.sampled_from([None, 7, 32]))
def test_coalesce_runs(spark, states, region):
    rows = depth_runs([(c, p, v) for (c, p), v in states.items()])
    df = spark.createDataFrame(rows, SPEC)
    got = sorted((r.chrom, r.st, r.en, r.v) for r in intervals.coalesce_runs(df, "v", region=region).collect())
    assert {(c, p): v for c, s, e, v in got for p in range(s, e)} == {k: v for k, v in states.items() if v}
    assert not any(a[0] == b[0] and a[2] == b[1] and a[3] == b[3] for a, b in zip(got, got[1:]))
    again = intervals.coalesce_runs(spark.createDataFrame(got, SPEC), "v", region=region)
    assert sorted((r.chrom, r.st, r.en, r.v) for r in again.collect()) == got


def tiled(rng, top, values):
    cuts = sorted({0, top, *(rng.randrange(top) for _ in range(6))})
    return [("c", s, e, rng.choice(values)) for s, e in zip(cuts, cuts[1:])]


def test_alignment(spark):
    rng = random.Random(3)
    ann, cells = tiled(rng, 100, [1, 2]), {f"k{i}": tiled(rng, 100, [1, 2, 4]) for i in range(3)}
    a = spark.createDataFrame(ann, "chrom string, st long, en long, tagb long")
    c = spark.createDataFrame([(*r, k) for k, v in cells.items() for r in v], "chrom string, st long, en long, tagb long, cell string")
    at = lambda runs, p: next(r[3] for r in runs if r[1] <= p < r[2])
    for region in (1000, 16):
        got = intervals.align(a, c, region).collect()
        seen = {(p, r.cell): (r.ann, r.tagb) for r in got for p in range(r.st, r.en)}
        assert seen == {(p, k): (at(ann, p), at(v, p)) for p in range(100) for k, v in cells.items()}
        assert sum(r.en - r.st for r in got) == 300


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flags_keep_equal_rows(spark):
    left = [("a", 0, 5, 1), ("a", 0, 5, 1), ("a", 5, 9, None), ("a", 3, 3, 0), (None, 1, 2, 3), ("a", None, 4, 0)]
    right = spark.createDataFrame([("a", 4, 5, 0), ("a", 1, 2, 0), ("b", 0, 99, 0)], SPEC)
    got = intervals.overlap_flags(spark.createDataFrame(left, SPEC), right, 2)
    assert plan_of(got).count("Scan ExistingRDD") == 2
    assert Counter(map(tuple, got.collect())) == Counter((*r, r[:3] == ("a", 0, 5)) for r in left)


def test_states_and_segments_by_region(spark):
    """Regions change no result, and no window holds all positions of a key."""
    rng = random.Random(11)
    runs = sorted({(rng.choice("ab"), rng.randrange(-40, 400)): rng.choice([None, 1, 2, 3]) for _ in range(60)}.items())
    runs = spark.createDataFrame([(k, st, v) for (k, st), v in runs], "chrom string, st long, v long")
    points = spark.createDataFrame([(i, rng.choice("abc"), rng.randrange(-60, 420)) for i in range(150)], "i long, chrom string, st long")
    want = sorted((r.i, r.v) for r in intervals.asof_state(points, runs, "v", ["chrom"]).collect())
    bounds = runs.select("chrom", "st", (F.col("st") + 7).alias("en"))
    segments = sorted(map(tuple, intervals.breakpoint_segments(bounds).select("chrom", "st", "en").collect()))
    for region in (1, 16, 1000):
        assert sorted((r.i, r.v) for r in intervals.asof_state(points, runs, "v", ["chrom"], region=region).collect()) == want
        assert sorted(map(tuple, intervals.breakpoint_segments(bounds, region=region).select("chrom", "st", "en").collect())) == segments


def test_coalescing_orders_only_borders_over_regions(spark):
    df = spark.createDataFrame([("a", p, p + 1, p // 3 % 2 + 1) for p in range(300)], SPEC)
    inner = intervals._islands(df.withColumn("_region", F.expr("st div 50")), "v", ["chrom", "_region"])
    got = intervals.coalesce_runs(df, "v", region=50)
    assert inner.count() > got.count() == 100
    windows = [line for line in plan_of(got).splitlines() if "+- Window" in line or ":- Window" in line]
    assert windows and sum("_region" not in line.split("], [")[1] for line in windows) <= 2  # only the glue leaves regions


def test_from_linear_is_an_equi_join(spark):
    genome = spark.createDataFrame([("chr1", 0, 30), ("chr2", 0, 50)], "chrom string, st long, en long")
    df = spark.createDataFrame([(i,) for i in range(90)], "linear long")
    for width in (7, 1 << 24):
        got = intervals.from_linear(df, genome, width)
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
        assert sorted((r.linear, r.chrom, r.st) for r in got.collect()) == [(i, "chr1" if i < 30 else "chr2", i if i < 30 else i - 30) for i in range(80)]


def test_linear_positions(spark):
    genome = spark.createDataFrame([("chr2", 0, 50), ("chr10", 0, 70), ("chr1", 0, 30)], "chrom string, st long, en long")
    df = spark.createDataFrame([("chr10", 5), ("chr2", 5), ("chr1", 5)], "chrom string, st long")
    there = intervals.linear_positions(df, genome)
    assert {r.chrom: r.linear for r in there.collect()} == {"chr1": 5, "chr10": 35, "chr2": 105}
    assert {(r.chrom, r.st) for r in intervals.from_linear(there.select("linear"), genome).collect()} == {("chr1", 5), ("chr10", 5), ("chr2", 5)}


def test_patterns(spark):
    df = spark.createDataFrame([(1, "M", 3, None, 2, 5), (1, "M", 3, None, 1, 4), (1, "L", 3, 4, 2, 1), (2, "H", 5, 6, 0, 1)], "block_id int, cls string, maj_idx int, min_idx int, weight int, len int")
    counts = patterns.pattern_counts(df)
    assert {(r.block_id, r.cls): r.n for r in counts.collect()} == {(1, "M"): 14, (1, "L"): 2, (2, "H"): 0}
    assert patterns.expand_patterns(counts).count() == 16
    assert patterns.site_counters(df).first().asDict() == {"m_raw": 9, "m_weighted": 14, "l_raw": 1, "l_weighted": 2, "h_raw": 1, "h_weighted": 0}
    x = df.withColumn("p_maj", F.lit(0.5)).withColumn("p_min", F.lit(0.25))
    assert sum(r.maj + r.min + r.oth for r in patterns.block_normalised_matrix(x).collect()) == 2.0
    assert {r.cls: r.maj for r in patterns.class_matrix(x).collect()} == {"M": 1.0, "L": 0.5, "H": 0.5}
