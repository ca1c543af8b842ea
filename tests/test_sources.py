"""The byte file's data source and clustered tables."""

import random

import pytest
from intervale.operators import intervals as iv
from intervale.sources import byte_file, clustered, readers
from pyspark.sql import functions as F


def runs_by_hand(codes, lo, hi, chunk):
    """Runs of equal codes other than 0, cut at chunk borders."""
    out = []
    for s in range(lo, hi, chunk):
        e, at = min(s + chunk, hi), s
        while at < e:
            to = at
            while to < e and codes[to] == codes[at]:
                to += 1
            if codes[at]:
                out.append((at - lo, to - lo, codes[at]))
            at = to
    return out


@pytest.fixture()
def bytes_on_disk(tmp_path):
    rng = random.Random(7)
    codes = bytes(c for _ in range(150) for c in [rng.choice([0, 1, 1, 2, 3])] * rng.randrange(1, 9))
    first = 300
    (tmp_path / "m.db").write_bytes(codes)
    (tmp_path / "m.chroms").write_text(f"chr2\t0\t{first}\nchr1\t0\t{len(codes) - first}\n")
    return str(tmp_path / "m"), codes, first


def test_byte_file_reads_only_its_chunks(spark, bytes_on_disk):
    base, codes, first = bytes_on_disk
    df = byte_file.read_byte_file(spark, base, chunk=64)
    want = [("chr2", *r) for r in runs_by_hand(codes, 0, first, 64)] + [("chr1", *r) for r in runs_by_hand(codes, first, len(codes), 64)]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    whole = df.rdd.getNumPartitions()
    tests = [("chrom = 'chr1'", lambda c, s, e: c == "chr1"), ("chrom = 'chr2' AND st < 70 AND en > 60", lambda c, s, e: c == "chr2" and s < 70 and e > 60), ("st <= 64", lambda c, s, e: s <= 64)]
    tests += [("en >= 128 AND chrom IN ('chr2', 'chr7')", lambda c, s, e: e >= 128 and c == "chr2"), ("st >= 130 AND en < 200", lambda c, s, e: s >= 130 and e < 200), ("st > 63 AND en <= 65", lambda c, s, e: s > 63 and e <= 65), ("chrom = 'chr9'", lambda *r: False)]
    for text, keeps in tests:
        part = byte_file.read_byte_file(spark, base, chunk=64).where(text)
        assert sorted(map(tuple, part.collect())) == sorted(r for r in want if keeps(*r[:3])), text
        assert part.rdd.getNumPartitions() < whole, text
    assert byte_file.read_byte_file(spark, base, chunk=64).where("chrom = 'chr2' AND st < 70 AND en > 60").rdd.getNumPartitions() == 2
    glued = sorted(map(tuple, iv.coalesce_runs(df, "idx", region=100).select("chrom", "st", "en", "idx").collect()))
    assert glued == sorted(map(tuple, readers.read_mono(spark, base, chunk=50).select("chrom", "st", "en", "idx").collect()))


def test_byte_file_is_written_in_parts(spark, tmp_path, bytes_on_disk):
    _, codes, _ = bytes_on_disk
    pieces = [(c, k, codes[k * 40 : (k + 1) * 40]) for c in ("x", "y") for k in range(5)]
    random.Random(1).shuffle(pieces)
    df = spark.createDataFrame([(c, k, bytearray(b)) for c, k, b in pieces], "chrom string, number long, bytes binary")
    base = f"file://{tmp_path}/made"
    assert byte_file.write_byte_file(df, base, ["y", "x"]) == 400
    got = sorted(map(tuple, byte_file.read_byte_file(spark, base, chunk=1000).collect()))
    assert got == sorted((c, *r) for c in "xy" for r in runs_by_hand(codes, 0, 200, 1000))
    assert (tmp_path / "made.chroms").read_text() == "y\t0\t200\nx\t0\t200\n"
    (tmp_path / "made.chroms").write_text("y\t0\t200\nx\t0\t201\n")
    with pytest.raises(Exception, match="400 bytes"):
        byte_file.read_byte_file(spark, base).collect()


def scanned(df):
    """Rows that the scan of a collected DataFrame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_small_loci_scan_few_row_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{i % 5}", st, st + rng.randrange(1, 500), i) for i in range(20_000) for st in [rng.randrange(100_000_000)]]
    path = str(tmp_path / "table")
    clustered.write_clustered(spark.createDataFrame(rows, "chrom string, st long, en long, x long"), path, files=40)
    loci = [("c1", 500, 2000, 1), ("c1", 50_000_000, 50_001_000, 1), ("c3", 9_000_000, 9_400_000, 1), ("c3", 7, 7, 1)]
    few = spark.createDataFrame(loci, "chrom string, st long, en long, weight int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = clustered.under(spark.read.parquet(path), few)
        held = {r.x for r in df.collect()}
        assert scanned(df) < 0.25 * len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    met = {x for c, s, e, x in rows for lc, ls, le, _ in loci if c == lc and s < le and ls < e and ls < le}
    assert met <= held and len(met) > 10
    assert sorted(iv.overlap_join(df, few).select("x").distinct().toPandas().x) == sorted(met)


def test_stretches(spark):
    df = spark.createDataFrame([("a", i << 22, (i << 22) + 10) for i in range(30)] + [("b", 5, 9)], "chrom string, st long, en long")
    assert len(clustered.stretches(df)) == 31
    assert clustered.stretches(df, 10) == [("a", 0, (29 << 22) + 10), ("b", 5, 9)]
    assert clustered.stretches(df, 1) is None and df.where(clustered.within(None)).count() == 31
    assert clustered.stretches(df.limit(0)) == [] and df.where(clustered.within([])).count() == 0
    assert df.where(clustered.within([("b", 8, 9)])).select(F.max("en")).first()[0] == 9
