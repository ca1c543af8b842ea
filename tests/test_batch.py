"""Many interval sets fitted at once, and the service over them."""

import random

import numpy as np
import pytest
from intervale.plans import engine as en
from intervale.plans.batch import fit_batch
from intervale.streaming.jobs import fit_arrivals
from pyspark.sql import functions as F

from .test_tree_and_io import database, write  # noqa: F401


def sets(n):
    rng = random.Random(6)
    out = []
    for k in range(n):
        for _ in range(3):
            c, top = rng.choice((("chr1", 200), ("chr2", 150)))
            st = rng.randrange(top - 5)
            out.append((f"job{k}", c, st, min(top, st + rng.randrange(1, 90)), rng.randrange(1, 4)))
    return out + [("empty", "chr9", 0, 5, 1)]


@pytest.mark.parametrize("weight", [1.0, 3.0])
def test_a_batch_equals_single_fits(spark, database, weight):  # noqa: F811
    e, rows = en.Engine(database[0]), sets(3)
    config = en.Config(max_weight=weight)
    loci = spark.createDataFrame(rows, "job string, chrom string, st long, en long, weight int")
    got = fit_batch(e, loci, config)
    assert set(got) == {r[0] for r in rows}
    for job in ("job0", "job2", "empty"):
        one = e.fit(loci.where(F.col("job") == job).drop("job"), config)
        fit, stats = got[job]
        for name in ("rho", "eta", "gamma", "lam", "theta", "beta1", "beta2", "beta3"):
            assert getattr(fit.params, name) == pytest.approx(getattr(one.fit.params, name), abs=2e-5), (job, name)
        assert fit.nll == pytest.approx(one.fit.nll, abs=1e-3) and fit.nll_prior == pytest.approx(one.fit.nll_prior, abs=1e-3)
        assert {k: v or 0 for k, v in stats.items()} == {k: v or 0 for k, v in one.stats.items()}
        assert np.allclose(fit.hessian, one.fit.hessian, rtol=1e-2, atol=1.0)


def jobs_run(spark, run):
    """Spark jobs that ``run`` starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "", False)
    try:
        run()
        return len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_sets(spark, database):  # noqa: F811
    e = en.Engine(database[0])
    spec = "job string, chrom string, st long, en long, weight int"
    few, many = (jobs_run(spark, lambda n=n: fit_batch(e, spark.createDataFrame(sets(n), spec))) for n in (2, 25))
    assert 0 < many <= few + 8


def test_jobs_by_run(spark, database):  # noqa: F811
    """As above, each run under a job group of its own."""
    e, sc, counts = en.Engine(database[0]), spark.sparkContext, []
    for n in (2, 25):
        loci = spark.createDataFrame(sets(n), "job string, chrom string, st long, en long, weight int")
        sc.setJobGroup(f"sets-{n}", "", False)
        try:
            fit_batch(e, loci)
            counts.append(len(sc.statusTracker().getJobIdsForGroup(f"sets-{n}")))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < counts[1] <= counts[0] + 8


def test_a_bad_file_does_not_stop_the_service(spark, database, tmp_path):  # noqa: F811
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for k in range(4):
        write(inbox / f"good{k}.bed", f"chr1\t{10 + k}\t60\t1\n")
    write(inbox / "words.bed", "chr1\tten\t60\t1\nchr2\t5\t9\t1\n")
    write(inbox / "turned.bed", "chr1\t60\t10\t1\n")

    def run():
        query = fit_arrivals(spark, en.Engine(database[0]), str(inbox), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(240)
        assert query.exception() is None

    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r.job.rsplit("/", 1)[1] for r in rows.select("job").distinct().collect()} == {f"good{k}.bed" for k in range(4)}
    bad = {r.job.rsplit("/", 1)[1]: (r.lines, r.reason) for r in spark.read.parquet(str(tmp_path / "out-refused")).collect()}
    assert bad == {"words.bed": (1, "a field is missing or no number"), "turned.bed": (1, "an interval ends before it starts")}
    write(inbox / "later.bed", "chr2\t20\t140\t1\n")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).select("batch", "job").distinct().groupBy("batch").count().orderBy("batch").toPandas()["count"].tolist() == [4, 1]
