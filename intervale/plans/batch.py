"""Many sets of intervals fitted at once: the steps of ``Engine.fit``, each one job over all of them.

Sets are told apart by ``job``. Their sites, patterns and sums are found together and their
parameters fitted in step, so the number of Spark jobs does not grow with the number of
sets. The driver holds a few numbers a set.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Params, prior_cells
from ..sources.shared import materialize
from .engine import Config, Engine
from .fit import BRACKET, Fit, coefficient_rows, evaluate, fit_many, standard_errors


def _by_job(df: DataFrame, *sums) -> dict[str, dict]:
    return {r.job: r.asDict() for r in df.groupBy("job").agg(*sums).collect()}  # one row a set


def beta3_by_job(neutral: DataFrame, b2: dict[str, float], prior: Params, prior_weight: float) -> dict[str, float]:
    """``fit.beta3`` of every job, all brackets narrowed by the same job of sums.

    The prior's pseudo-sites are rows like others.
    """
    spark, third = neutral.sparkSession, F.col("lambda") / 3.0
    pb = prior.normalised()
    known = pb.beta1 + pb.beta3
    pseudo = [(job, "L", x, 1.0 - x, pb.lam, prior_weight * share / known) for job in b2 for x, share in ((1.0, pb.beta1), (0.0, pb.beta3))]
    spec = "job string, cls string, x_maj double, x_min double, lambda double, n double"
    every = neutral.where("cls = 'L'").select("job", "cls", "x_maj", "x_min", "lambda", F.col("n").cast("double").alias("n")).unionByName(spark.createDataFrame(pseudo, spec))
    minor = F.col("x_min") * (1.0 - F.col("lambda")) + F.col("x_maj") * third
    major = F.col("x_maj") * (1.0 - F.col("lambda")) + F.col("x_min") * third
    rows = materialize(every.groupBy("job", (minor - major).alias("A"), major.alias("M")).agg(F.sum("n").alias("n")), "beta3")
    ends = {job: (0.0, 1.0 - x) for job, x in b2.items()}
    while max(hi - lo for lo, hi in ends.values()) > 1e-11:
        at = spark.createDataFrame([(j, 1.0 - b2[j], lo, (hi - lo) / (BRACKET + 1)) for j, (lo, hi) in ends.items()], "job string, rest double, lo double, step double")
        met = rows.join(F.broadcast(at), "job").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(BRACKET))))
        p = F.greatest(F.col("A") * (F.col("lo") + F.col("step") * F.col("i")) + F.col("M") * F.col("rest"), F.lit(1e-300))
        slopes = met.groupBy("job", "i").agg(F.sum(F.col("n") * F.col("A") / p).alias("d"))
        for r in slopes.groupBy("job").agg(F.count_if(F.col("d") > 0).alias("k")).collect():  # one row a set
            lo, hi = ends[r.job]
            edges = np.linspace(lo, hi, BRACKET + 2)
            ends[r.job] = float(edges[r.k]), float(edges[r.k + 1])
    return {job: (lo + hi) / 2 for job, (lo, hi) in ends.items()}


def fit_batch(engine: Engine, loci: DataFrame, config: Config = Config()) -> dict[str, tuple[Fit, dict]]:  # noqa: B008
    """``loci`` (job, chrom, st, en, weight) as a fit and its counters for each job.

    A job without sites is fitted on the prior alone.
    """
    spark, scale, w, prior = loci.sparkSession, 1.0 / config.max_weight, config.prior_weight, config.prior
    loci = materialize(loci.select("job", "chrom", "st", "en", "weight"), "loci")
    found = materialize(engine.sites(loci, ["job"]), "sites")
    rows = materialize(engine.pattern_rows(found, ["job"]), "patterns")
    length = F.col("en") - F.col("st")
    stats = _by_job(loci, F.count("*").alias("loci"), F.sum(length).cast("long").alias("positions"), F.sum(length * F.col("weight")).cast("long").alias("weighted"))
    counters = [F.sum(F.when(F.col("cls") == c, x).otherwise(0)).cast("long").alias(f"{c.lower()}_{n}") for c in "MLH" for n, x in (("raw", F.col("len")), ("weighted", F.col("len") * F.col("weight")))]
    counted = _by_job(found, *counters)
    none = dict.fromkeys([f"{c}_{n}" for c in "mlh" for n in ("raw", "weighted")], 0)
    models = {job: prior for job in stats}
    if config.refine_lambda_theta:
        sums = _by_job(rows, F.sum("n").alias("n"), F.sum(F.col("n") * F.col("lambda")).alias("l"), F.sum(F.col("n") * F.col("theta")).alias("t"))
        for job, p in models.items():
            s = sums.get(job, {"n": 0.0, "l": 0.0, "t": 0.0})
            total = s["n"] * scale + w
            models[job] = replace(p, lam=(s["l"] * scale + w * prior.lam) / total, theta=(s["t"] * scale + w * prior.theta) / total) if total else p
    if config.refine_beta and stats:
        touched = (rows.where("cls <> 'M'") if config.poly_blocks_only else rows).select("job", "block_id").distinct()
        neutral = materialize(engine.pattern_rows(engine.neutral_sites(touched, ["job"]), ["job"]), "neutral")
        high = _by_job(neutral.where("cls IN ('L', 'H')"), F.sum("n").alias("n"), F.sum(F.expr("if(cls = 'H', n, 0)")).alias("h"))
        b2 = {job: (high.get(job, {}).get("h", 0) + w * prior.beta2) / ((high.get(job, {}).get("n", 0) + w) or 1.0) for job in models}
        b3 = beta3_by_job(neutral, b2, config.neutral_prior, w)
        models = {job: replace(p, beta1=1 - b2[job] - b3[job], beta2=b2[job], beta3=b3[job]) for job, p in models.items()}
    if not models:
        return {}
    betas = F.broadcast(spark.createDataFrame([(j, p.beta1, p.beta2, p.beta3) for j, p in models.items()], "job string, beta1 double, beta2 double, beta3 double"))
    own = replace(prior, beta1=F.col("beta1"), beta2=F.col("beta2"), beta3=F.col("beta3"))
    data = materialize(coefficient_rows(rows.join(betas, "job"), own, ["job"], scale), "data")
    both = data
    if w > 0:
        cells = spark.createDataFrame(prior_cells(prior, w), "cls string, x_maj double, x_min double, lambda double, theta double, n double")
        both = materialize(data.unionByName(coefficient_rows(betas.crossJoin(F.broadcast(cells)), own, ["job"]).where("n > 0")), "both")  # a few cells a set
    searches = fit_many(both, models, ["job"], config.fixed, config.min_eta)
    nll = {r.job: r.nll for r in evaluate(data, {j: s.x for j, s in searches.items()}, ["job"])}
    out = {}
    for job, s in searches.items():
        params = replace(models[job], **dict(zip(("rho", "eta", "gamma"), map(float, s.x))))
        made = Fit(params, float(nll.get(job) or 0.0), float(s.value or 0.0), s.gradient, s.hessian, s.converged, s.steps, standard_errors(s.hessian))
        told = {**stats[job], **counted.get(job, none)}
        told.pop("job", None)
        out[job] = made, told
    return out
