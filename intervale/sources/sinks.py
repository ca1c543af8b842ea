"""Results as DataFrames, and their text forms."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Params
from ..plans.fit import Fit, derived, derived_errors

_RESULT = "job string, section string, key string, value string"


def _number(x: float | None, digits: int = 8) -> str:
    """Fixed notation from 1e-4 up (and for 0), scientific below; undefined prints as 0."""
    if x is None:
        return f"{0:.{digits}f}"
    return f"{x:.{digits}f}" if x == 0 or abs(x) >= 1e-4 else f"{x:.{digits}e}"


def _params(p: Params) -> dict[str, float]:
    return {"Rho": p.rho, "Eta": p.eta, "Gamma": p.gamma, "Lambda": p.lam, "Theta": p.theta, "Beta1": p.beta1, "Beta2": p.beta2, "Beta3": p.beta3}


# The names that counts have in a result file.
STATS = {
    "loci": "InLoci", "positions": "InPos", "weighted": "InPosW", "m_raw": "InfPosM", "m_weighted": "InfPosWM",
    "l_raw": "InfPosL", "l_weighted": "InfPosWL", "h_raw": "InfPosH", "h_weighted": "InfPosWH",
}


def _stats(counts: dict | None) -> dict:
    return {STATS.get(k, k): 0 if v is None else v for k, v in (counts or {}).items()}


def model_values(
    job: str, fit: Fit, stats: dict | None = None, neutral: dict | None = None, prior: Params | None = None, args: dict | None = None,
    neutral_model: Params | None = None, neutral_prior: Params | None = None,
) -> list[tuple[str, str, str, str]]:
    """A fit in long form: job, section, key, value."""
    model = lambda p: {k: f"{v:.20f}" for k, v in _params(p).items()} if p else {}
    made = derived(fit.params)
    errors = {**{k.capitalize(): v for k, v in fit.errors.items()}, **{k.capitalize(): v for k, v in derived_errors(fit.params, fit.hessian).items()}}
    sections = {
        "PARAMETERS": {**model(fit.params), **{k.capitalize(): _number(v) for k, v in made.items()}},
        "UNCERTAINTY": {k: _number(v) for k, v in errors.items()},
        "STATS": {**_stats(stats), "DataNLL": f"{fit.nll:.6f}", "NLPrior": f"{fit.nll_prior:.6f}", "Converged": str(fit.converged).lower()},
        "STATSN": _stats(neutral),
        "NEUTRAL_MODEL": model(neutral_model),
        "ARGS": args or {},
        "PRIOR_MODEL": model(prior),
        "PRIORN_MODEL": model(neutral_prior),
    }
    return [(job, s, k, str(v)) for s, kv in sections.items() for k, v in kv.items()]


def model_rows(spark: SparkSession, *fit, **more) -> DataFrame:
    """``model_values`` of one fit as a DataFrame."""
    return model_table(spark, model_values(*fit, **more))


def model_table(spark: SparkSession, values: list[tuple[str, str, str, str]]) -> DataFrame:
    """Fits in long form, of one job or many."""
    return spark.createDataFrame(values, _RESULT)


def model_text(rows: DataFrame) -> DataFrame:
    """Long form as text, one row a job: sections in the order they came in."""
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    lines = numbered.groupBy("job", "section").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("n", F.concat_ws(":\t", "key", "value").alias("line")))).alias("l"))
    body = F.concat(F.col("section"), F.lit(":\n"), F.array_join("l.line", "\n"), F.lit("\n"))
    whole = lines.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("n", body.alias("b")))).alias("s"))
    return whole.select("job", F.array_join("s.b", "\n").alias("value"))


def summary_row(spark: SparkSession, fit: Fit, mode: str = "MaxAPosteriori", seconds: float = 0.0) -> DataFrame:
    """One row: mode, parameters, derived values and their errors, likelihoods."""
    row = {"mode": mode, **asdict(fit.params), **derived(fit.params), "nll": fit.nll, "nll_prior": fit.nll_prior, "runtime": seconds}
    row |= {f"{k}_err": v for k, v in {**fit.errors, **derived_errors(fit.params, fit.hessian)}.items()}
    spec = ", ".join(f"{k} {'string' if k == 'mode' else 'int' if k == 'alleles' else 'double'}" for k in row)
    return spark.createDataFrame([tuple(float(v) if isinstance(v, float) else v for v in row.values())], spec)


def interchange_lines(blocks: DataFrame, sites: DataFrame, alleles: int, betas: tuple[float, float, float] | None = None) -> DataFrame:
    """The older line format: a samples line, then each block with its sites below it.

    ``blocks``: block_id, chrom, st, en, theta, lambda. ``sites``: block_id, chrom,
    pos, cls, x_maj, x_min. Rows carry their order; ``write_lines`` sorts by it.
    """
    at = lambda *x: F.array(*[F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in x])
    head = blocks.sparkSession.createDataFrame([("", f"samples {alleles}")] + ([("", "beta " + " ".join(f"{b:.8f}" for b in betas))] if betas else []), "chrom string, value string")
    head = head.select("chrom", at(-1, -1, 0).alias("at"), "value")
    b = blocks.select("chrom", at(F.col("st"), -1, 1).alias("at"), F.concat(F.lit("block "), "chrom", F.lit(":"), "st", F.lit("-"), "en", F.lit("\ttheta "), F.col("theta").cast("string"), F.lit("\tlambda "), F.col("lambda").cast("string")).alias("value"))
    joined = sites.join(blocks.select("block_id", F.col("st").alias("_st")), "block_id")
    mono = F.format_string("%.6f", F.col("x_maj"))
    both = F.concat_ws("\t", mono, F.format_string("%.6f", F.col("x_min")))
    s = joined.select("chrom", at(F.col("_st"), F.col("pos"), 2).alias("at"), F.concat(F.lit("site "), "chrom", F.lit(":"), "pos", F.lit("\t"), "cls", F.lit("\t"), F.when(F.col("cls") == "M", mono).otherwise(both)).alias("value"))
    return head.unionByName(b).unionByName(s)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, in range-partitioned text files whose names keep the order."""
    lines.orderBy("chrom", "at").select("value").write.mode("overwrite").text(path)


def weighted_bed(runs: DataFrame, path: str) -> None:
    """Coalesced runs as BED with weights."""
    runs.orderBy("chrom", "st").select("chrom", "st", "en", "weight").write.mode("overwrite").option("sep", "\t").csv(path)


def partition_table(scored: DataFrame) -> DataFrame:
    """Scored splits of a node: best of all, best of each covariate, and all by rank."""
    return scored.withColumn("best", F.col("rank") == 1).withColumn("best_of_covariate", F.col("rank_in_cov") == 1).orderBy("node_id", "rank")
