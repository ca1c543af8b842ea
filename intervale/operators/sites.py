"""Per-site outputs: posteriors, allele posteriors, counterfactuals, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import STATES, Params, allele_joint, counterfactual, selected_mass, site_posterior


def _inputs() -> tuple:
    return F.col("lambda").cast("double"), F.col("theta").cast("double"), F.col("cls"), F.col("x_maj"), F.col("x_min")


def posteriors(sites: DataFrame, p: Params) -> DataFrame:
    """``sites`` (lambda, theta, cls, x_maj, x_min, ...) with the posterior of each state."""
    made = site_posterior(p, *_inputs())
    rows = sites.select("*", *[x.alias(s) for s, x in made.items()])
    return rows.withColumn("p_selected", selected_mass())


def posterior_sum(sites: DataFrame, weight: str = "n", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted, normalised sum of site posteriors."""
    total = F.sum(weight)
    return sites.groupBy(*keys).agg(*[(F.sum(F.col(s) * F.col(weight)) / total).alias(s) for s in STATES])


def allele_posteriors(sites: DataFrame, p: Params) -> DataFrame:
    """Joint posterior of ancestral allele and selection, by block and class.

    It depends on the block and the class only: made once for each and joined.
    """
    pairs = sites.select("block_id", "lambda", "theta", "cls").distinct()
    lam, theta, cls, _, _ = _inputs()
    by_class = {c: allele_joint(p, lam, theta, c) for c in "MLH"}
    made = [F.when(cls == "M", by_class["M"][k]).when(cls == "L", by_class["L"][k]).otherwise(by_class["H"][k]).alias(f"p_{k}") for k in by_class["M"]]
    return sites.join(pairs.select("block_id", "cls", *made), ["block_id", "cls"])


def counterfactuals(sites: DataFrame, p: Params, mode: int = 1) -> DataFrame:
    """Actual posterior and those had one more chromosome with Xa, Xi or Xo been seen."""
    made = counterfactual(p, *_inputs(), mode=mode)
    keys = ["lambda", "theta", "cls", "x_maj", "x_min"]
    rows = posteriors(sites.select(*keys).distinct(), p)  # sites of one pattern share it
    rows = rows.select("*", *[x.alias(f"{allele.lower()}_{s}") for allele, states in made.items() for s, x in states.items()])
    others = [c for c in rows.columns if c not in keys]
    rows = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *others)
    same = [sites[k].eqNullSafe(rows[f"_{k}"]) for k in keys]
    return sites.join(rows, same).select(*[sites[c] for c in sites.columns], *others)
