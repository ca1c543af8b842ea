"""Posterior over parameters on a grid, its marginals, expectations and quantiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.model import CELLS, Params, class_table
from ..functions.numeric import TINY

#: Margin that keeps grid values off their limits, and the largest eta and gamma.
EDGE, TOP = 1e-9, 10.0


def axis(low: float, high: float, resolution: int, foci: list[tuple[float, float]]) -> list[float]:
    """Evenly spaced values and, around each focus (centre, width), as many again."""
    made = set(np.linspace(low, high, resolution + 1).tolist())
    for centre, width in foci:
        made |= {x for x in np.linspace(centre - width / 2, centre + width / 2, resolution + 1).tolist() if low <= x <= high}
    return sorted(made)


def axes(mode: Params, resolution: int = 10) -> dict[str, list[float]]:
    """The grid's values of rho, eta and gamma around the fitted mode."""
    out = {"rho": axis(EDGE, 1 - EDGE, resolution, [(mode.rho, 0.2), (mode.rho, 0.02)])}
    for name in ("eta", "gamma"):
        centre = getattr(mode, name)
        foci = [(centre, w) for w in (2.0, 0.2, 0.02)]
        if name == "eta" and centre < 0.01:  # near zero the steps halve towards it
            made = set(axis(EDGE, TOP - EDGE, resolution, []))
            for w, times in ((2.0, 1), (0.2, 2), (0.02, 2)):
                made |= {w / 2 * 0.5**k for k in range(resolution * times + 1) if w / 2 * 0.5**k >= EDGE}
            out[name] = sorted(made)
        else:
            out[name] = axis(EDGE, TOP - EDGE, resolution, foci)
    return out


def widths(values: list[float]) -> list[float]:
    """Half the distance between a value's neighbours; half a cell at the ends."""
    v = np.array(values)
    if len(v) == 1:
        return [1.0]
    w = np.empty(len(v))
    w[1:-1] = (v[2:] - v[:-2]) / 2
    w[0], w[-1] = (v[1] - v[0]) / 2, (v[-1] - v[-2]) / 2
    return w.tolist()


def grid(spark: SparkSession, values: dict[str, list[float]]) -> DataFrame:
    """One row a cell: cell, rho, eta, gamma, their widths and log_size. The axes bound its size."""
    size = {k: len(v) for k, v in values.items()}
    n = size["rho"] * size["eta"] * size["gamma"]
    df, place = spark.range(n).withColumnRenamed("id", "cell"), F.col("cell")
    logs = []
    for name in ("gamma", "eta", "rho"):
        at = (place % size[name] + 1).cast("int")
        df = df.withColumn(name, F.element_at(F.array(*map(F.lit, values[name])), at))
        df = df.withColumn(f"d_{name}", F.element_at(F.array(*[F.lit(float(w)) for w in widths(values[name])]), at))
        logs.append(F.log(f"d_{name}"))
        place = F.floor(place / size[name])
    return df.withColumn("log_size", logs[0] + logs[1] + logs[2])


def prior_nll(p: Params, prior: Params, weight: float) -> float:
    """Negative log-density of parameters under a prior's pseudo-sites."""
    ours, theirs = class_table(replace(p, lam=prior.lam, theta=prior.theta)), class_table(prior)
    return -sum(weight * theirs[c] * np.log(max(ours[c] / CELLS[c], TINY)) for c in theirs)


def _partial(points: np.ndarray):
    """Sums of -n ln P over a task's coefficient rows, for every cell: of the data's and of the prior's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rho, eta, gamma = points[:, 0:1], points[:, 1:2], points[:, 2:3]
        total, any_ = np.zeros((2, len(points))), False
        for batch in batches:
            c, r, e, g, k, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            prior = batch.column(6).to_numpy(zero_copy_only=False)
            # Rows without selection terms, P = c (1 - rho), fold into two sums.
            plain = (r == -c) & (e == 0) & (g == 0) & (k == 0) & (c > 0) & (c <= 1)
            for side in (False, True):
                at = plain & (prior == side)
                if at.any():
                    total[int(side)] -= (n[at] * np.log(c[at])).sum() + n[at].sum() * np.log(1.0 - rho[:, 0])
                rest = np.flatnonzero(~plain & (prior == side))
                for i in range(0, len(rest), 64):
                    s = rest[i : i + 64]
                    p = c[s] + rho * (r[s] + eta * e[s] + gamma * g[s] + eta * gamma * k[s])
                    total[int(side)] -= np.log(np.where((p < 0) | (p > 1), TINY, p)) @ n[s]
            any_ |= batch.num_rows > 0
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(total[0]), pa.array(total[1])], ["cell", "data", "prior"])

    return run


def _normalised(x: np.ndarray) -> np.ndarray:
    top = x.max()
    return x - (top + np.log(np.exp(x - top).sum()))


def parameter_posterior(rows: DataFrame, prior_rows: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    """The grid with log prior and posterior masses (log_prior, log_post) and densities.

    The coefficient rows (c, r, e, g, k, n) stay where they are: each task returns two
    numbers a cell, which are summed in one aggregate. The axes bound the cells, which
    are normalised on the driver.
    """
    spark, names = rows.sparkSession, [*"cregk", "n"]
    points = np.stack(np.meshgrid(*(values[k] for k in ("rho", "eta", "gamma")), indexing="ij"), axis=-1).reshape(-1, 3)
    size = np.log(np.stack(np.meshgrid(*(widths(values[k]) for k in ("rho", "eta", "gamma")), indexing="ij"), axis=-1)).reshape(-1, 3).sum(axis=1)
    exact = lambda df, prior: df.select(*[F.col(k).cast("double").alias(k) for k in names], F.lit(prior).alias("prior"))
    both = exact(rows, False).unionByName(exact(prior_rows, True))
    parts = both.mapInArrow(_partial(points), "cell long, data double, prior double")
    summed = parts.groupBy("cell").agg(F.sum("data").alias("data"), F.sum("prior").alias("prior")).toArrow()
    nll = np.zeros((2, len(points)))
    nll[:, summed.column("cell").to_numpy()] = summed.column("data").to_numpy(), summed.column("prior").to_numpy()
    log_prior = _normalised(size - nll[1])
    log_post = _normalised(log_prior - nll[0])
    columns = {"cell": np.arange(len(points)), "data_nll": nll[0], "prior_nll": nll[1], "log_prior": log_prior, "log_post": log_post, "prior_density": log_prior - size, "post_density": log_post - size}
    return grid(spark, values).join(spark.createDataFrame(pa.table(columns)), "cell")


def marginals(posterior: DataFrame) -> DataFrame:
    """Prior and posterior mass of each value of each axis: axis, value, prior, post."""
    sets = posterior.groupingSets([["rho"], ["eta"], ["gamma"]], "rho", "eta", "gamma")
    made = sets.agg(F.sum(F.exp("log_prior")).alias("prior"), F.sum(F.exp("log_post")).alias("post"))
    name = F.when(F.col("rho").isNotNull(), "rho").when(F.col("eta").isNotNull(), "eta").otherwise("gamma")
    return made.select(name.alias("axis"), F.coalesce("rho", "eta", "gamma").alias("value"), "prior", "post")


def expectation(df: DataFrame, value: str, weight: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Weighted mean by key."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("expectation"))


def quantiles(marginal: DataFrame, at: list[float], keys: list[str] = ["axis"], value: str = "value", mass: str = "post") -> DataFrame:  # noqa: B006
    """Interpolated quantiles of a marginal on a grid: keys, q, x.

    The distribution function at a value holds the part of its cell below it; a cell
    reaches half-way to its neighbours, so its parts are not equal on an uneven grid.
    """
    cells = marginal.select(*keys, F.col(value).alias("x"), F.col(mass).alias("m"))
    w = Window.partitionBy(*keys).orderBy("x")
    cells = cells.withColumn("lo", F.lag("x").over(w)).withColumn("hi", F.lead("x").over(w)).withColumn("pm", F.lag("m").over(w))
    cells = cells.withColumn("nx", F.when(F.col("lo").isNull(), 0.0).when(F.col("hi").isNull(), 1.0).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    cells = cells.withColumn("pv", F.when(F.col("lo").isNull(), 0.0).otherwise(1.0 - F.lag("nx").over(w)))
    gain = F.when(F.col("lo").isNull(), 0.0).otherwise(F.col("pv") * F.col("pm") + F.col("nx") * F.col("m"))
    cells = cells.withColumn("f", F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("f", F.when(F.col("hi").isNull(), 1.0).otherwise(F.col("f")))
    cells = cells.withColumn("pf", F.lag("f").over(w)).where("lo IS NOT NULL")
    asked = cells.withColumn("q", F.explode(F.array(*map(F.lit, at)))).where("f >= q")
    found = asked.groupBy(*keys, "q").agg(F.min_by(F.struct("x", "lo", "f", "pf"), "x").alias("c"))
    part = (F.col("q") - F.col("c.pf")) / (F.col("c.f") - F.col("c.pf"))
    return found.select(*keys, "q", (F.col("c.lo") + part * (F.col("c.x") - F.col("c.lo"))).alias("x"))


def expected_information(grid_hi: DataFrame, grid_lo: DataFrame, gain: Column) -> DataFrame:
    """Expectation of ``gain`` (of columns hi and lo) over two weighted grids.

    Both grids have a fixed number of points (value, w); their product is evaluated
    whole, in total and where hi exceeds lo.
    """
    both = grid_hi.select(F.col("value").alias("hi"), F.col("w").alias("wh")).crossJoin(F.broadcast(grid_lo.select(F.col("value").alias("lo"), F.col("w").alias("wl"))))
    w = F.col("wh") * F.col("wl")
    return both.agg((F.sum(w * gain) / F.sum(w)).alias("total"), (F.sum(F.when(F.col("hi") > F.col("lo"), w * gain).otherwise(0.0)) / F.sum(w)).alias("ordered"))
