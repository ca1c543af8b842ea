"""Fitting the model: each step is one aggregate over cached coefficients.

Only sums reach the driver: ten numbers a subset and step. Many subsets are fitted
at once by grouping on ``subset_id``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Params, coefficients, nll_terms, prior_cells
from ..functions.numeric import TINY, inverse3

NAMES = ("rho", "eta", "gamma")
#: Limits of rho; first upper limits of eta and gamma, which widen up to WIDEST.
RHO_LIMITS, ETA_TOP, GAMMA_TOP, WIDEST = (0.001, 0.999), 2.0, 5.0, 600.0
#: Up to this many coefficient rows (6 numbers each) the steps run on the driver; above it each step is a job.
LOCAL_ROWS = 200_000
#: Points of a bracket whose derivatives one job sums.
BRACKET = 40


@dataclass
class Fit:
    params: Params
    nll: float
    nll_prior: float
    gradient: np.ndarray
    hessian: np.ndarray
    converged: bool
    steps: int
    errors: dict[str, float | None] = field(default_factory=dict)


def lambda_theta(sites: DataFrame, weight: str, prior: Params, prior_weight: float, scale: float = 1.0) -> tuple[float, float]:
    """Weighted means of block lambda and theta (columns lambda, theta), with pseudo-counts."""
    row = sites.agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col("lambda").cast("double")).alias("l"), F.sum(F.col(weight) * F.col("theta").cast("double")).alias("t")).first()
    total = (row.w or 0.0) * scale + prior_weight
    return ((row.l or 0.0) * scale + prior_weight * prior.lam) / total, ((row.t or 0.0) * scale + prior_weight * prior.theta) / total


def beta2(neutral: DataFrame, prior: float, prior_weight: float) -> float:
    """Share of high-frequency sites among neutral polymorphisms (cls, n)."""
    row = neutral.where("cls IN ('L', 'H')").agg(F.sum(F.expr("if(cls = 'H', n, 0)")).alias("h"), F.sum("n").alias("n")).first()
    return ((row.h or 0.0) + prior_weight * prior) / ((row.n or 0.0) + prior_weight)


def beta3(neutral: DataFrame, b2: float, prior: Params, prior_weight: float, start: float | None = None) -> float:
    """beta3 by maximum likelihood on neutral low-frequency patterns (x_maj, x_min, lambda, n).

    The log-likelihood is a sum of n ln(A b + B), concave in b, so its derivative falls.
    Each job takes the derivative at BRACKET points of the interval that holds its zero,
    and the next interval is the one between two of them; ``start`` has no bearing.
    """
    third = F.col("lambda") / 3.0
    minor = F.col("x_min") * (1.0 - F.col("lambda")) + F.col("x_maj") * third
    major = F.col("x_maj") * (1.0 - F.col("lambda")) + F.col("x_min") * third
    rows = neutral.where("cls = 'L'").select((minor - major).alias("A"), (major * (1.0 - b2)).alias("B"), "n")
    rows = rows.groupBy("A", "B").agg(F.sum("n").alias("n")).cache()
    spark, pb = neutral.sparkSession, prior.normalised()
    known = pb.beta1 + pb.beta3
    pseudo = []
    for x_maj, x_min, share in ((1.0, 0.0, pb.beta1 / known), (0.0, 1.0, pb.beta3 / known)):
        ma = x_maj * (1 - pb.lam) + x_min * pb.lam / 3
        pseudo.append((x_min * (1 - pb.lam) + x_maj * pb.lam / 3 - ma, ma * (1 - b2), prior_weight * share))
    low, high = 0.0, 1.0 - b2
    while high - low > 1e-11:
        points = np.linspace(low, high, BRACKET + 2)[1:-1].tolist()
        at = spark.createDataFrame(list(enumerate(points)), "i int, b double")
        slope = F.sum(F.col("n") * F.col("A") / F.greatest(F.col("A") * F.col("b") + F.col("base"), F.lit(1e-300)))
        sums = {r.i: r.d for r in rows.withColumnRenamed("B", "base").crossJoin(F.broadcast(at)).groupBy("i").agg(slope.alias("d")).collect()}  # BRACKET rows
        slopes = [(sums.get(i) or 0.0) + sum(n * a / max(a * b + c, 1e-300) for a, c, n in pseudo) for i, b in enumerate(points)]
        rising = sum(d > 0 for d in slopes)
        edges = [low, *points, high]
        low, high = edges[rising], edges[rising + 1]
    rows.unpersist()
    return (low + high) / 2


def coefficient_rows(patterns: DataFrame, p: Params, keys: list[str] = [], scale: float = 1.0) -> DataFrame:  # noqa: B006
    """Patterns (keys, cls, x_maj, x_min, lambda, theta, n) as coefficients and n."""
    lam, theta = F.col("lambda").cast("double"), F.col("theta").cast("double")
    made = coefficients(p, lam, theta, F.col("cls"), F.col("x_maj"), F.col("x_min"))
    n = (F.col("n") * scale).cast("double").alias("n")
    rows = patterns.select(*keys, *[x.alias(k) for k, x in made.items()], n)
    # Rows with equal coefficients are one row with their counts summed.
    return rows.groupBy(*keys, *"cregk").agg(F.sum("n").alias("n"))


def prior_rows(spark, p: Params, prior: Params, weight: float) -> DataFrame:
    """The prior's pseudo-sites as coefficient rows; betas are the fitted model's."""
    cells = spark.createDataFrame(prior_cells(prior, weight), "cls string, x_maj double, x_min double, lambda double, theta double, n double")
    return coefficient_rows(cells, p).where("n > 0")


def evaluate(rows: DataFrame, at: dict, keys: list[str] = []) -> list:  # noqa: B006
    """Sums of likelihood, gradient and Hessian at one point, or at each subset's.

    ``at`` maps a subset (or None) to (rho, eta, gamma).
    """
    if not keys:
        return rows.agg(*[x.alias(k) for k, x in nll_terms(*map(F.lit, at[None])).items()]).collect()
    spark = rows.sparkSession
    points = spark.createDataFrame([(s, *map(float, v)) for s, v in at.items()], f"{keys[0]} {rows.schema[keys[0]].dataType.simpleString()}, _rho double, _eta double, _gamma double")
    both = rows.join(F.broadcast(points), keys[0])  # one row a candidate subset
    return both.groupBy(*keys).agg(*[x.alias(k) for k, x in nll_terms(F.col("_rho"), F.col("_eta"), F.col("_gamma")).items()]).collect()


def _unfold(row) -> tuple[float, np.ndarray, np.ndarray]:
    gradient = np.array([row[f"d_{a}"] for a in NAMES], float)
    hessian = np.zeros((3, 3))
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[i:], i):
            hessian[i, j] = hessian[j, i] = row[f"h_{a}_{b}"]
    return float(row.nll), gradient, hessian


class _Local:
    """The same sums as ``evaluate`` over few coefficient rows, held as arrays."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        table = rows.select(*keys, *"cregk", "n").toArrow()
        data = np.array([table.column(k).to_numpy() for k in (*"cregk", "n")]).T
        if keys:
            names = np.array(table.column(keys[0]).to_pylist(), object)
            self.data = {s: data[names == s] for s in dict.fromkeys(names.tolist())}
        else:
            self.data = {None: data} if len(data) else {}

    def at(self, points: dict) -> dict:
        return {s: self._sums(self.data[s], *x) for s, x in points.items() if s in self.data}

    @staticmethod
    def _sums(data: np.ndarray, rho: float, eta: float, gamma: float) -> tuple[float, np.ndarray, np.ndarray]:
        c, r, e, g, k, n = data.T
        p = c + rho * (r + eta * e + gamma * g + eta * gamma * k)
        p = np.where((p < 0) | (p > 1), TINY, p)
        d = np.stack([r + eta * e + gamma * g + eta * gamma * k, rho * (e + gamma * k), rho * (g + eta * k)])
        with np.errstate(all="ignore"):
            hessian = (d * (n / (p * p))) @ d.T
            for (i, j), x in {(0, 1): e + gamma * k, (0, 2): g + eta * k, (1, 2): rho * k}.items():
                hessian[i, j] -= (n * x / p).sum()
                hessian[j, i] = hessian[i, j]
            return float(-(n * np.log(p)).sum()), -(d * (n / p)).sum(axis=1), hessian


class _Newton:
    """A projected, damped Newton search for one subset, fed one evaluation at a time."""

    def __init__(self, start: np.ndarray, low: np.ndarray, top: np.ndarray, free: np.ndarray):
        self.low, self.top, self.free = low, top, free
        self.x = np.where(free, np.clip(start, low, top), start)
        self.next, self.value, self.damp, self.steps = self.x.copy(), None, 1e-8, 0
        self.done = self.converged = False
        self.gradient, self.hessian = np.zeros(3), np.eye(3)

    def tell(self, value: float, gradient: np.ndarray, hessian: np.ndarray, tolerance: float) -> None:
        self.steps += 1
        if self.value is None or (np.isfinite(value) and value <= self.value + 1e-12 * abs(self.value)):
            gain = np.inf if self.value is None else self.value - value
            moved = np.inf if self.value is None else float(np.abs(self.next - self.x).max())
            self.x, self.value, self.gradient, self.hessian = self.next, value, gradient, hessian
            self.damp = max(self.damp / 10, 1e-12)
            self._widen()
            slack = self._projected(self.x - gradient / np.maximum(np.abs(np.diag(hessian)), 1.0)) - self.x
            if float(np.abs(slack).max()) < tolerance or (gain < 1e-11 * max(1.0, abs(value)) and moved < tolerance):
                self.done = self.converged = True
                return
        else:
            self.damp = max(self.damp * 10, 1e-6)
        if self.damp > 1e12 or self.steps >= 200:
            self.done = True
            return
        self._propose()

    def _projected(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.free, np.clip(x, self.low, self.top), self.x)

    def _widen(self) -> None:
        for i in (1, 2):
            if self.free[i] and self.x[i] > 0.9 * self.top[i] and self.top[i] < WIDEST:
                self.top[i] = min(WIDEST, 3 * self.top[i])

    def _propose(self) -> None:
        held = self.free.copy()
        held &= ~((self.x <= self.low) & (self.gradient > 0)) & ~((self.x >= self.top) & (self.gradient < 0))
        step, idx = np.zeros(3), np.flatnonzero(held)
        if len(idx):
            h = self.hessian[np.ix_(idx, idx)]
            size = np.maximum(np.abs(np.diag(h)), 1e-8)
            least = np.linalg.eigvalsh(h / np.sqrt(np.outer(size, size))).min()
            shift = self.damp + max(0.0, 1e-6 - least)
            step[idx] = np.linalg.solve(h + np.diag(shift * size), -self.gradient[idx])
        new = self._projected(self.x + step)
        if np.allclose(new, self.x, rtol=0, atol=1e-13):
            self.done = self.converged = True
        self.next = new


def fit_many(rows: DataFrame, starts: dict, keys: list[str] = [], fixed: tuple[str, ...] = (), min_eta: float = 0.0, tolerance: float = 1e-7) -> dict[object, _Newton]:  # noqa: B006
    """Fit rho, eta, gamma of every subset; each round is one job over all open ones."""
    free = np.array([n not in fixed for n in NAMES])
    low, top = np.array([RHO_LIMITS[0], min_eta, 0.0]), np.array([RHO_LIMITS[1], ETA_TOP, GAMMA_TOP])
    searches = {s: _Newton(np.array([p.rho, p.eta, p.gamma]), low.copy(), top.copy(), free) for s, p in starts.items()}
    local = _Local(rows, keys) if rows.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS else None
    while open_ := {s: f.next for s, f in searches.items() if not f.done}:
        told = local.at(open_) if local else {(r[keys[0]] if keys else None): _unfold(r) for r in evaluate(rows, open_, keys)}
        for s in open_:
            if s in told:
                searches[s].tell(*told[s], tolerance)
            else:  # no rows: nothing to fit
                searches[s].done, searches[s].value = True, 0.0
    return searches


def standard_errors(hessian: np.ndarray) -> dict[str, float | None]:
    """Square roots of the inverse Hessian's diagonal; None where undefined."""
    v = inverse3(hessian)
    return {n: float(np.sqrt(v[i, i])) if v is not None and v[i, i] > 0 else None for i, n in enumerate(NAMES)}


def fit(rows: DataFrame, start: Params, prior: DataFrame | None = None, fixed: tuple[str, ...] = (), min_eta: float = 0.0) -> Fit:
    """Maximum likelihood, or with ``prior`` rows maximum a posteriori."""
    data = rows.select(*"cregk", "n").cache()
    joined = data if prior is None else data.unionByName(prior.select(*"cregk", "n")).cache()
    found = fit_many(joined, {None: start}, fixed=fixed, min_eta=min_eta)[None]
    x = found.x
    params = replace(start, rho=float(x[0]), eta=float(x[1]), gamma=float(x[2]))
    nll = float(evaluate(data, {None: x})[0].nll or 0.0)
    out = Fit(params, nll, float(found.value or 0.0), found.gradient, found.hessian, found.converged, found.steps, standard_errors(found.hessian))
    joined.unpersist()
    data.unpersist()
    return out


def derived(p: Params) -> dict[str, float]:
    """Adaptive divergence and weakly deleterious polymorphism per kilobase, alpha and tau."""
    lam, t = p.lam, p.t
    re, rg = p.rho * p.eta, p.rho * p.gamma
    return {
        "dp": 1000 * re * lam,
        "pw": 1000 * rg * (t - p.eta * lam * t),
        "alpha": 1 / (1 + (1 - p.rho) / re) if re else 0.0,
        "tau": 1 / (1 + (1 - p.rho) / rg) if rg else 0.0,
    }


def derived_errors(p: Params, hessian: np.ndarray) -> dict[str, float | None]:
    """Delta-method errors of ``derived``; None where undefined."""
    v = inverse3(hessian)
    out: dict[str, float | None] = dict.fromkeys(("dp", "pw", "alpha", "tau"))
    if v is None or not p.rho:
        return out
    made = derived(p)

    def root(gradient) -> float | None:
        x = float(np.array(gradient) @ v @ np.array(gradient))
        return float(np.sqrt(x)) if x > 0 else None

    if p.eta:
        s = root([1 / p.rho, 1 / p.eta, 0])
        out["dp"] = None if s is None else made["dp"] * s
        s = root([1 / (p.rho**2 * p.eta), (1 - p.rho) / (p.rho * p.eta**2), 0])
        out["alpha"] = None if s is None else made["alpha"] ** 2 * s
    if p.gamma:
        gap = p.t - p.eta * p.lam * p.t
        s = root([1 / p.rho, -p.lam * p.t / gap, 1 / p.gamma]) if gap else None
        out["pw"] = None if s is None else made["pw"] * s
        s = root([1 / (p.rho**2 * p.gamma), 0, (1 - p.rho) / (p.rho * p.gamma**2)])
        out["tau"] = None if s is None else made["tau"] ** 2 * s
    return out
