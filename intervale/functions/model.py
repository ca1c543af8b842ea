"""The mixture model of selection as Column expressions and small Python values.

A site has an observed class (M monomorphic, L or H: low or high frequency
polymorphism) and an ancestral allele (a: the major one, i: the minor, o: another).
A share rho of sites is under selection; eta and gamma scale divergence and
polymorphism there. lambda and theta are a block's neutral divergence and
polymorphism, beta1..3 the shares of the frequency classes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp_probability, watterson


@dataclass(frozen=True)
class Params:
    rho: float = 0.6
    eta: float = 1.0
    gamma: float = 0.6
    lam: float = 0.05
    theta: float = 0.001
    beta1: float = 0.7
    beta2: float = 0.2
    beta3: float = 0.1
    alleles: int = 108

    def normalised(self) -> Params:
        s = self.beta1 + self.beta2 + self.beta3
        return replace(self, beta1=self.beta1 / s, beta2=self.beta2 / s, beta3=self.beta3 / s)

    @property
    def t(self) -> float:
        return self.theta * watterson(self.alleles)


#: The cells of the class table that can occur, with how many alleles each stands for.
CELLS = {"Ma": 1.0, "Mo": 3.0, "La": 3.0, "Li": 3.0, "Lo": 6.0, "Ha": 1.5, "Hi": 1.5, "Ho": 3.0}


def neutral_and_selected(cell: str, lam, t, eta, gamma, beta1, beta2, beta3) -> tuple:
    """Probability of a cell for a neutral and for a selected site.

    Works on numbers and on Columns alike.
    """
    third, flat = lam / 3.0, t / 3.0
    if cell == "Ma":
        return (1.0 - lam) * (1.0 - t), (1.0 - eta * lam) * (1.0 - gamma * t)
    if cell == "Mo":
        return (1.0 - t) * third, eta * third
    if cell == "La":
        return ((1.0 - lam) * beta1 + third * beta3) * flat, (1.0 - eta * lam) * gamma * flat
    if cell == "Li":
        return ((1.0 - lam) * beta3 + third * beta1) * flat, 0.0 * lam
    if cell == "Lo":
        return third * (beta1 + beta3) * flat, 0.0 * lam
    if cell in ("Ha", "Hi"):
        return (1.0 - 2.0 * third) * beta2 * flat, 0.0 * lam
    if cell == "Ho":
        return 2.0 * third * beta2 * flat, 0.0 * lam
    return 0.0 * lam, 0.0 * lam


def class_table(p: Params) -> dict[str, float]:
    """Probability of every cell, weighted by its alleles; sums to one."""
    made = {}
    for cell, w in CELLS.items():
        s0, s1 = neutral_and_selected(cell, p.lam, p.t, p.eta, p.gamma, p.beta1, p.beta2, p.beta3)
        made[cell] = w * (p.rho * s1 + (1.0 - p.rho) * s0)
    return made


def coefficients(p: Params, lam: Column, theta: Column, cls: Column, x_maj: Column, x_min: Column) -> dict[str, Column]:
    """c, r, e, g, k with P = c + rho (r + eta e + gamma g + eta gamma k)."""
    t = theta * watterson(p.alleles)
    s0 = {cell: neutral_and_selected(cell, lam, t, F.lit(1.0), F.lit(1.0), p.beta1, p.beta2, p.beta3)[0] for cell in CELLS}
    x_oth = 1.0 - x_maj - x_min
    mono, low = cls == "M", cls == "L"
    c = (
        F.when(mono, x_maj * s0["Ma"] + (1.0 - x_maj) * s0["Mo"])
        .when(low, x_maj * s0["La"] + x_min * s0["Li"] + x_oth * s0["Lo"])
        .otherwise((x_maj + x_min) * s0["Ha"] + x_oth * s0["Ho"])
    )
    zero = F.lit(0.0)
    return {
        "c": c,
        "r": F.when(mono, x_maj - c).otherwise(-c),
        "e": F.when(mono, (1.0 - x_maj) * lam / 3.0 - x_maj * lam).otherwise(zero),
        "g": F.when(mono, -x_maj * t).when(low, x_maj * t / 3.0).otherwise(zero),
        "k": F.when(mono, x_maj * lam * t).when(low, -x_maj * lam * t / 3.0).otherwise(zero),
    }


def probability(rho, eta, gamma) -> Column:
    """P of a coefficient row; parameters are numbers or Columns."""
    return clamp_probability(F.col("c") + rho * (F.col("r") + eta * F.col("e") + gamma * F.col("g") + eta * gamma * F.col("k")))


def nll_terms(rho, eta, gamma) -> dict[str, Column]:
    """Sums that make the negative log-likelihood, its gradient and its Hessian.

    Rows hold n and the coefficients. With d1..3 the derivatives of P, the Hessian is
    the sum of n (di dj / P^2 - dij / P), and only mixed second derivatives occur.
    """
    c, r, e, g, k = (F.col(x) for x in "cregk")
    p = probability(rho, eta, gamma)
    d = {"rho": r + eta * e + gamma * g + eta * gamma * k, "eta": rho * (e + gamma * k), "gamma": rho * (g + eta * k)}
    second = {("rho", "eta"): e + gamma * k, ("rho", "gamma"): g + eta * k, ("eta", "gamma"): rho * k}
    n = F.col("n")
    made = {"nll": F.sum(-n * F.log(p))}
    made |= {f"d_{a}": F.sum(-n * x / p) for a, x in d.items()}
    names = list(d)
    for i, a in enumerate(names):
        for b in names[i:]:
            mixed = second.get((a, b), F.lit(0.0))
            made[f"h_{a}_{b}"] = F.sum(n * (d[a] * d[b] / (p * p) - mixed / p))
    return made


#: Latent states of a site, in the order of the posterior columns.
STATES = ("neut_nodiv", "neut_div", "neut_low", "neut_high", "sel_nodiv", "sel_div", "sel_low", "high")


def site_posterior(p: Params, lam: Column, theta: Column, cls: Column, x_maj: Column, x_min: Column, rho=None) -> dict[str, Column]:
    """Posterior mass of each latent state of a site; sums to one."""
    rho = F.lit(p.rho) if rho is None else rho
    t = theta * watterson(p.alleles)
    eta, gamma, third = p.eta, p.gamma, lam / 3.0
    zero, neutral = F.lit(0.0), 1.0 - rho
    mono, low = cls == "M", cls == "L"
    raw = {
        "neut_nodiv": F.when(mono, neutral * (1.0 - t) * x_maj * (1.0 - lam)).otherwise(zero),
        "neut_div": F.when(mono, neutral * (1.0 - t) * (1.0 - x_maj) * third).otherwise(zero),
        "neut_low": F.when(low, neutral * p.beta1 * t / 3.0 * ((1.0 - x_maj) * third + x_maj * (1.0 - lam))).otherwise(zero),
        "neut_high": F.when(low, neutral * p.beta3 * t / 3.0 * ((1.0 - x_min) * third + x_min * (1.0 - lam))).otherwise(zero),
        "sel_nodiv": F.when(mono, rho * (1.0 - gamma * t) * x_maj * (1.0 - eta * lam)).otherwise(zero),
        "sel_div": F.when(mono, rho * (1.0 - x_maj) * eta * third).otherwise(zero),
        "sel_low": F.when(low, rho * gamma * t / 3.0 * x_maj * (1.0 - eta * lam)).otherwise(zero),
        "high": F.when(~mono & ~low, F.lit(1.0)).otherwise(zero),
    }
    total = sum(raw.values(), F.lit(0.0))
    return {s: x / total for s, x in raw.items()}


def selected_mass(prefix: str = "") -> Column:
    """P(selected) of a site from its posterior columns."""
    return F.col(f"{prefix}sel_nodiv") + F.col(f"{prefix}sel_div") + F.col(f"{prefix}sel_low")


def allele_joint(p: Params, lam: Column, theta: Column, cls: str) -> dict[str, Column]:
    """Joint posterior of ancestral allele and selection, given a block and a class.

    It depends on nothing else, so it is made once per (block, class) and joined.
    """
    t = theta * watterson(p.alleles)
    other = 3.0 if cls == "M" else 2.0
    raw = {}
    for z, s in product("aio", (0, 1)):
        values = neutral_and_selected(f"{cls}{z}", lam, t, F.lit(p.eta), F.lit(p.gamma), p.beta1, p.beta2, p.beta3)
        raw[f"{z}{s}"] = values[s] * ((1.0 - p.rho), p.rho)[s] * (other if z == "o" else 1.0)
    total = sum(raw.values(), F.lit(0.0))
    return {k: v / total for k, v in raw.items()}


def counterfactual(p: Params, lam: Column, theta: Column, cls: Column, x_maj: Column, x_min: Column, mode: int = 1) -> dict[str, dict[str, Column]]:
    """Posteriors had one more chromosome with allele Xa, Xi or Xo been seen.

    Posteriors are those of N + 1 chromosomes. Mode 2 lets the class change, by odds of
    the N that were seen: a low site with one more minor allele becomes high with chance
    1 / floor(0.15 N - 1), a high one with one more major allele becomes low with chance
    1 / floor(0.35 N). A change that cannot be has null mass.
    """
    q = replace(p, alleles=p.alleles + 1)
    n = p.alleles
    x_oth = 1.0 - x_maj - x_min
    mono, low = cls == "M", cls == "L"
    post = lambda c, a, i, rho=None: site_posterior(q, lam, theta, F.lit(c), a, i, rho)
    as_m, as_l, as_h = post("M", x_maj, x_min), post("L", x_maj, x_min), post("H", x_maj, x_min)
    as_new, as_neutral = post("L", x_maj, x_oth / 3.0), post("L", x_maj, x_min, F.lit(0.0))
    to_high, to_low = 1.0 / int(0.15 * n - 1), 1.0 / int(0.35 * n)
    made: dict[str, dict[str, Column]] = {"Xa": {}, "Xi": {}, "Xo": {}}
    for s in STATES:
        low_i = as_l[s] if mode == 1 else (1.0 - to_high) * as_l[s] + to_high * as_h[s]
        high_a = as_h[s] if mode == 1 else (1.0 - to_low) * as_h[s] + to_low * as_l[s]
        made["Xa"][s] = F.when(mono, as_m[s]).when(low, as_l[s]).otherwise(high_a)
        made["Xi"][s] = F.when(mono, F.lit(None).cast("double")).when(low, low_i).otherwise(as_h[s])
        made["Xo"][s] = F.when(mono, as_new[s]).when(low, as_neutral[s]).otherwise(as_h[s])
    return made


def prior_cells(prior: Params, weight: float) -> list[tuple]:
    """The prior as pseudo-sites: (cls, x_maj, x_min, lambda, theta, n)."""
    place = {"a": (1.0, 0.0), "i": (0.0, 1.0), "o": (0.0, 0.0)}
    return [(cell[0], *place[cell[1]], prior.lam, prior.theta, weight * share) for cell, share in class_table(prior).items()]


