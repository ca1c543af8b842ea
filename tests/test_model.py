"""The model's formulas: printed results, identities and finite differences."""

import math
import random
from dataclasses import replace

import numpy as np
from intervale.functions import model as m
from intervale.functions import numeric as num
from intervale.functions import strings as st
from intervale.operators import grid, sites
from intervale.plans import fit
from intervale.plans.engine import HG19
from pyspark.sql import functions as F

# A published fit, its derived values and the part of its likelihood that is the prior's.
FITTED = m.Params(0.35490062129652316658, 0.78551349810058035406, 1.28767521261141060229, 0.00356055366780920176, 0.00086980982309686988, 0.76969762826673626677, 0.19389589553708369563, 0.03640647619618012781)
PRIOR = replace(HG19, rho=0.359788, eta=0.788613, gamma=1.277413)
DERIVED, PRIOR_PART = {"dp": 0.99260840, "pw": 2.08290663, "alpha": 0.30174876, "tau": 0.41466141}, 24.385306


def patterns(spark, seed=1, n=60):
    rng = random.Random(seed)
    rows = [(rng.choice("MLH"), x := 0.5 + 0.45 * rng.random(), (1 - x) * rng.random(), 0.003 + 0.002 * rng.random(), 0.0008 + 0.0004 * rng.random(), rng.randrange(1, 900)) for _ in range(n)]
    return spark.createDataFrame(rows, "cls string, x_maj double, x_min double, lambda double, theta double, n long")


def test_class_table_sums_to_one():
    for p in (HG19, FITTED, m.Params()):
        assert abs(sum(m.class_table(p).values()) - 1) < 1e-12


def test_derived_values_of_a_published_fit():
    got = fit.derived(FITTED)
    assert all(abs(got[k] - v) < 1e-8 for k, v in DERIVED.items())
    assert fit.derived(replace(FITTED, eta=0.0))["alpha"] == 0 and fit.derived(replace(FITTED, gamma=0.0))["tau"] == 0


def test_prior_part_of_a_published_likelihood(spark):
    rows = fit.prior_rows(spark, FITTED, PRIOR, 347.0)
    got = fit.evaluate(rows, {None: (FITTED.rho, FITTED.eta, FITTED.gamma)})[0].nll
    assert abs(got - PRIOR_PART) < 2e-6


def test_gradient_and_hessian_against_differences(spark):
    rows = fit.coefficient_rows(patterns(spark), HG19).cache()
    x = np.array([0.3, 0.7, 1.1])
    nll = lambda v: fit._Local._sums(data, *v)[0]
    data = np.array(rows.select(*"cregk", "n").collect())
    value, gradient, hessian = fit._unfold(fit.evaluate(rows, {None: x})[0])
    local = fit._Local(rows, []).at({None: x})[None]
    assert abs(value - nll(x)) < 1e-6 * abs(value)
    assert np.allclose(gradient, num.central_difference(nll, x, 1e-5), rtol=1e-4, atol=1e-2)
    assert np.allclose(gradient, local[1]) and np.allclose(hessian, local[2])
    for i in range(3):
        column = num.central_difference(lambda v: fit._Local._sums(data, *v)[1][i], x, 1e-5)
        assert np.allclose(hessian[i], column, rtol=1e-3, atol=1e-1)


def test_coefficients_give_the_table(spark):
    p, rows = FITTED, [(c[0], *{"a": (1.0, 0.0), "i": (0.0, 1.0), "o": (0.0, 0.0)}[c[1]], c) for c in m.CELLS]
    df = spark.createDataFrame(rows, "cls string, x_maj double, x_min double, cell string")
    made = m.coefficients(p, F.lit(p.lam), F.lit(p.theta), F.col("cls"), F.col("x_maj"), F.col("x_min"))
    got = df.select("cell", *[x.alias(k) for k, x in made.items()]).withColumn("p", m.probability(p.rho, p.eta, p.gamma)).collect()
    table = m.class_table(p)
    assert all(abs(r.p - table[r.cell] / m.CELLS[r.cell]) < 1e-15 for r in got)


def simulated(spark, truth, n=4_000_000, seed=5):
    rng = np.random.default_rng(seed)
    table = m.class_table(truth)
    counts = rng.multinomial(n, list(table.values()))
    place = {"a": (1.0, 0.0), "i": (0.0, 1.0), "o": (0.0, 0.0)}
    rows = [(c[0], *place[c[1]], truth.lam, truth.theta, int(k)) for c, k in zip(table, counts) if k]
    return spark.createDataFrame(rows, "cls string, x_maj double, x_min double, lambda double, theta double, n long")


def test_fit_recovers_the_truth(spark, monkeypatch):
    truth = m.Params(0.4, 0.8, 0.9, 0.05, 0.01, 0.75, 0.2, 0.05)
    rows = fit.coefficient_rows(simulated(spark, truth), truth)
    got = fit.fit(rows, replace(truth, rho=0.6, eta=1.2, gamma=0.4))
    assert got.converged
    for name in fit.NAMES:
        assert abs(getattr(got.params, name) - getattr(truth, name)) < 4 * got.errors[name]
    monkeypatch.setattr(fit, "LOCAL_ROWS", 0)  # the same steps as jobs
    again = fit.fit(rows, replace(truth, rho=0.6, eta=1.2, gamma=0.4))
    assert np.allclose([again.params.rho, again.params.eta, again.params.gamma], [got.params.rho, got.params.eta, got.params.gamma], atol=1e-5)
    held = fit.fit(rows, replace(truth, rho=0.6), fixed=("rho",))
    assert held.params.rho == 0.6 and held.nll >= got.nll


def test_fit_on_a_bound(spark):
    truth = m.Params(0.5, 0.0, 0.5, 0.05, 0.01, 0.75, 0.2, 0.05)
    got = fit.fit(fit.coefficient_rows(simulated(spark, truth), truth), replace(truth, eta=0.5), fit.prior_rows(spark, truth, truth, 347.0))
    assert got.params.eta < 0.05 and abs(got.params.rho - 0.5) < 0.05
    assert fit.fit(fit.coefficient_rows(simulated(spark, truth).limit(0), truth), truth).nll == 0


def test_beta3_is_the_maximum(spark):
    truth = m.Params(0.0, 1.0, 1.0, 0.05, 0.01, 0.7, 0.2, 0.1)
    df = simulated(spark, truth)
    b2 = fit.beta2(df, 0.2, 0.0)
    got = fit.beta3(df, b2, truth, 0.0)
    assert abs(b2 - 0.2) < 0.01 and abs(got - 0.1) < 0.01


def test_lambda_theta(spark):
    df = spark.createDataFrame([(1.0, 0.1, 0.01), (3.0, 0.2, 0.02)], "n double, lambda double, theta double")
    lam, theta = fit.lambda_theta(df, "n", m.Params(lam=0.5, theta=0.05), 4.0, 0.5)
    assert abs(lam - (0.5 * 0.7 + 4 * 0.5) / 6) < 1e-12 and abs(theta - (0.5 * 0.07 + 4 * 0.05) / 6) < 1e-12


def test_site_posteriors_sum_to_one(spark):
    df = patterns(spark).withColumn("block_id", F.lit(1))
    for r in sites.posteriors(df, FITTED).collect():
        assert abs(sum(r[s] for s in m.STATES) - 1) < 1e-12
        assert abs(r.p_selected - (r.sel_nodiv + r.sel_div + r.sel_low)) < 1e-15
    one = spark.createDataFrame([(1, c, 0.004, 0.001, 0.9, 0.05) for c in "MLH"], "block_id int, cls string, lambda double, theta double, x_maj double, x_min double")
    for r in sites.allele_posteriors(one, FITTED).collect():
        assert abs(sum(r[f"p_{z}{s}"] for z in "aio" for s in "01") - 1) < 1e-12
    for mode in (1, 2):
        for r in sites.counterfactuals(one, FITTED, mode).collect():
            for a in ("xa", "xi", "xo"):
                parts = [r[f"{a}_{s}"] for s in m.STATES]
                assert parts == [None] * 8 if r.cls == "M" and a == "xi" else abs(sum(parts) - 1) < 1e-12
    total = sites.posterior_sum(sites.posteriors(df, FITTED)).first()
    assert abs(sum(total) - 1) < 1e-9


def test_class_changes_by_hand(spark):
    """At 108 chromosomes a low site becomes high once in 15, a high one low once in 37."""
    p = m.Params(rho=0.3, eta=0.8, gamma=1.2, lam=0.004, theta=0.001, beta1=0.7, beta2=0.2, beta3=0.1)
    one = spark.createDataFrame([(c, 0.004, 0.001, 0.9, 0.05) for c in "LH"], "cls string, lambda double, theta double, x_maj double, x_min double")
    got = {r.cls: r for r in sites.counterfactuals(one, p, 2).collect()}
    t = 0.001 * sum(1 / k for k in range(1, 109))  # Watterson's sum of 109
    third = 0.004 / 3
    low = 0.7 * 0.7 * t / 3 * (0.1 * third + 0.9 * 0.996)
    high = 0.7 * 0.1 * t / 3 * (0.95 * third + 0.05 * 0.996)
    selected = 0.3 * 1.2 * t / 3 * 0.9 * (1 - 0.8 * 0.004)
    share = selected / (low + high + selected)
    assert abs(got["L"].xi_high - 1 / 15) < 1e-15 and abs(got["L"].xi_sel_low - 14 / 15 * share) < 1e-12
    assert abs(got["H"].xa_high - 36 / 37) < 1e-15 and abs(got["H"].xa_sel_low - share / 37) < 1e-12


def test_counterfactuals_keep_rows(spark):
    rows = [(i, c, None if i == 3 else 0.004, 0.001, 0.9, 0.05) for i, c in enumerate("MLHLLM")]
    df = spark.createDataFrame(rows, "i int, cls string, lambda double, theta double, x_maj double, x_min double")
    got = sites.counterfactuals(df, FITTED).orderBy("i").collect()
    assert [(r.i, r.cls) for r in got] == [(r[0], r[1]) for r in rows] and got[0].p_selected == got[5].p_selected


def test_posterior_grid(spark):
    rows = fit.coefficient_rows(patterns(spark), FITTED)
    prior = fit.prior_rows(spark, FITTED, PRIOR, 347.0)
    values = {"rho": grid.axis(1e-9, 1 - 1e-9, 4, [(0.35, 0.2)]), "eta": grid.axis(1e-9, 10 - 1e-9, 3, []), "gamma": grid.axis(1e-9, 10 - 1e-9, 3, [])}
    whole = grid.parameter_posterior(rows, prior, values).cache()
    assert whole.count() == math.prod(map(len, values.values()))
    s = whole.agg(F.sum(F.exp("log_prior")), F.sum(F.exp("log_post"))).first()
    assert abs(s[0] - 1) < 1e-9 and abs(s[1] - 1) < 1e-9
    r = whole.where("data_nll < 1e300").orderBy("cell").collect()[len(values["gamma"]) * 5 + 1]
    want = fit.evaluate(rows, {None: (r.rho, r.eta, r.gamma)})[0].nll
    assert abs(r.data_nll - want) < 1e-6 * abs(want)
    marginal = grid.marginals(whole)
    sums = marginal.groupBy("axis").agg(F.sum("post").alias("s")).collect()
    assert len(sums) == 3 and all(abs(x.s - 1) < 1e-9 for x in sums)
    assert all(0 <= x.x <= 10 for x in grid.quantiles(marginal, [0.025, 0.5, 0.975]).collect())


def test_axes_and_widths():
    made = grid.axes(replace(FITTED, eta=0.001), 10)
    assert all(v == sorted(set(v)) and v[0] >= 1e-9 for v in made.values())
    assert len(made["rho"]) > 20 and len(made["gamma"]) > 20
    assert abs(sum(grid.widths([0.0, 1.0, 3.0])) - 3.0) < 1e-12 and grid.widths([2.0]) == [1.0]


def test_quantile_of_an_even_marginal(spark):
    df = spark.createDataFrame([("a", float(x), 0.2) for x in range(5)], "axis string, value double, post double")
    got = {r.q: r.x for r in grid.quantiles(df, [0.5, 0.975]).collect()}
    # the distribution function at the values is 0, 0.3, 0.5, 0.7, 1: the first cell lies wholly above its value
    assert abs(got[0.5] - 2.0) < 1e-12 and abs(got[0.975] - (3 + 0.275 / 0.3)) < 1e-12


def test_numeric_functions(spark):
    df = spark.createDataFrame([(0.2, 0.5, 3.0), (0.0, 1.0, -2.0), (1.5, 0.3, 0.1)], "p double, q double, x double")
    r = df.select(num.binary_entropy(F.col("p")).alias("h"), num.clamp_probability(F.col("p")).alias("c"), num.erfc(F.col("x")).alias("e"), num.log_near_one(F.col("q")).alias("l")).collect()
    assert abs(r[0].h + 0.2 * math.log(0.2) + 0.8 * math.log(0.8)) < 1e-12 and r[1].h == 0 and r[2].h == 0
    assert [x.c for x in r] == [0.2, 0.0, num.TINY]
    assert all(abs(x.e - math.erfc(v)) < 1e-15 for x, v in zip(r, (3.0, -2.0, 0.1)))
    assert all(abs(x.l - math.log(v)) < 1e-12 for x, v in zip(r, (0.5, 1.0, 0.3)))
    logs = spark.createDataFrame([("a", -1000.0), ("a", -1001.0), ("b", 2.0)], "k string, v double")
    assert {x.k: round(x.lse, 9) for x in num.log_sum_exp(logs, "v", ["k"]).collect()} == {"a": round(-1000 + math.log(1 + math.exp(-1)), 9), "b": 2.0}
    assert abs(num.log_normalise(logs, "v").agg(F.sum(F.exp("v"))).first()[0] - 1) < 1e-12
    many = [x / 16 for x in range(-160, 480)] + [float("inf"), float("-inf")]
    made = spark.createDataFrame([(x,) for x in many], "x double").select("x", num.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(x.e - math.erfc(x.x)) < 1e-15 and (x.x < 3 or abs(x.e - math.erfc(x.x)) <= 1e-12 * math.erfc(x.x)) for x in made)
    assert math.isnan(spark.sql("SELECT double('NaN') AS x").select(num.erfc(F.col("x"))).first()[0]) and spark.sql("SELECT double(NULL) AS x").select(num.erfc(F.col("x"))).first()[0] is None
    assert spark.range(1).select(num.ordering_error(F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()[0] is None
    square = np.array([[2.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.5, 1.0, 4.0]])
    assert np.allclose(num.adjugate3(square), np.linalg.inv(square) * np.linalg.det(square)) and (num.adjugate3(np.zeros((3, 3))) == 0).all()
    assert num.watterson(4) == 1 + 1 / 2 + 1 / 3 and num.inverse3(np.zeros((3, 3))) is None


def test_strings(spark):
    r = spark.createDataFrame([("a,b,,c",)], "s string").select(st.tokenize(F.col("s"), ",").alias("t"), st.tail(F.col("s"), 2).alias("e"), st.erase_tail(F.col("s"), 4).alias("h"), st.delete_chars(F.col("s"), ",").alias("d")).first()
    assert (r.t, r.e, r.h, r.d) == (["a", "b", "", "c"], ",c", "a,", "abc")
    assert st.tokenize_quoted('one "two three" four') == ["one", "two three", "four"]
    n = spark.createDataFrame([(0.00001,), (12.5,), (0.0,)], "x double").select(st.fixed_or_scientific(F.col("x"), digits=2), st.thousands(F.col("x") * 1000, 9)).collect()
    assert [x[0] for x in n] == ["1.00e-05", "12.50", "0.00"] and n[1][1] == "   12,500"
