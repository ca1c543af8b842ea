"""SQL of the registered queries, in DuckDB's dialect, on the same tables.

Nothing here is computed by the code under test: constants and formulas stand as text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """The model that the queries use."""

    rho: float = 0.3
    eta: float = 0.8
    gamma: float = 1.2
    lam: float = 0.004
    theta: float = 0.0009
    beta1: float = 0.75
    beta2: float = 0.2
    beta3: float = 0.05
    alleles: int = 108


P = Params()
PRIOR_WEIGHT = 347.0
BITS_PER_NAT, TINY = 1.4426950408889634, 2.2250738585072014e-308
STATES = ("neut_nodiv", "neut_div", "neut_low", "neut_high", "sel_nodiv", "sel_div", "sel_low", "high")
#: Alleles that each cell of the class table stands for, and its priors of the major and minor allele.
CELLS = {"Ma": (1.0, 1, 0), "Mo": (3.0, 0, 0), "La": (3.0, 1, 0), "Li": (3.0, 0, 1), "Lo": (6.0, 0, 0), "Ha": (1.5, 1, 0), "Hi": (1.5, 0, 1), "Ho": (3.0, 0, 0)}


def watterson(n: int) -> float:
    total = 0.0
    for k in range(1, n):
        total += 1.0 / k
    return total

_DAYS = "date_diff('day', DATE '1990-01-01', {}::DATE)::BIGINT"
LOCI = f"""loci AS (SELECT (l_orderkey % 100)::VARCHAR AS chrom, {_DAYS.format('l_shipdate')} AS st,
  {_DAYS.format('l_shipdate')} + l_linenumber AS en, l_quantity::INT AS weight FROM lineitem)"""
BLOCKS = f"""blocks AS (SELECT (o_orderkey % 100)::VARCHAR AS chrom, {_DAYS.format('o_orderdate')} AS st,
  {_DAYS.format('o_orderdate')} + 1 + o_orderkey % 4 AS en, o_orderkey AS block_id FROM orders)"""
SITES = """sites AS (SELECT l_suppkey AS block_id, CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'N' THEN 'L' ELSE 'H' END AS cls,
  0.9::DOUBLE - 3.0::DOUBLE * l_discount AS x_maj, l_tax AS x_min, 0.003::DOUBLE + 0.0001::DOUBLE * l_linenumber AS lam,
  0.001::DOUBLE + 0.00001::DOUBLE * l_linenumber AS theta, l_quantity::BIGINT AS weight, 1::BIGINT AS len, l_discount, l_tax, l_linenumber FROM lineitem)"""


#: The model of the planted sites; their cells' shares, summed up, stand in the text.
PLANTED = Params(0.3, 1.0, 1.0, 0.06, 0.03)
PLANTED_SITES = """sites AS (SELECT left(cell, 1) AS cls, CASE right(cell, 1) WHEN 'a' THEN 1.0::DOUBLE - l_discount / 50 WHEN 'i' THEN 0.0::DOUBLE ELSE (l_tax + 0.01::DOUBLE) / 20 END AS x_maj,
  CASE right(cell, 1) WHEN 'a' THEN 0.0::DOUBLE WHEN 'i' THEN 1.0::DOUBLE - l_discount / 50 ELSE (l_tax + 0.01::DOUBLE) / 20 END AS x_min,
  0.048::DOUBLE + 0.003::DOUBLE * l_linenumber AS lam, 0.026::DOUBLE + 0.001::DOUBLE * l_linenumber AS theta, 1::BIGINT AS weight, 1::BIGINT AS len FROM (
  SELECT *, CASE WHEN u < 0.80186 THEN 'Ma' WHEN u < 0.85139 THEN 'Mo' WHEN u < 0.97219 THEN 'La' WHEN u < 0.97806 THEN 'Li' WHEN u < 0.98108 THEN 'Lo' WHEN u < 0.99016 THEN 'Ha' WHEN u < 0.99924 THEN 'Hi' ELSE 'Ho' END AS cell
  FROM (SELECT *, ((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey * 17) % 100003) / 100003.0::DOUBLE AS u FROM lineitem)))"""


def _num(x: float) -> str:
    return f"({x!r})::DOUBLE"


def _r(x: str, digits: int, name: str) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE AS {name}"


def _s0(cell: str, p: Params, t: str = "t") -> str:
    """A neutral cell's probability as SQL over lambda and ``t``."""
    lam, b1, b2, b3 = "lam", _num(p.beta1), _num(p.beta2), _num(p.beta3)
    return {
        "Ma": f"(1.0 - {lam}) * (1.0 - {t})",
        "Mo": f"(1.0 - {t}) * ({lam} / 3.0)",
        "La": f"((1.0 - {lam}) * {b1} + {lam} / 3.0 * {b3}) * ({t} / 3.0)",
        "Li": f"((1.0 - {lam}) * {b3} + {lam} / 3.0 * {b1}) * ({t} / 3.0)",
        "Lo": f"{lam} / 3.0 * ({b1} + {b3}) * ({t} / 3.0)",
        "Ha": f"(1.0 - 2.0 * ({lam} / 3.0)) * {b2} * ({t} / 3.0)",
        "Hi": f"(1.0 - 2.0 * ({lam} / 3.0)) * {b2} * ({t} / 3.0)",
        "Ho": f"2.0 * ({lam} / 3.0) * {b2} * ({t} / 3.0)",
        "Mi": "0.0::DOUBLE",
    }[cell]


def _s1(cell: str, p: Params, t: str = "t") -> str:
    eta, gam = _num(p.eta), _num(p.gamma)
    return {
        "Ma": f"(1.0 - {eta} * lam) * (1.0 - {gam} * {t})",
        "Mo": f"{eta} * (lam / 3.0)",
        "La": f"(1.0 - {eta} * lam) * {gam} * ({t} / 3.0)",
    }.get(cell, "0.0::DOUBLE")


def _coefficients(p: Params) -> str:
    a = _num(watterson(p.alleles))
    return f"""pat AS (SELECT cls, x_maj, x_min, lam, theta, theta * {a} AS t, sum(weight * len)::DOUBLE AS n FROM sites GROUP BY ALL),
cc AS (SELECT *, CASE cls WHEN 'M' THEN x_maj * {_s0('Ma', p)} + (1.0 - x_maj) * {_s0('Mo', p)}
  WHEN 'L' THEN x_maj * {_s0('La', p)} + x_min * {_s0('Li', p)} + (1.0 - x_maj - x_min) * {_s0('Lo', p)}
  ELSE (x_maj + x_min) * {_s0('Ha', p)} + (1.0 - x_maj - x_min) * {_s0('Ho', p)} END AS c FROM pat),
co AS (SELECT n, c, CASE WHEN cls = 'M' THEN x_maj - c ELSE -c END AS r,
  CASE WHEN cls = 'M' THEN (1.0 - x_maj) * lam / 3.0 - x_maj * lam ELSE 0.0::DOUBLE END AS e,
  CASE cls WHEN 'M' THEN -x_maj * t WHEN 'L' THEN x_maj * t / 3.0 ELSE 0.0::DOUBLE END AS g,
  CASE cls WHEN 'M' THEN x_maj * lam * t WHEN 'L' THEN -x_maj * lam * t / 3.0 ELSE 0.0::DOUBLE END AS k FROM cc)"""


def _likelihood(p: Params, names: dict[str, str], digits: int) -> str:
    rho, eta, gam = _num(p.rho), _num(p.eta), _num(p.gamma)
    made = ", ".join(_r(x, digits, n) for n, x in names.items())
    return f"""WITH {SITES}, {_coefficients(p)},
d AS (SELECT n, c + {rho} * (r + {eta} * e + {gam} * g + {eta} * {gam} * k) AS p, r + {eta} * e + {gam} * g + {eta} * {gam} * k AS d1,
  {rho} * (e + {gam} * k) AS d2, {rho} * (g + {eta} * k) AS d3, e + {gam} * k AS d12, g + {eta} * k AS d13, {rho} * k AS d23 FROM co)
SELECT {made} FROM d"""


def _posterior(p: Params, where: str = "pp", lam: str = "lam", t: str = "t", x_maj: str = "x_maj", x_min: str = "x_min", rho: str | None = None, cls: str | None = None) -> dict[str, str]:
    """Latent states' masses before division by their sum."""
    rho = rho or _num(p.rho)
    eta, gam, b1, b3 = _num(p.eta), _num(p.gamma), _num(p.beta1), _num(p.beta3)
    m = {
        "neut_nodiv": ("M", f"(1.0 - {rho}) * (1.0 - {t}) * {x_maj} * (1.0 - {lam})"),
        "neut_div": ("M", f"(1.0 - {rho}) * (1.0 - {t}) * (1.0 - {x_maj}) * ({lam} / 3.0)"),
        "neut_low": ("L", f"(1.0 - {rho}) * {b1} * {t} / 3.0 * ((1.0 - {x_maj}) * ({lam} / 3.0) + {x_maj} * (1.0 - {lam}))"),
        "neut_high": ("L", f"(1.0 - {rho}) * {b3} * {t} / 3.0 * ((1.0 - {x_min}) * ({lam} / 3.0) + {x_min} * (1.0 - {lam}))"),
        "sel_nodiv": ("M", f"{rho} * (1.0 - {gam} * {t}) * {x_maj} * (1.0 - {eta} * {lam})"),
        "sel_div": ("M", f"{rho} * (1.0 - {x_maj}) * {eta} * ({lam} / 3.0)"),
        "sel_low": ("L", f"{rho} * {gam} * {t} / 3.0 * {x_maj} * (1.0 - {eta} * {lam})"),
        "high": ("H", "1.0::DOUBLE"),
    }
    if cls is not None:
        return {s: (x if c == cls else "0.0::DOUBLE") for s, (c, x) in m.items()}
    return {s: f"CASE WHEN cls = '{c}' THEN {x} ELSE 0.0::DOUBLE END" for s, (c, x) in m.items()}


def _posterior_ctes(p: Params) -> str:
    a = _num(watterson(p.alleles))
    raw = _posterior(p)
    return f"""tt AS (SELECT *, theta * {a} AS t FROM sites),
raw AS (SELECT *, {', '.join(f'{x} AS w_{s}' for s, x in raw.items())} FROM tt),
pp AS (SELECT * EXCLUDE ({', '.join(f'w_{s}' for s in STATES)}), {', '.join(f"w_{s} / ({' + '.join(f'w_{z}' for z in STATES)}) AS {s}" for s in STATES)} FROM raw)"""


def _share(states: tuple[str, ...], masses: dict[str, str]) -> str:
    return f"(({' + '.join(masses[s] for s in states)}) / ({' + '.join(masses.values())}))"


def _counterfactual(p: Params, mode: int) -> str:
    from dataclasses import replace

    q = replace(p, alleles=p.alleles + 1)
    a = _num(watterson(q.alleles))
    # Posteriors are of 109 chromosomes; the odds of a change of class are of the 108 seen: 15 and 37.
    hi, lo = 1.0 / 15, 1.0 / 37
    post = lambda c, **k: _posterior(q, cls=c, **k)
    out = []
    for kind, states in (("selected", ("sel_nodiv", "sel_div", "sel_low")), ("high", ("high",))):
        mm, ll, hh = (_share(states, post(c)) for c in "MLH")
        new, neutral = _share(states, post("L", x_min="((1.0 - x_maj - x_min) / 3.0)")), _share(states, post("L", rho="0.0::DOUBLE"))
        low_i = ll if mode == 1 else f"({_num(1 - hi)} * {ll} + {_num(hi)} * {hh})"
        high_a = hh if mode == 1 else f"({_num(1 - lo)} * {hh} + {_num(lo)} * {ll})"
        out.append(_r(f"CASE cls WHEN 'M' THEN {mm} WHEN 'L' THEN {ll} ELSE {high_a} END", 8, f"xa_{kind}"))
        out.append(_r(f"CASE cls WHEN 'M' THEN NULL WHEN 'L' THEN {low_i} ELSE {hh} END", 8, f"xi_{kind}"))
        out.append(_r(f"CASE cls WHEN 'M' THEN {new} WHEN 'L' THEN {neutral} ELSE {hh} END", 8, f"xo_{kind}"))
    return f"WITH {SITES}, tt AS (SELECT *, theta * {a} AS t FROM sites) SELECT DISTINCT cls, l_discount, l_tax, l_linenumber, {', '.join(out)} FROM tt"


def _allele_joint(p: Params) -> str:
    a = _num(watterson(p.alleles))
    cases = {}
    for z in "aio":
        for s, f in ((0, _s0), (1, _s1)):
            by = []
            for c, other in (("M", 3.0), ("L", 2.0), ("H", 2.0)):
                w = _num(((1 - p.rho), p.rho)[s] * (other if z == "o" else 1.0))
                by.append(f"WHEN '{c}' THEN ({f(c + z, p)}) * {w}")
            cases[f"{z}{s}"] = f"CASE cls {' '.join(by)} END"
    total = " + ".join(f"w_{k}" for k in cases)
    return f"""WITH {SITES}, b AS (SELECT block_id, cls, min(lam) AS lam, min(theta) * {a} AS t FROM sites GROUP BY ALL),
w AS (SELECT block_id, cls, {', '.join(f'{x} AS w_{k}' for k, x in cases.items())} FROM b)
SELECT block_id, cls, {', '.join(_r(f'w_{k} / ({total})', 8, f'p_{k}') for k in cases)} FROM w"""


def _prior_coefficients(p: Params) -> str:
    """The pseudo-sites as coefficient rows, under pco."""
    own = _coefficients(p).split(",\ncc AS", 1)[1]
    return "pcc AS" + own.replace("FROM pat)", "FROM ppat)").replace("FROM cc)", "FROM pcc)").replace("co AS (", "pco AS (", 1)


def _fit_interior(p: Params) -> str:
    """Newton steps on the sums of gradient and Hessian, a step a row of the recursion; errors by the adjugate."""
    a, t, lam = _num(watterson(p.alleles)), _num(p.theta * watterson(p.alleles)), _num(p.lam)
    at = "(c + rho * (r + eta * e + gamma * q + eta * gamma * k))"
    one, two, three = "(r + eta * e + gamma * q + eta * gamma * k)", "(rho * (e + gamma * k))", "(rho * (q + eta * k))"
    pair = lambda x, y, own: f"sum(n * ({x} * {y} / ({at} * {at}) - ({own}) / {at}))"
    sums = f"""sum(-n * {one} / {at}) AS d1, sum(-n * {two} / {at}) AS d2, sum(-n * {three} / {at}) AS d3, {pair(one, one, '0.0')} AS h11, {pair(one, two, 'e + gamma * k')} AS h12,
    {pair(one, three, 'q + eta * k')} AS h13, {pair(two, two, '0.0')} AS h22, {pair(two, three, 'rho * k')} AS h23, {pair(three, three, '0.0')} AS h33"""
    adjugate = {"11": "h22 * h33 - h23 * h23", "12": "h13 * h23 - h12 * h33", "13": "h12 * h23 - h13 * h22", "22": "h11 * h33 - h13 * h13", "23": "h12 * h13 - h11 * h23", "33": "h11 * h22 - h12 * h12"}
    det = f"(h11 * ({adjugate['11']}) + h12 * ({adjugate['12']}) + h13 * ({adjugate['13']}))"
    step = lambda i: " + ".join(f"({adjugate[''.join(sorted(f'{i}{j}'))]}) * d{j}" for j in (1, 2, 3))
    v = ", ".join(f"({x}) / {det} AS v{k}" for k, x in adjugate.items())
    root = lambda x, y, z: f"sqrt({x} * {x} * v11 + {y} * {y} * v22 + {z} * {z} * v33 + 2 * ({x} * {y} * v12 + {x} * {z} * v13 + {y} * {z} * v23))"
    shown = {"rho": "rho", "eta": "eta", "gamma": "gamma", "rho_err": "sqrt(v11)", "eta_err": "sqrt(v22)", "gamma_err": "sqrt(v33)", "dp": "dp", "pw": "pw", "alpha": "alpha", "tau": "tau"}
    shown |= {"dp_err": f"dp * {root('(1 / rho)', '(1 / eta)', '0.0')}", "pw_err": f"pw * {root('(1 / rho)', f'(-{lam} / (1 - eta * {lam}))', '(1 / gamma)')}"}
    shown |= {"alpha_err": f"alpha * alpha * {root('(1 / (rho * rho * eta))', '((1 - rho) / (rho * eta * eta))', '0.0')}", "tau_err": f"tau * tau * {root('(1 / (rho * rho * gamma))', '0.0', '((1 - rho) / (rho * gamma * gamma))')}"}
    shown |= {"nll": "nll", "nll_prior": "nll_prior"}
    return f"""WITH RECURSIVE {PLANTED_SITES}, {_coefficients(p)}, ppat AS (SELECT *, theta * {a} AS t FROM ({_pseudo(p)}) v), {_prior_coefficients(p)},
al AS (SELECT n, c, r, e, g AS q, k FROM co UNION ALL SELECT n, c, r, e, g, k FROM pco WHERE n > 0),
it AS (SELECT 0 AS i, 0.4::DOUBLE AS rho, 0.8::DOUBLE AS eta, 0.9::DOUBLE AS gamma UNION ALL
  SELECT i + 1, rho - ({step(1)}) / {det}, eta - ({step(2)}) / {det}, gamma - ({step(3)}) / {det} FROM (SELECT i, rho, eta, gamma, {sums} FROM it, al WHERE i < 25 GROUP BY i, rho, eta, gamma)),
f AS (SELECT rho, eta, gamma FROM it WHERE i = 25), h AS (SELECT rho, eta, gamma, sum(-n * ln({at})) AS nll_prior, {sums} FROM f, al GROUP BY ALL),
o AS (SELECT sum(-n * ln({at})) AS nll FROM f, (SELECT n, c, r, e, g AS q, k FROM co)),
x AS (SELECT *, {v}, 1000 * rho * eta * {lam} AS dp, 1000 * rho * gamma * {t} * (1 - eta * {lam}) AS pw, 1 / (1 + (1 - rho) / (rho * eta)) AS alpha, 1 / (1 + (1 - rho) / (rho * gamma)) AS tau FROM h, o)
SELECT {', '.join(_r(y, 3 if k[:2] in ('dp', 'pw', 'nl') else 5, k) for k, y in shown.items())}, greatest(abs(d1), abs(d2), abs(d3)) < 0.001 AND h11 > 0 AND {det} > 0 AS converged FROM x"""


def _pseudo(p: Params) -> str:
    """The prior's pseudo-sites: cls, x_maj, x_min, lam, theta and n."""
    t = _num(p.theta * watterson(p.alleles))
    rows = []
    for cell, (alleles, maj, minor) in CELLS.items():
        n = f"{_num(PRIOR_WEIGHT * alleles)} * ({_num(p.rho)} * ({_s1(cell, p, t)}) + {_num(1 - p.rho)} * ({_s0(cell, p, t)}))"
        rows.append(f"SELECT '{cell[0]}' AS cls, {maj}.0::DOUBLE AS x_maj, {minor}.0::DOUBLE AS x_min, lam, {_num(p.theta)} AS theta, {n} AS n FROM (SELECT {_num(p.lam)} AS lam)")
    return " UNION ALL ".join(rows)


def _axis(low: float, high: float, steps: int, focus: tuple[float, float] | None = None) -> str:
    """Evenly spaced values, and as many around a focus (centre, width), with their widths."""
    line = lambda lo, hi: f"SELECT CASE WHEN i = {steps} THEN {_num(hi)} ELSE i * ({_num((hi - lo) / steps)}) + {_num(lo)} END AS v FROM range({steps + 1}) r(i)"
    parts = line(low, high) + (f" UNION {line(focus[0] - focus[1] / 2, focus[0] + focus[1] / 2)}" if focus else "")
    near = "lag(v) OVER (ORDER BY v)", "lead(v) OVER (ORDER BY v)"
    return f"SELECT v, CASE WHEN {near[0]} IS NULL THEN ({near[1]} - v) / 2 WHEN {near[1]} IS NULL THEN (v - {near[0]}) / 2 ELSE ({near[1]} - {near[0]}) / 2 END AS w FROM ({parts})"


def _grid(p: Params, sites: str | None = None, axes: tuple[str, str, str] | None = None, scale: float = 1.0) -> str:
    """The posterior's cells: rho, eta, gamma, widths, data_nll, prior_nll, log_prior, log_post.

    A site and a pseudo-site count ``scale`` times.
    """
    edge, top = 1e-9, 10 - 1e-9
    axes = axes or (_axis(edge, 1 - 1e-9, 6, (0.3, 0.2)), _axis(edge, top, 5), _axis(edge, top, 5))
    cell = "CASE WHEN {0} < 0 OR {0} > 1 THEN " + _num(TINY) + " ELSE {0} END"
    prob = "(c + g.rho * (r + g.eta * e + g.gamma * q + g.eta * g.gamma * k))"
    prior = _prior_coefficients(p)
    a = _num(watterson(p.alleles))
    return f"""{sites or SITES}, {_coefficients(p)}, ppat AS (SELECT *, theta * {a} AS t FROM ({_pseudo(p)}) v), {prior},
rr AS ({axes[0]}), ee AS ({axes[1]}), gg AS ({axes[2]}),
g AS (SELECT rr.v AS rho, ee.v AS eta, gg.v AS gamma, rr.w AS d_rho, ee.w AS d_eta, gg.w AS d_gamma, ln(rr.w) + ln(ee.w) + ln(gg.w) AS log_size FROM rr, ee, gg),
dn AS (SELECT rho, eta, gamma, {scale!r} * sum(-n * ln({cell.format(prob)})) AS data_nll FROM g, (SELECT n, c, r, e, g AS q, k FROM co) x GROUP BY ALL),
pn AS (SELECT rho, eta, gamma, {scale!r} * sum(-n * ln({cell.format(prob)})) AS prior_nll FROM g, (SELECT n, c, r, e, g AS q, k FROM pco WHERE n > 0) x GROUP BY ALL),
u AS (SELECT *, log_size - prior_nll AS lp FROM g JOIN dn USING (rho, eta, gamma) JOIN pn USING (rho, eta, gamma)),
v AS (SELECT *, lp - (SELECT max(lp) FROM u) - ln((SELECT sum(exp(lp - m)) FROM u, (SELECT max(lp) AS m FROM u))) AS log_prior FROM u),
w AS (SELECT *, log_prior - data_nll AS lq FROM v),
z AS (SELECT *, lq - (SELECT max(lq) FROM w) - ln((SELECT sum(exp(lq - m)) FROM w, (SELECT max(lq) AS m FROM w))) AS log_post FROM w)"""


def _erfc(x: str) -> str:
    """Series below 3, continued fraction above."""
    down = lambda n: f"list_transform(range({n}, 0, -1), lambda i: i::DOUBLE)"
    a = f"abs({x})"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, {down(80)}), lambda s, n: 1.0 + s * (2.0 * {a} * {a}) / (2.0 * n + 1.0))"
    far = f"greatest({a}, 3.0::DOUBLE)"
    fraction = f"list_reduce(list_prepend({far}, {down(60)}), lambda s, n: {far} + n / 2.0 / s)"
    right = f"(CASE WHEN {a} < 3.0 THEN 1.0 - 2.0 * {a} * exp(-{a} * {a}) / sqrt(pi()) * {series} ELSE exp(-{a} * {a}) / sqrt(pi()) / {fraction} END)"
    return f"(CASE WHEN {x} < 0 THEN 2.0 - {right} ELSE {right} END)"


TAGS = """tags AS (SELECT p_partkey, (p_size % 6)::BIGINT AS d_size, (right(p_brand, 1)::INT % 6)::BIGINT AS d_brand, (length(p_type) % 4)::BIGINT AS d_kind FROM part),
bits AS (SELECT *, (1::BIGINT << d_size::INT) AS ann, ((1::BIGINT << (d_brand + 4)::INT) | (1::BIGINT << d_kind::INT)) AS cts FROM tags)"""

CELLS_SQL = """cells AS (SELECT c_mktsegment AS cov, c_nationkey AS value, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS k
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def _h(p: str) -> str:
    term = lambda x: f"CASE WHEN {x} > 0 AND {x} < 1 THEN -({x}) * ln({x}) ELSE 0.0 END"
    return f"({term(p)} + {term(f'(1.0 - {p})')})"


SPLITS = f"""{CELLS_SQL},
o AS (SELECT *, sum(n) OVER w AS n_set, sum(k) OVER w AS k_set, sum(n) OVER (PARTITION BY cov) AS nn, sum(k) OVER (PARTITION BY cov) AS kk FROM cells
  WINDOW w AS (PARTITION BY cov ORDER BY k / n, value ROWS UNBOUNDED PRECEDING)),
s AS (SELECT cov, value, n_set::DOUBLE AS n_set, (nn - n_set)::DOUBLE AS n_cos, k_set / n_set AS rho_set, (kk - k_set) / (nn - n_set) AS rho_cos FROM o WHERE nn > n_set),
f AS (SELECT *, (n_set * rho_set + n_cos * rho_cos) / (n_set + n_cos) AS rho FROM s),
g AS (SELECT *, (n_set + n_cos) * {_h('rho')} - n_set * {_h('rho_set')} - n_cos * {_h('rho_cos')} AS gain FROM f)"""

RUNS = """runs AS (SELECT user_id % 8 AS cell, (epoch(date_trunc('second', ts))::BIGINT - 1704067200) // 3600 AS st, max(length(event_type)) AS k FROM events GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    p, made = P, {}
    made["overlap_join"] = f"""WITH {LOCI}, {BLOCKS} SELECT block_id, count(*) AS n, sum(least(l.en, b.en) - greatest(l.st, b.st))::BIGINT AS shared,
  sum((least(l.en, b.en) - greatest(l.st, b.st)) * weight)::BIGINT AS weighted FROM loci l JOIN blocks b ON l.chrom = b.chrom AND l.st < b.en AND b.st < l.en WHERE l.st < l.en GROUP BY ALL"""
    made["mixed_lengths"] = f"""WITH l AS (SELECT (l_orderkey % 100)::VARCHAR AS chrom, {_DAYS.format('l_shipdate')} AS st, {_DAYS.format('l_shipdate')} + l_linenumber * CASE WHEN l_partkey % 10 = 0 THEN 400 ELSE 1 END AS en, l_quantity::INT AS weight FROM lineitem),
b AS (SELECT (o_orderkey % 100)::VARCHAR AS chrom, {_DAYS.format('o_orderdate')} AS st, {_DAYS.format('o_orderdate')} + 1 + o_orderkey % 4 + CASE WHEN o_orderkey % 7 = 0 THEN 90 ELSE 0 END AS en, o_orderkey AS block_id FROM orders)
SELECT block_id, count(*) AS n, sum(least(l.en, b.en) - greatest(l.st, b.st))::BIGINT AS shared, sum((least(l.en, b.en) - greatest(l.st, b.st)) * weight)::BIGINT AS weighted
FROM l JOIN b ON l.chrom = b.chrom AND l.st < b.en AND b.st < l.en GROUP BY ALL"""
    made["overlap_clip"] = f"WITH {LOCI} SELECT chrom, count(*) AS n, sum(least(en, 3500) - greatest(st, 2500))::BIGINT AS positions FROM loci WHERE greatest(st, 2500) < least(en, 3500) GROUP BY ALL"
    made["interval_advance"] = f"WITH {LOCI}, a AS (SELECT chrom, least(greatest(st, 3000), en) AS st, en FROM loci) SELECT chrom, count(*) FILTER (WHERE st < en) AS left_over, sum(en - st)::BIGINT AS positions FROM a GROUP BY ALL"
    made["interval_compare"] = f"""WITH {BLOCKS}, l AS (SELECT l_orderkey AS block_id, {_DAYS.format('l_shipdate')} AS st, {_DAYS.format('l_shipdate')} + l_linenumber AS en FROM lineitem)
SELECT chrom, CASE WHEN l.en <= b.st THEN -1 WHEN l.st < b.en AND b.st < l.en THEN 0 ELSE 1 END AS side, count(*) AS n FROM l JOIN blocks b USING (block_id) GROUP BY ALL"""
    made["point_in_block"] = "SELECT event_type AS chrom, epoch(ts)::BIGINT // 21600 AS number, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, date_trunc('second', ts) AS ts, value FROM events) GROUP BY ALL"
    made["neutral_semi"] = f"WITH {LOCI}, {BLOCKS} SELECT block_id, EXISTS (SELECT 1 FROM loci l WHERE l.chrom = b.chrom AND l.st < b.en AND b.st < l.en AND l.st < l.en) AS hit FROM blocks b"
    made["interval_positions"] = f"WITH {LOCI}, q AS (SELECT chrom, unnest(range(st, en)) AS pos FROM loci) SELECT chrom, pos, count(*) AS depth FROM q GROUP BY ALL"
    made["linear_positions"] = f"""WITH {LOCI}, g AS (SELECT chrom, max(en) AS n FROM loci GROUP BY ALL), o AS (SELECT chrom, coalesce(sum(n) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM g)
SELECT chrom, sum(off + st)::BIGINT AS linear, count(*) AS same FROM loci JOIN o USING (chrom) GROUP BY ALL"""
    made["pattern_counts"] = f"WITH {SITES} SELECT block_id, cls, l_discount, l_tax, sum(weight * len)::BIGINT AS n FROM sites GROUP BY ALL"
    made["pattern_expand"] = f"WITH {SITES} SELECT cls, l_discount, sum(weight * len)::BIGINT AS n FROM sites GROUP BY ALL"
    counters = ", ".join(f"sum(CASE WHEN cls = '{c}' THEN len ELSE 0 END)::BIGINT AS {c.lower()}_raw, sum(CASE WHEN cls = '{c}' THEN len * weight ELSE 0 END)::BIGINT AS {c.lower()}_weighted" for c in "MLH")
    made["site_counters"] = f"WITH {SITES} SELECT {counters} FROM sites"
    made["interval_stats"] = f"WITH {LOCI} SELECT count(*) AS loci, sum(en - st)::BIGINT AS positions, sum((en - st) * weight)::BIGINT AS weighted FROM loci"
    made["pattern_totals"] = f"WITH {SITES}, q AS (SELECT cls, l_discount, l_tax, sum(weight * len) AS n FROM sites GROUP BY ALL) SELECT cls, count(*) AS patterns, sum(n)::BIGINT AS sites FROM q GROUP BY ALL"
    made["shrunk_mean"] = f"SELECT l_suppkey, {_r('(sum(l_quantity * l_discount) * 0.02::DOUBLE + 347.0::DOUBLE * 0.05::DOUBLE) / (sum(l_quantity) * 0.02::DOUBLE + 347.0::DOUBLE)', 6, 'mean')} FROM lineitem GROUP BY ALL"
    ratio = "(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) + 347.0::DOUBLE * 0.2::DOUBLE) / (sum(l_quantity) + 347.0::DOUBLE)"
    made["ratio_pseudocount"] = f"SELECT l_suppkey, {_r(ratio, 6, 'ratio')} FROM lineitem GROUP BY ALL"
    made["class_matrix"] = f"WITH {SITES} SELECT cls, {_r('sum(weight * x_maj)', 2, 'maj')}, {_r('sum(weight * x_min)', 2, 'min')}, {_r('sum(weight * (1.0 - x_maj - x_min))', 2, 'oth')} FROM sites GROUP BY cls"
    made["block_normalised_matrix"] = f"""WITH {SITES}, q AS (SELECT *, count(*) OVER (PARTITION BY block_id) AS total FROM sites)
SELECT cls, {_r('sum(x_maj / total)', 5, 'maj')}, {_r('sum(x_min / total)', 5, 'min')}, {_r('sum((1.0 - x_maj - x_min) / total)', 5, 'oth')} FROM q GROUP BY cls"""
    made["coalesce_runs"] = """WITH d AS (SELECT user_id AS chrom, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS st, least(count(*), 3) AS n FROM events GROUP BY ALL),
i AS (SELECT *, st - row_number() OVER (PARTITION BY chrom, n ORDER BY st) AS island FROM d)
SELECT chrom, min(st) AS st, max(st) + 1 AS en, n FROM i GROUP BY chrom, n, island"""
    made["breakpoint_segments"] = f"""WITH {RUNS}, b AS (SELECT DISTINCT cell::VARCHAR AS chrom, unnest([st, st + k]) AS st FROM runs), s AS (SELECT chrom, st, lead(st) OVER (PARTITION BY chrom ORDER BY st) AS en FROM b)
SELECT chrom, st, en FROM s WHERE en IS NOT NULL"""
    made["asof_state"] = """WITH q AS (SELECT *, event_type = (SELECT min(event_type) FROM events) AS own FROM events)
SELECT event_id, last_value(CASE WHEN own THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM q"""
    made["aligned_counts"] = f"""WITH {RUNS}, c AS (SELECT * FROM (SELECT cell, st, coalesce(lead(st) OVER (PARTITION BY cell ORDER BY st), (SELECT max(st) + 1 FROM runs)) AS en, 1::BIGINT << (k % 8)::INT AS tagb FROM runs) WHERE st < en),
a AS (SELECT i * 100 AS st, (i + 1) * 100 AS en, 1::BIGINT << (i % 2)::INT AS tagb FROM range((SELECT (max(st) + 100) // 100 FROM runs)) t(i)),
h AS (SELECT i::BIGINT AS st FROM range((SELECT max(st) + 1 FROM runs)) t(i)),
t AS (SELECT * FROM (VALUES ('even', 1, 85), ('odd', 2, 170), ('all', 3, 255)) v(subset_id, ma, mc)),
n AS (SELECT subset_id, h.st, count(*) AS n FROM h JOIN a ON h.st >= a.st AND h.st < a.en JOIN c ON h.st >= c.st AND h.st < c.en JOIN t ON (a.tagb & ma) = a.tagb AND (c.tagb & mc) = c.tagb GROUP BY ALL),
i AS (SELECT *, st - row_number() OVER (PARTITION BY subset_id, n ORDER BY st) AS island FROM n)
SELECT subset_id, min(st) AS st, max(st) + 1 AS en, n FROM i GROUP BY subset_id, n, island"""
    made["onehot_encode"] = f"WITH {TAGS} SELECT p_partkey, ann, cts, d_brand::VARCHAR || d_kind::VARCHAR AS back FROM bits"
    made["mask_filter"] = f"WITH {TAGS} SELECT p_partkey FROM bits WHERE d_size IN (1, 2, 3) AND d_brand IN (1, 2) AND d_kind IN (0, 1)"
    made["mask_targets"] = f"""WITH {TAGS}, u AS (SELECT 'size' || d_size AS subset_id FROM bits WHERE d_size > 0 UNION ALL SELECT 'brand' || d_brand FROM bits WHERE d_brand > 0 UNION ALL SELECT 'kind' || d_kind FROM bits WHERE d_kind > 0)
SELECT subset_id, count(*) AS n FROM u GROUP BY ALL"""
    made["mask_accumulate"] = f"WITH {TAGS} SELECT d_size::VARCHAR AS ann_tags, bit_or(cts) AS mask FROM bits GROUP BY ALL"
    made["logsumexp"] = f"WITH q AS (SELECT p_brand, -p_retailprice / 10.0::DOUBLE AS x FROM part), t AS (SELECT p_brand, max(x) AS m FROM q GROUP BY ALL) SELECT p_brand, {_r('any_value(m) + ln(sum(exp(x - m)))', 6, 'lse')} FROM q JOIN t USING (p_brand) GROUP BY p_brand"
    made["log_normalise"] = f"WITH q AS (SELECT p_partkey, p_brand, -p_retailprice / 10.0::DOUBLE AS x FROM part), t AS (SELECT p_brand, max(x) AS m FROM q GROUP BY ALL), l AS (SELECT p_brand, any_value(m) + ln(sum(exp(x - m))) AS lse FROM q JOIN t USING (p_brand) GROUP BY p_brand) SELECT p_partkey, {_r('x - lse', 6, 'x')} FROM q JOIN l USING (p_brand)"
    one = "SELECT '{0}' AS axis, {1} AS value, round(sum(l_quantity), 2) + 0.0::DOUBLE AS prior, round(count(*)::DOUBLE, 2) + 0.0::DOUBLE AS post FROM lineitem GROUP BY 2"
    made["grid_marginals"] = " UNION ALL ".join(one.format(*x) for x in (("rho", "l_discount"), ("eta", "l_tax"), ("gamma", "l_linenumber::DOUBLE")))
    made["weighted_expectation"] = f"SELECT l_returnflag, {_r('sum(l_discount * l_quantity) / sum(l_quantity)', 8, 'expectation')} FROM lineitem GROUP BY ALL"
    made["interp_quantile"] = f"""WITH q AS (SELECT l_returnflag, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS m FROM q),
a AS (SELECT *, lag(x) OVER w AS lo, lead(x) OVER w AS hi, lag(m) OVER w AS pm FROM m WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)),
b AS (SELECT *, CASE WHEN lo IS NULL THEN 0.0 WHEN hi IS NULL THEN 1.0 ELSE (x - lo) / (hi - lo) END AS nx FROM a),
c AS (SELECT *, CASE WHEN lo IS NULL THEN 0.0 ELSE (1.0 - lag(nx) OVER w) * pm + nx * m END AS gain FROM b WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)),
d AS (SELECT *, CASE WHEN hi IS NULL THEN 1.0 ELSE sum(gain) OVER (PARTITION BY l_returnflag ORDER BY x ROWS UNBOUNDED PRECEDING) END AS f FROM c),
e AS (SELECT *, lag(f) OVER (PARTITION BY l_returnflag ORDER BY x) AS pf FROM d),
g AS (SELECT l_returnflag, q.q, arg_min(lo, x) AS lo, arg_min(f, x) AS f, arg_min(pf, x) AS pf, min(x) AS x FROM e, (VALUES (0.025::DOUBLE), (0.5::DOUBLE), (0.975::DOUBLE)) q(q) WHERE lo IS NOT NULL AND f >= q.q GROUP BY ALL)
SELECT l_returnflag, q, {_r('lo + (q - pf) / (f - pf) * (x - lo)', 6, 'x')} FROM g"""
    made["mixture_nll"] = _likelihood(p, {"nll": "sum(-n * ln(p))"}, 2)
    made["mixture_gradient"] = _likelihood(p, {f"d_{a}": f"sum(-n * d{i} / p)" for i, a in enumerate(("rho", "eta", "gamma"), 1)}, 2)
    hess = {"h_rho_rho": "d1 * d1 / (p * p)", "h_rho_eta": "d1 * d2 / (p * p) - d12 / p", "h_rho_gamma": "d1 * d3 / (p * p) - d13 / p", "h_eta_eta": "d2 * d2 / (p * p)", "h_eta_gamma": "d2 * d3 / (p * p) - d23 / p", "h_gamma_gamma": "d3 * d3 / (p * p)"}
    made["mixture_hessian"] = _likelihood(p, {k: f"sum(n * ({x}))" for k, x in hess.items()}, 1)
    made["coefficient_projection"] = f"WITH {SITES}, {_coefficients(p)} SELECT {', '.join(_r(f'sum({k} * n)', 3, k) for k in 'cregk')}, {_r('sum(n)', 3, 'n')} FROM co"
    made["prior_pseudo_rows"] = f"SELECT cls, x_maj, x_min, {_r('n', 6, 'n')}, (SELECT count(*) FROM lineitem) AS rows FROM ({_pseudo(p)}) v"
    mean = "(sum(weight * {0}) * 0.02::DOUBLE + 347.0::DOUBLE * {1}) / (sum(weight) * 0.02::DOUBLE + 347.0::DOUBLE)"
    made["lambda_theta"] = f"WITH {SITES} SELECT {_r(mean.format('lam', _num(p.lam)), 8, 'lam')}, {_r(mean.format('theta', _num(p.theta)), 9, 'theta')} FROM sites"
    made["beta2_ratio"] = f"WITH {SITES} SELECT {_r('(sum(CASE WHEN cls = $$H$$ THEN weight ELSE 0 END) + 347.0::DOUBLE * 0.2::DOUBLE) / (sum(weight) + 347.0::DOUBLE)', 8, 'beta2')} FROM sites WHERE cls IN ('L', 'H')"
    made["site_posterior"] = f"WITH {SITES}, {_posterior_ctes(p)} SELECT DISTINCT cls, l_discount, l_tax, l_linenumber, {', '.join(_r(s, 8, s) for s in STATES)}, {_r('sel_nodiv + sel_div + sel_low', 8, 'p_selected')} FROM pp"
    made["posterior_sum"] = f"WITH {SITES}, {_posterior_ctes(p)} SELECT cls, {', '.join(_r(f'sum({s} * weight) / sum(weight)', 6, s) for s in STATES)} FROM pp GROUP BY cls"
    made["allele_joint"] = _allele_joint(p)
    made["counterfactual_m1"], made["counterfactual_m2"] = _counterfactual(p, 1), _counterfactual(p, 2)
    made["ordered_prefix_splits"] = f"""WITH {CELLS_SQL}, o AS (SELECT cov, value, list(value) OVER (PARTITION BY cov ORDER BY k / n, value ROWS UNBOUNDED PRECEDING) AS a,
  list(value) OVER (PARTITION BY cov ORDER BY k / n, value ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM cells)
SELECT cov, value, array_to_string(list_sort(a), ',') AS set_values, array_to_string(list_sort(b), ',') AS coset_values FROM o WHERE len(b) > 0"""
    made["binary_entropy_gain"] = f"WITH {SPLITS} SELECT cov, value, {_r('gain', 6, 'gain_nats')}, {_r(f'gain * {_num(BITS_PER_NAT)}', 6, 'gain_bits')}, {_r(f'gain * {_num(BITS_PER_NAT)}', 6, 'entropy_bits')} FROM g"
    made["best_split_per_covariate"] = f"""WITH {SPLITS}, k AS (SELECT *, row_number() OVER (PARTITION BY cov ORDER BY (least(n_set, n_cos) >= 10) DESC, gain DESC, value) AS rc,
  row_number() OVER (ORDER BY (least(n_set, n_cos) >= 10) DESC, gain DESC, cov, value) AS rank FROM g) SELECT cov, value, {_r('gain', 6, 'gain_nats')}, rank FROM k WHERE rc = 1"""
    made["qc_min_positions"] = f"WITH {SPLITS} SELECT cov, value, least(n_set, n_cos) >= 200 AS passes FROM g"
    made["value_summary"] = f"""WITH {CELLS_SQL}, q AS (SELECT cov, n, k / n AS rho FROM cells), t AS (SELECT cov, sum(n)::BIGINT AS positions, sum(n * {_h('rho')}) * {_num(BITS_PER_NAT)} AS cb, sum(n * rho) / sum(n) AS r FROM q GROUP BY cov)
SELECT cov, positions, {_r('cb', 5, 'conditional_bits')}, {_r('r', 5, 'rho')}, {_r(f"positions * {_h('r')} * {_num(BITS_PER_NAT)}", 5, 'unconditional_bits')} FROM t"""
    made["text_functions"] = "SELECT p_partkey, len(string_split(p_name, ' '))::INT AS pieces, replace(p_brand, '#', '') AS bare, right(p_type, 3) AS ending, left(p_type, greatest(length(p_type) - 2, 0)) AS erased, reverse(p_brand) AS reversed, upper(p_name) AS upper_name FROM part"
    made["number_formats"] = "SELECT p_partkey, printf('%.3f', p_retailprice) AS fixed, format('{:,}', floor(p_retailprice)::BIGINT) AS grouped FROM part"
    rho = "((100.0 * a.value + 50.0 * b.value) / 150.0)"
    gain = f"(150.0 * {_h(rho)} - 100.0 * {_h('a.value')} - 50.0 * {_h('b.value')}) * {_num(BITS_PER_NAT)}"
    made["expected_information"] = f"""WITH a AS (SELECT l_discount * 5.0::DOUBLE + 0.2::DOUBLE AS value, sum(l_quantity) AS w FROM lineitem GROUP BY 1), b AS (SELECT l_tax * 5.0::DOUBLE + 0.2::DOUBLE AS value, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
g AS (SELECT a.w * b.w AS w, a.value > b.value AS ord, {gain} AS gain FROM a, b) SELECT {_r('sum(w * gain) / sum(w)', 6, 'total')}, {_r('sum(CASE WHEN ord THEN w * gain ELSE 0 END) / sum(w)', 6, 'ordered')} FROM g"""
    term = "CASE WHEN p > 0 AND p < 1 THEN -p * ln(p) ELSE 0.0 END"
    parts = {"term": term, "bits": f"{_h('p')} * {_num(BITS_PER_NAT)}", "fraction": "p / (1.0 + p)", "clamped": f"CASE WHEN p * 2.0 > 1 THEN {_num(TINY)} ELSE p * 2.0 END", "bell": "exp(-((p / 0.5) ** 2))", "log": "ln(p + 0.1::DOUBLE)"}
    made["numeric_functions"] = f"WITH q AS (SELECT DISTINCT l_discount, l_discount * 9.0::DOUBLE AS p FROM lineitem) SELECT l_discount, {', '.join(_r(x, 9, k) for k, x in parts.items())} FROM q"
    made["coverage_gaps"] = "WITH d AS (SELECT user_id AS chrom, count(DISTINCT ts::DATE) AS covered FROM events GROUP BY 1) SELECT chrom, covered FROM d WHERE covered < (SELECT date_diff('day', DATE '2024-01-01', max(ts)::DATE) + 1 FROM events)"
    err = lambda s: f"sqrt(rho_{s} * (1.0 - rho_{s}) / n_{s})"
    made["ordering_error"] = f"""WITH {SPLITS}, q AS (SELECT *, {err('set')} AS es, {err('cos')} AS ec FROM g), h AS (SELECT cov, value, greatest(rho_set, rho_cos) AS hi, least(rho_set, rho_cos) AS lo,
  CASE WHEN rho_set >= rho_cos THEN es ELSE ec END AS eh, CASE WHEN rho_set >= rho_cos THEN ec ELSE es END AS el, count(*) OVER () AS tests FROM q),
i AS (SELECT *, (hi - lo) / sqrt(eh * eh + el * el) AS z1, (hi - (hi + lo) / 2) / eh AS z2, ((hi + lo) / 2 - lo) / el AS z3 FROM h),
j AS (SELECT *, {_erfc('z1')} / 2 AS p1, greatest({_erfc('z2')} / 2, {_erfc('z3')} / 2) AS p2 FROM i)
SELECT cov, value, {_r('p1', 8, 'p1')}, {_r('p2', 8, 'p2')}, p1 * tests <= 0.05 AND p2 * tests <= 0.2 AS passes FROM j"""
    # The maximum by bisection of the derivative, which falls in b.
    b2 = f"((SELECT sum(weight) FROM sites WHERE cls = 'H') + {_num(PRIOR_WEIGHT * p.beta2)}) / ((SELECT sum(weight) FROM sites WHERE cls IN ('L', 'H')) + {_num(PRIOR_WEIGHT)})"
    mi, ma = "(x_min * (1.0 - lam) + x_maj * lam / 3.0)", "(x_maj * (1.0 - lam) + x_min * lam / 3.0)"
    known = p.beta1 + p.beta3
    pseudo = f"SELECT 1.0::DOUBLE AS x_maj, 0.0::DOUBLE AS x_min, {_num(p.lam)} AS lam, {_num(PRIOR_WEIGHT * p.beta1 / known)} AS n UNION ALL SELECT 0.0, 1.0, {_num(p.lam)}, {_num(PRIOR_WEIGHT * p.beta3 / known)}"
    made["fit_beta3"] = f"""WITH RECURSIVE {SITES}, b AS (SELECT {b2} AS b2),
x AS (SELECT x_maj, x_min, lam, sum(weight)::DOUBLE AS n FROM sites WHERE cls = 'L' GROUP BY ALL UNION ALL SELECT * FROM ({pseudo})),
ab AS (SELECT {mi} - {ma} AS a, {ma} * (1.0 - b2) AS c, n FROM x, b),
it AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0 - b2 AS hi FROM b UNION ALL
  SELECT i + 1, CASE WHEN d > 0 THEN m ELSE lo END, CASE WHEN d > 0 THEN hi ELSE m END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, sum(n * a / (a * (lo + hi) / 2 + c)) AS d FROM it, ab WHERE i < 60 GROUP BY i, lo, hi))
SELECT round(1.0 - b2 - lo, 7) AS beta1, round(b2, 7) AS beta2, round(lo, 7) AS beta3 FROM it, b WHERE i = 60"""
    made["beta3_interior"] = made["fit_beta3"].replace(SITES, PLANTED_SITES).replace(_num(p.lam), _num(PLANTED.lam))
    made["fit_interior"] = _fit_interior(PLANTED)
    # At the limits eta = 0 and gamma = 600 rho is found by bisection; the other two derivatives must point out of the limits.
    own = _coefficients(p).split(",\ncc AS", 1)[1]
    prior = "pcc AS" + own.replace("FROM pat)", "FROM ppat)").replace("FROM cc)", "FROM pcc)").replace("co AS (", "pco AS (", 1)
    a, t = _num(watterson(p.alleles)), _num(p.theta * watterson(p.alleles))
    made["fit_reg"] = f"""WITH RECURSIVE {SITES}, {_coefficients(p)}, ppat AS (SELECT *, theta * {a} AS t FROM ({_pseudo(p)}) v), {prior},
al AS (SELECT n, c, r, e, g AS q, k FROM co UNION ALL SELECT n, c, r, e, g, k FROM pco WHERE n > 0),
it AS (SELECT 0 AS i, 0.001::DOUBLE AS lo, 0.999::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN d < 0 THEN m ELSE lo END, CASE WHEN d < 0 THEN hi ELSE m END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m,
    sum(CASE WHEN c + (lo + hi) / 2 * (r + 600.0 * q) BETWEEN 0 AND 1 THEN -n * (r + 600.0 * q) / (c + (lo + hi) / 2 * (r + 600.0 * q)) ELSE -n * (r + 600.0 * q) / {_num(TINY)} END) AS d FROM it, al WHERE i < 60 GROUP BY i, lo, hi)),
f AS (SELECT lo AS rho FROM it WHERE i = 60),
k2 AS (SELECT rho, sum(-n * rho * (e + 600.0 * k) / (c + rho * (r + 600.0 * q))) AS d_eta, sum(-n * rho * q / (c + rho * (r + 600.0 * q))) AS d_gamma, sum(-n * ln(c + rho * (r + 600.0 * q))) AS nll_prior FROM f, al GROUP BY rho),
k3 AS (SELECT sum(-n * ln(c + rho * (r + 600.0 * g))) AS nll FROM f, co)
SELECT round(rho, 5) AS rho, 0.0::DOUBLE AS eta, 600.0::DOUBLE AS gamma, round(nll, 1) AS nll, round(nll_prior, 1) AS nll_prior, 0.0::DOUBLE AS dp,
  round(1000.0 * rho * 600.0 * {t}, 1) AS pw, 0.0::DOUBLE AS alpha, round(1.0 / (1.0 + (1.0 - rho) / (rho * 600.0)), 3) AS tau, d_eta > 0 AND d_gamma < 0 AS converged FROM k2, k3"""
    mass = "SELECT '{0}' AS axis, {0} AS value, round(sum(exp(log_prior)), 6) + 0.0::DOUBLE AS prior, round(sum(exp(log_post)), 6) + 0.0::DOUBLE AS post FROM z GROUP BY {0}"
    made["parameter_posterior"] = f"WITH {_grid(p)} " + " UNION ALL ".join(mass.format(x) for x in ("rho", "eta", "gamma"))
    axes = (_axis(1e-9, 1 - 1e-9, 10), _axis(1e-9, 2.0, 5), _axis(1e-9, 2.0, 5))
    made["posterior_interior"] = f"WITH {_grid(PLANTED, PLANTED_SITES, axes, 0.02)} " + " UNION ALL ".join(mass.format(x) for x in ("rho", "eta", "gamma"))
    shown = {k: k for k in ("d_rho", "d_eta", "d_gamma", "log_size", "prior_nll", "data_nll", "log_prior", "log_post")} | {"prior_density": "log_prior - log_size", "post_density": "log_post - log_size"}
    made["posterior_cells"] = f"WITH {_grid(p)} SELECT rho, eta, gamma, {', '.join(_r(x, -1 if k in ('data_nll', 'log_post', 'post_density') else 2, k) for k, x in shown.items())} FROM z"
    made["blocks_file"] = f"""WITH {BLOCKS} SELECT chrom, count(*) AS n, sum(en - st)::BIGINT AS positions, {_r("sum(printf('%.5f', 0.001::DOUBLE + (block_id % 50) * 0.00001::DOUBLE)::FLOAT::DOUBLE)", 6, 'theta')},
  {_r("sum(printf('%.4f', 0.003::DOUBLE + (block_id % 50) * 0.0001::DOUBLE)::FLOAT::DOUBLE)", 6, 'lam')} FROM blocks GROUP BY chrom"""
    made["polys_file"] = "SELECT CASE l_returnflag WHEN 'N' THEN 'L' ELSE 'H' END AS freq, count(*) AS n, sum(l_partkey)::BIGINT AS st, sum(l_linenumber)::BIGINT AS maj, sum(l_quantity::INT)::BIGINT AS min FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1"
    made["dictionary_file"] = "SELECT DISTINCT round(l_discount * 100)::SMALLINT AS idx, printf('%.2f', l_discount) AS tag, printf('%.2f', l_discount)::DOUBLE AS p FROM lineitem"
    made["mono_runs"] = """WITH q AS (SELECT p_partkey AS st, p_size % 5 AS idx FROM part), i AS (SELECT *, st - row_number() OVER (PARTITION BY idx ORDER BY st) AS island FROM q WHERE idx <> 0)
SELECT min(st) AS st, max(st) + 1 AS en, idx::SMALLINT AS idx FROM i GROUP BY idx, island"""
    made["weighted_bed_file"] = f"WITH {LOCI} SELECT chrom, count(*) AS n, sum(en - st)::BIGINT AS positions, sum((en - st) * weight)::BIGINT AS weighted FROM loci GROUP BY chrom"
    made["covariate_runs_file"] = f"WITH {TAGS} SELECT p_partkey AS st, p_partkey + 1 AS en, cts AS tagb, 'one' AS cell FROM bits"
    made["genome_file"] = f"WITH {LOCI} SELECT chrom, 0::BIGINT AS st, max(en) AS en FROM loci GROUP BY chrom"
    made["models_file"] = """WITH q AS (SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS job, 'PARAMETERS' AS section, n_name AS key, n_nationkey::VARCHAR AS value FROM q UNION ALL SELECT r_name, 'STATS', 'Nations', count(*)::VARCHAR FROM q GROUP BY r_name"""
    made["whole_models"] = "SELECT c_mktsegment || '-' || c_nationkey AS job, 9::BIGINT AS fields FROM customer GROUP BY 1 HAVING count(*) % 2 = 0"
    made["interchange_file"] = f"""WITH {BLOCKS}, b AS (SELECT chrom, count(*) AS blocks, sum(en - st)::BIGINT AS positions, sum(0.001::FLOAT::DOUBLE) AS theta FROM blocks GROUP BY chrom),
s AS (SELECT chrom, count(*) AS sites, sum({_DAYS.format('l_shipdate')})::BIGINT AS position_sum FROM lineitem JOIN blocks ON l_orderkey = block_id GROUP BY chrom) SELECT chrom, blocks, positions, {_r('theta', 6, 'theta')}, sites, position_sum FROM b JOIN s USING (chrom)"""
    made["table_cache"] = f"WITH {LOCI} SELECT chrom, count(*) AS n, sum(weight)::BIGINT AS weight FROM loci GROUP BY chrom"
    made["partition_report"] = f"""WITH {SPLITS}, k AS (SELECT *, row_number() OVER (PARTITION BY cov ORDER BY (least(n_set, n_cos) >= 10) DESC, gain DESC, value) AS rc,
  row_number() OVER (ORDER BY (least(n_set, n_cos) >= 10) DESC, gain DESC, cov, value) AS rank FROM g) SELECT cov, value, {_r('gain', 6, 'gain_nats')}, rank, rank = 1 AS best, rc = 1 AS best_of_covariate FROM k"""
    made["sorted_tags"] = "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT lpad((l_partkey % 37)::VARCHAR, 2, '0'))), ',') AS tags FROM lineitem GROUP BY 1"
    made["split_sums"] = """WITH p AS (SELECT p_partkey, p_size % 6 AS size, right(p_brand, 1)::INT % 6 AS brand, length(p_type) % 4 AS kind FROM part),
i AS (SELECT *, CASE WHEN size BETWEEN 1 AND 2 THEN 'a' WHEN size BETWEEN 3 AND 5 THEN 'b' END AS node, CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'N' THEN 'L' ELSE 'H' END AS cls FROM p JOIN lineitem ON l_partkey = p_partkey),
v AS (SELECT node, cls, 'size' AS cov, size AS value, CASE node WHEN 'a' THEN size ELSE size - 2 END AS rank, CASE node WHEN 'a' THEN 2 ELSE 3 END AS top FROM i
  UNION ALL SELECT node, cls, 'brand', brand, brand, 5 FROM i UNION ALL SELECT node, cls, 'kind', kind, kind, 3 FROM i),
c AS (SELECT *, unnest(range(1, top)) AS cut FROM v WHERE node IS NOT NULL AND value > 0)
SELECT concat_ws('/', node, cov, cut, CASE WHEN rank <= cut THEN 's' ELSE 'c' END) AS subset_id, cls, count(*) AS n FROM c GROUP BY ALL"""
    made["byte_file"] = """WITH c AS (SELECT c_mktsegment AS chrom, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS pos, floor(abs(c_acctbal))::BIGINT % 4 AS idx FROM customer),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, idx ORDER BY pos) AS run FROM c),
s AS (SELECT chrom, idx, min(pos) AS st, max(pos) + 1 AS en FROM r WHERE idx > 0 GROUP BY chrom, idx, run),
k AS (SELECT chrom, idx, greatest(st, 64 * k) AS st, least(en, 64 * k + 64) AS en FROM (SELECT *, unnest(range(st // 64, (en - 1) // 64 + 1)) AS k FROM s)),
f AS (SELECT *, st - sum(en - st) OVER (PARTITION BY chrom, idx ORDER BY st) + (en - st) AS grp FROM k WHERE chrom IN ('BUILDING', 'MACHINERY') AND en > 20 AND st < 5000),
m AS (SELECT chrom, idx, min(st) AS st, max(en) AS en FROM f GROUP BY chrom, idx, grp)
SELECT chrom, idx::INT AS idx, count(*) AS n, sum(st)::BIGINT AS st, sum(en)::BIGINT AS en FROM m WHERE idx > 1 GROUP BY ALL"""
    made["clustered_table"] = f"""WITH {LOCI}, {BLOCKS} SELECT block_id, count(*) AS n, sum(weight)::BIGINT AS weight FROM loci l JOIN blocks b ON l.chrom = b.chrom AND l.st < b.en AND b.st < l.en
WHERE block_id % 97 = 0 AND l.st < l.en GROUP BY ALL"""
    made["growth_replay"] = """WITH e AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS status, sum(l_quantity) AS n FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL)
SELECT l_orderkey::VARCHAR AS node_id, arg_max(status, l_linenumber) AS status, round(arg_max(n, l_linenumber), 2) AS n FROM e GROUP BY l_orderkey"""
    return made
