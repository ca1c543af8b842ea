"""Greedy decision tree over categorical covariates, a level at a time.

A level is counted in one scan, by node, covariate and single value; the patterns of every
candidate set and coset are sums of these, so that the scan does not grow with the number
of candidates. All candidates of a level are fitted together; the driver holds one row a
candidate. With a log each level is committed as a whole, and growth goes on from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.model import Params
from ..functions.numeric import BITS_PER_NAT, binary_entropy, ordering_error
from ..operators.covset import Covset, Layout, Subset, count_targets, count_values, ordered_splits, prefix_sums, target_table
from ..operators.intervals import coalesce_runs, overlap_join
from ..sources.shared import materialize
from .fit import coefficient_rows, fit_many, standard_errors
from .growth_log import GrowthLog


@dataclass(frozen=True)
class Options:
    min_gain: float = 100.0
    max_depth: int = 5
    min_positions: int = 0
    max_p1: float | None = None
    max_p2: float | None = None
    min_directed_bits: float | None = None
    #: Add the expected gain over both children's uncertainty to the scores.
    expected: bool = False
    #: Gain by likelihood, or by the entropy of rho.
    by_entropy: bool = False
    #: The parent's rho for entropy: fitted, or implied by the children.
    implied_rho: bool = False
    round_priors: bool = False


@dataclass
class Node:
    node_id: str
    parent_id: str | None
    depth: int
    subset: Subset
    params: Params
    nll: float | None = None
    status: str = "pending"
    split: dict | None = None
    children: list[str] = field(default_factory=list)


def subset_sites(aligned: DataFrame, targets: DataFrame, sites: DataFrame) -> DataFrame:
    """Patterns of every target: subset_id, cls, x_maj, x_min, lambda, theta, n.

    A site counts once for every cell whose state falls in the target.
    """
    counted = count_targets(aligned, targets)
    merged = coalesce_runs(counted, "n", ["subset_id", "chrom"], region=1_000_000).withColumnRenamed("n", "weight")
    joined = overlap_join(merged, sites)
    keys = ["subset_id", "cls", "x_maj", "x_min", "lambda", "theta"]
    return joined.groupBy(*keys).agg(F.sum(F.col("weight") * (F.col("en") - F.col("st"))).cast("double").alias("n"))


PATTERN = ["cls", "x_maj", "x_min", "lambda", "theta"]


def value_patterns(aligned: DataFrame, nodes: DataFrame, covset: Covset, sites: DataFrame) -> DataFrame:
    """Patterns by single value: node_id, cov, value, cls, x_maj, x_min, lambda, theta, n.

    ``nodes`` as ``count_values`` takes them. Every row has one value of each covariate,
    so the sum over any one covariate's values is the node's own.
    """
    counted = count_values(aligned, nodes, covset, Layout.of(covset.of(False)), Layout.of(covset.of(True)))
    keys = ["node_id", "cov", "value"]
    merged = coalesce_runs(counted, "n", [*keys, "chrom"], region=1_000_000).withColumnRenamed("n", "weight")
    joined = overlap_join(merged, sites)
    return joined.groupBy(*keys, *PATTERN).agg(F.sum(F.col("weight") * (F.col("en") - F.col("st"))).cast("double").alias("n"))


def split_patterns(spark: SparkSession, values: DataFrame, orders: dict[tuple[str, str], list[int]]) -> DataFrame:
    """Patterns of the sets and cosets of every cut: subset_id ``node/cov/cut/side`` and pattern.

    ``orders`` has the values in order, by node and covariate.
    """
    rows = [(node, cov, v, i + 1, len(order)) for (node, cov), order in orders.items() for i, v in enumerate(order)]
    ranks = spark.createDataFrame(rows, "node_id string, cov string, value int, rank int, top int")
    sums = prefix_sums(values, ranks, "n", PATTERN)
    return sums.select(F.concat_ws("/", "node_id", "cov", F.col("cut").cast("string"), "side").alias("subset_id"), *PATTERN, "n")


def fit_subsets(patterns: DataFrame, starts: dict[str, Params], scale: float = 1.0) -> dict[str, dict]:
    """rho, eta, gamma, nll, errors and positions of every subset, fitted in step."""
    first = next(iter(starts.values()))
    rows = coefficient_rows(patterns, first, ["subset_id"], scale).cache()
    size = {r.subset_id: r.n for r in rows.groupBy("subset_id").agg(F.sum("n").alias("n")).collect()}
    found = fit_many(rows, {s: p for s, p in starts.items() if size.get(s)}, ["subset_id"])
    rows.unpersist()
    out = {}
    for s, f in found.items():
        errors = standard_errors(f.hessian)
        out[s] = {"rho": float(f.x[0]), "eta": float(f.x[1]), "gamma": float(f.x[2]), "nll": float(f.value), "rho_err": errors["rho"], "n": float(size[s]) / scale}
    return out


def entropy_gain(n_hi: Column, rho_hi: Column, n_lo: Column, rho_lo: Column, parent: Column | None = None) -> Column:
    """Entropy of the parent's positions less that of the children's, in bits.

    Without ``parent``, its rho is the one the children imply.
    """
    rho = (n_hi * rho_hi + n_lo * rho_lo) / (n_hi + n_lo) if parent is None else parent
    return ((n_hi + n_lo) * binary_entropy(rho) - n_hi * binary_entropy(rho_hi) - n_lo * binary_entropy(rho_lo)) * BITS_PER_NAT


def expected_gain(n_hi: float, rho_hi: float, err_hi: float, n_lo: float, rho_lo: float, err_lo: float, points: int = 1000) -> tuple[float, float]:
    """Entropy gain in bits expected over both children's uncertainty, whole and in order.

    The bells lack the factor one half in the exponent, as the thresholds that are
    used with these figures were tuned so.
    """
    import numpy as np

    def axis(rho: float, err: float) -> tuple[np.ndarray, np.ndarray]:
        x = np.linspace(max(1e-6, rho - 4 * err), min(1 - 1e-6, rho + 4 * err), points)
        w = np.exp(-(((x - rho) / max(err, 1e-9)) ** 2))
        return x, w / w.sum()

    def h(p):
        return -(p * np.log2(p) + (1 - p) * np.log2(1 - p))

    (x, wx), (y, wy) = axis(rho_hi, err_hi), axis(rho_lo, err_lo)
    parent = (n_hi * x[:, None] + n_lo * y[None]) / (n_hi + n_lo)
    gain = (n_hi + n_lo) * h(np.clip(parent, 1e-9, 1 - 1e-9)) - n_hi * h(x)[:, None] - n_lo * h(y)[None]
    w = wx[:, None] * wy[None]
    return float((w * gain).sum()), float((w * gain * (x[:, None] > y[None])).sum())


@F.pandas_udf(StructType([StructField("total", DoubleType()), StructField("ordered", DoubleType())]))
def expected_gains(n_hi: pd.Series, rho_hi: pd.Series, err_hi: pd.Series, n_lo: pd.Series, rho_lo: pd.Series, err_lo: pd.Series) -> pd.DataFrame:
    """``expected_gain`` of each row, in the tasks; null where an error is."""
    rows = [expected_gain(*r) if pd.notna(r[2]) and pd.notna(r[5]) and r[2] and r[5] else (None, None) for r in zip(n_hi, rho_hi, err_hi, n_lo, rho_lo, err_lo)]
    return pd.DataFrame(rows, columns=["total", "ordered"], dtype=float)


def score_candidates(candidates: DataFrame, options: Options) -> DataFrame:
    """Gains, ordering errors, checks and ranks of fitted candidates.

    ``candidates``: node_id, cov, set_values, coset_values, parent_nll, parent_rho and,
    for both sides, n_, rho_, err_, nll_ with suffix set and cos. The side with the
    higher rho is ``hi``. Error chances are multiplied by the node's number of
    candidates. Ties in gain go by covariate and set.
    """
    flip = F.col("rho_set") >= F.col("rho_cos")
    side = lambda x, hi: F.when(flip, F.col(f"{x}_{'set' if hi else 'cos'}")).otherwise(F.col(f"{x}_{'cos' if hi else 'set'}"))
    df = candidates.where("n_set > 0 AND n_cos > 0")
    for x in ("n", "rho", "err", "nll"):
        df = df.withColumn(f"{x}_hi", side(x, True)).withColumn(f"{x}_lo", side(x, False))
    df = df.withColumn("gain_nats", F.col("parent_nll") - F.col("nll_hi") - F.col("nll_lo"))
    df = df.withColumn("gain_bits", F.col("gain_nats") * BITS_PER_NAT)
    parent = None if options.implied_rho else F.col("parent_rho")
    df = df.withColumn("entropy_bits", entropy_gain(F.col("n_hi"), F.col("rho_hi"), F.col("n_lo"), F.col("rho_lo"), parent))
    df = df.withColumn("gain", F.col("entropy_bits") if options.by_entropy else F.col("gain_nats"))
    middle = (F.col("rho_hi") + F.col("rho_lo")) / 2
    df = df.withColumn("p1", ordering_error(F.col("rho_hi"), F.col("rho_lo"), F.col("err_hi"), F.col("err_lo")))
    zero = F.lit(0.0)
    df = df.withColumn("p2", F.greatest(ordering_error(F.col("rho_hi"), middle, F.col("err_hi"), zero), ordering_error(middle, F.col("rho_lo"), zero, F.col("err_lo"))))
    tests = F.count("*").over(Window.partitionBy("node_id"))
    ok = F.least("n_hi", "n_lo") >= options.min_positions
    if options.max_p1 is not None:
        ok &= F.coalesce(F.col("p1") * tests <= options.max_p1, F.lit(False))
    if options.max_p2 is not None:
        ok &= F.coalesce(F.col("p2") * tests <= options.max_p2, F.lit(False))
    if options.expected or options.min_directed_bits is not None:
        df = df.withColumn("_gains", expected_gains(*[F.col(f"{x}_{y}") for y in ("hi", "lo") for x in ("n", "rho", "err")]))
        df = df.withColumn("expected_bits", F.col("_gains.total")).withColumn("directed_bits", F.col("_gains.ordered")).drop("_gains")
    if options.min_directed_bits is not None:
        ok &= F.coalesce(F.col("directed_bits") >= options.min_directed_bits, F.lit(False))
    df = df.withColumn("passes", ok)
    order = [F.desc("passes"), F.desc("gain"), "cov", F.col("set_values")]
    best = F.max(F.when(F.col("passes"), F.col("gain"))).over(Window.partitionBy("node_id", "cov"))
    return (
        df.withColumn("best_of_cov", best)
        .withColumn("rank_in_cov", F.row_number().over(Window.partitionBy("node_id", "cov").orderBy(*order)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(*order)))
    )


def _clean(p: Params, fitted: dict, options: Options) -> Params:
    """A child's start: the fitted values; eta only where it is not near zero."""
    made = replace(p, rho=fitted["rho"], gamma=fitted["gamma"], eta=fitted["eta"] if fitted["eta"] > 0.0002 else p.eta)
    return replace(made, **{k: round(getattr(made, k), 6) for k in ("rho", "eta", "gamma")}) if options.round_priors else made


def grow(spark: SparkSession, covset: Covset, aligned: DataFrame, sites: DataFrame, start: Params, options: Options = Options(), cells: int = 1, nodes: list[Node] | None = None, levels: int | None = None, kept: dict[str, list[DataFrame]] | None = None, first: Subset = Subset(), log: GrowthLog | None = None) -> list[Node]:  # noqa: B008
    """Grow a tree; ``aligned`` and ``sites`` as ``align`` and ``subset_sites`` take them.

    The root, all positions or those of the subset ``first``, is fitted first, so that its
    likelihood is that of these data. With ``levels`` growth stops after so many, and its
    open nodes stay ``pending``; given as ``nodes`` (see ``load_nodes``), growth goes on
    from them. ``kept`` receives each level's scored splits and the fits of single values,
    under partitions and singles. With ``log`` each level is committed with its number,
    and a log that holds levels already is gone on with, whatever ended its run.
    """
    ann, cts = Layout.of(covset.of(False)), Layout.of(covset.of(True))
    aligned, sites, scale = materialize(aligned, "aligned"), materialize(sites, "sites"), 1.0 / cells
    number = 0
    if log is not None and (before := log.levels()):
        nodes, number = load_nodes(log.replay(), covset, start), before[-1]

    def counted(level: list[Node]) -> DataFrame:
        """Patterns of the level's nodes by single value: the level's one scan."""
        members = target_table(spark, {n.node_id: n.subset for n in level}, ann, cts)
        return materialize(value_patterns(aligned, members, covset, sites), "values")

    values = None
    if nodes is None:
        root = Node("0", None, options.max_depth, first, start)
        values = counted([root])
        whole = values.where(F.col("cov") == covset.covariates[0].name).groupBy(*PATTERN).agg(F.sum("n").alias("n"))
        found = fit_subsets(whole.withColumn("subset_id", F.lit("0")), {"0": start}, scale).get("0")
        if found is None:
            return [replace(root, status="empty")]
        root.params, root.nll = _clean(start, found, options), found["nll"]
        nodes = [root]
        if log is not None:
            log.commit(0, nodes=node_table(spark, nodes, covset))
    done, level = [n for n in nodes if n.status != "pending"], [n for n in nodes if n.status == "pending"]
    while level and levels != 0:
        levels = None if levels is None else levels - 1
        number += 1
        by_id, batch = {n.node_id: n for n in level}, {}
        values = counted(level) if values is None else values
        loose = [c.name for c in covset.covariates if not c.monotonic]
        singles = {}
        if loose:
            own = values.where(F.col("cov").isin(loose) & (F.col("value") > 0))
            names = {f"{n.node_id}/{c}/{v}": (n.node_id, c, v) for n in level for c in loose for v in n.subset.values(covset[c]) if v}
            fits = fit_subsets(own.select(F.concat_ws("/", "node_id", "cov", F.col("value").cast("string")).alias("subset_id"), *PATTERN, "n"), {i: by_id[k[0]].params for i, k in names.items()}, scale) if names else {}
            singles = {names[i]: f for i, f in fits.items()}
        if singles:
            made = [(*k, *(f[x] for x in ("n", "rho", "rho_err", "eta", "gamma", "nll"))) for k, f in singles.items()]
            batch["singles"] = spark.createDataFrame(made, "node_id string, cov string, value int, n double, rho double, rho_err double, eta double, gamma double, nll double")
        orders, splits = {}, {}
        for n in level:
            for c in covset.covariates:
                scores = {v: singles[n.node_id, c.name, v]["rho"] if (n.node_id, c.name, v) in singles else 0.0 for v in n.subset.values(c)}
                cuts = ordered_splits(n.subset, c, scores)
                if cuts:
                    order = [*cuts[0][0], *(v for (a, _), (b, _) in zip(cuts, cuts[1:]) for v in b if v not in a), *cuts[-1][1]]
                    orders[n.node_id, c.name] = order
                    splits |= {f"{n.node_id}/{c.name}/{i + 1}": (n, c.name, a, b) for i, (a, b) in enumerate(cuts)}
        starts = {f"{key}/{side}": n.params for key, (n, *_) in splits.items() for side in "sc"}
        results = fit_subsets(split_patterns(spark, values, orders), starts, scale) if starts else {}
        rows = []
        for key, (n, name, a, b) in splits.items():
            s, c = results.get(f"{key}/s"), results.get(f"{key}/c")
            if s and c:
                rows.append((n.node_id, key, name, list(a), list(b), n.nll, n.params.rho, *[float(x) if (x := side[k]) is not None else None for k in ("n", "rho", "rho_err", "nll") for side in (s, c)]))
        best = {}
        if rows:
            spec = "node_id string, key string, cov string, set_values array<int>, coset_values array<int>, parent_nll double, parent_rho double, " + ", ".join(f"{x}_{y} double" for x in ("n", "rho", "err", "nll") for y in ("set", "cos"))
            candidates = spark.createDataFrame(rows, spec)
            if options.expected or options.min_directed_bits is not None:
                candidates = candidates.repartition(min(len(rows), spark.sparkContext.defaultParallelism))
            batch["partitions"] = score_candidates(candidates, options)
            best = {r.node_id: r for r in batch["partitions"].where("rank = 1 AND passes").collect()}
        following, ended = [], []
        for n in level:
            r = best.get(n.node_id)
            n.status = "leaf"
            ended.append(n)
            if r is None or r.gain <= options.min_gain:
                continue
            n.split = {"cov": r.cov, "set": list(r.set_values), "coset": list(r.coset_values), "gain_nats": r.gain_nats, "gain_bits": r.gain_bits, "entropy_bits": r.entropy_bits}
            n.status = "split"
            sides = [("s", r.set_values), ("c", r.coset_values)]
            sides.sort(key=lambda x: -results[f"{r.key}/{x[0]}"]["rho"])
            for place, (side, own_values) in enumerate(sides):
                got = results[f"{r.key}/{side}"]
                child = Node(f"{n.node_id}{'hl'[place]}", n.node_id, n.depth - 1, n.subset.with_values(r.cov, own_values), _clean(n.params, got, options), got["nll"])
                n.children.append(child.node_id)
                if child.depth > 0 and child.subset.can_split(covset):
                    following.append(child)
                else:
                    child.status = "leaf"
                    ended.append(child)
        if kept is not None:
            for name, df in batch.items():
                kept.setdefault(name, []).append(df)
        if log is not None:
            log.commit(number, nodes=node_table(spark, ended + following, covset), **batch)
        done += ended
        level, values = following, None
    return done + level


NODE_SCHEMA = "node_id string, parent_id string, depth int, subset_template string, mask_ann long, mask_cts long, prior_rho double, prior_eta double, prior_gam double, nll double, status string, split_cov string, split_set array<int>, split_coset array<int>, gain_nats double, gain_bits double"


def node_table(spark: SparkSession, nodes: list[Node], covset: Covset) -> DataFrame:
    """Nodes as a table; those still ``pending`` are where a restart goes on."""
    ann, cts = Layout.of(covset.of(False)), Layout.of(covset.of(True))
    rows = []
    for n in nodes:
        s = n.split or {}
        rows.append((n.node_id, n.parent_id, n.depth, n.subset.template(covset), n.subset.mask(ann), n.subset.mask(cts), n.params.rho, n.params.eta, n.params.gamma, n.nll, n.status, s.get("cov"), s.get("set"), s.get("coset"), s.get("gain_nats"), s.get("gain_bits")))
    return spark.createDataFrame(rows, NODE_SCHEMA)


def load_nodes(table: DataFrame, covset: Covset, start: Params) -> list[Node]:
    """The nodes of a stored table; ``start`` gives the parameters that it does not hold."""
    made = {}
    for r in table.orderBy("node_id").collect():  # one row a node
        params = replace(start, rho=r.prior_rho, eta=r.prior_eta, gamma=r.prior_gam)
        split = {"cov": r.split_cov, "set": r.split_set, "coset": r.split_coset, "gain_nats": r.gain_nats, "gain_bits": r.gain_bits} if r.split_cov else None
        made[r.node_id] = Node(r.node_id, r.parent_id, r.depth, Subset.parse(r.subset_template, covset), params, r.nll, r.status, split)
    for n in made.values():
        if n.parent_id in made:
            made[n.parent_id].children.append(n.node_id)
    return list(made.values())


def value_summary(rows: DataFrame) -> DataFrame:
    """Per covariate, entropy of its single values against their pool.

    ``rows``: cov, value, n, rho. Conditional entropy weighs each value by its positions.
    """
    agg = rows.groupBy("cov").agg(
        F.sum("n").alias("positions"),
        (F.sum(F.col("n") * binary_entropy(F.col("rho"))) * BITS_PER_NAT).alias("conditional_bits"),
        (F.sum(F.col("n") * F.col("rho")) / F.sum("n")).alias("rho"),
    )
    return agg.withColumn("unconditional_bits", F.col("positions") * binary_entropy(F.col("rho")) * BITS_PER_NAT)
