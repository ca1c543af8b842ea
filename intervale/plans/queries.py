"""The registered queries of the interval engine, on the driver's tables.

Line items stand for sites, orders for blocks, events for runs of states. Each query
runs the engine's operator over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as m
from ..functions import numeric as num
from ..functions import strings as st
from ..operators import covset as cov
from ..operators import grid, intervals, patterns, sites
from ..operators.covset import Covariate, Covset, Layout, Subset
from ..sources import clustered, readers, sinks
from ..sources.byte_file import read_byte_file, write_byte_file
from ..sources.shared import shared_path
from . import fit, tree
from .growth_log import GrowthLog

P = m.Params(rho=0.3, eta=0.8, gamma=1.2, lam=0.004, theta=0.0009, beta1=0.75, beta2=0.2, beta3=0.05)
COVSET = Covset("parts", "ann", "cts", (
    Covariate("size", False, True, tuple((f"s{i}", "") for i in range(6))),
    Covariate("brand", True, False, tuple((f"b{i}", "") for i in range(6))),
    Covariate("kind", True, True, tuple((f"k{i}", "") for i in range(4))),
))
ANN, CTS = Layout.of(COVSET.of(False)), Layout.of(COVSET.of(True))


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round for comparison; negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


def _days(c: str):
    return F.datediff(F.col(c), F.lit("1990-01-01").cast("date")).cast("long")


def _elapsed(unit: str, since: str):
    """Whole units of event time since a date; no time zone takes part."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'{since} 00:00:00', ts)")


def loci(spark, sf) -> DataFrame:
    """Line items as weighted intervals of days."""
    df = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).cast("string").alias("chrom"), _days("l_shipdate").alias("st"), "l_linenumber", F.col("l_quantity").cast("int").alias("weight"))
    return df.select("chrom", "st", (F.col("st") + F.col("l_linenumber")).cast("long").alias("en"), "weight")


def order_blocks(spark, sf) -> DataFrame:
    """Orders as intervals of days."""
    df = _t(spark, sf, "orders").select((F.col("o_orderkey") % 100).cast("string").alias("chrom"), _days("o_orderdate").alias("st"), F.col("o_orderkey").alias("block_id"))
    return df.select("chrom", "st", (F.col("st") + 1 + F.col("block_id") % 4).cast("long").alias("en"), "block_id")


def item_sites(spark, sf) -> DataFrame:
    """Line items as sites with a class, decoded priors and block values."""
    df = _t(spark, sf, "lineitem")
    cls = F.when(F.col("l_returnflag") == "A", "M").when(F.col("l_returnflag") == "N", "L").otherwise("H")
    return df.select(
        F.col("l_suppkey").alias("block_id"), cls.alias("cls"), (0.9 - 3.0 * F.col("l_discount")).alias("x_maj"), F.col("l_tax").alias("x_min"),
        (0.003 + 0.0001 * F.col("l_linenumber")).alias("lambda"), (0.001 + 0.00001 * F.col("l_linenumber")).alias("theta"),
        F.col("l_quantity").cast("long").alias("weight"), F.lit(1).cast("long").alias("len"), "l_discount", "l_tax", "l_linenumber",
    )


def _site_patterns(spark, sf) -> DataFrame:
    keys = ["cls", "x_maj", "x_min", "lambda", "theta"]
    return patterns.pattern_counts(item_sites(spark, sf), keys)


def _by_block(sums: DataFrame) -> DataFrame:
    return sums.groupBy("block_id").agg(*[F.sum(c).alias(c) for c in ("n", "shared", "weighted")])


def overlap_join(spark, sf) -> DataFrame:
    return _by_block(intervals.overlap_sums(loci(spark, sf), order_blocks(spark, sf)))


def mixed_lengths(spark, sf) -> DataFrame:
    """Line items, each tenth of them years long, against orders' blocks, each seventh of them long."""
    l = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).cast("string").alias("chrom"), _days("l_shipdate").alias("st"), "l_linenumber", F.col("l_quantity").cast("int").alias("weight"), (F.col("l_partkey") % 10 == 0).alias("long"))  # noqa: E741
    l = l.select("chrom", "st", (F.col("st") + F.col("l_linenumber") * F.when(F.col("long"), 400).otherwise(1)).cast("long").alias("en"), "weight")  # noqa: E741
    b = order_blocks(spark, sf).withColumn("en", F.when(F.col("block_id") % 7 == 0, F.col("en") + 90).otherwise(F.col("en")))
    return _by_block(intervals.overlap_sums(l, b))


def overlap_clip(spark, sf) -> DataFrame:
    df = intervals.clip(loci(spark, sf).withColumn("lo", F.lit(2500)).withColumn("hi", F.lit(3500)), "lo", "hi")
    return df.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("en") - F.col("st")).alias("positions"))


def interval_advance(spark, sf) -> DataFrame:
    df = intervals.advance(loci(spark, sf).withColumn("to", F.lit(3000)), "to")
    return df.groupBy("chrom").agg(F.sum(F.when(F.col("st") < F.col("en"), 1).otherwise(0)).cast("long").alias("left_over"), F.sum(F.col("en") - F.col("st")).alias("positions"))


def interval_compare(spark, sf) -> DataFrame:
    """Every line item against its order's block."""
    own = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block_id"), (F.col("l_orderkey") % 100).cast("string").alias("chrom"), _days("l_shipdate").alias("st"), "l_linenumber")
    a = own.select("block_id", "chrom", "st", (F.col("st") + F.col("l_linenumber")).alias("en"))
    both = a.alias("a").join(order_blocks(spark, sf).alias("b"), F.col("a.block_id") == F.col("b.block_id"))
    return both.select(F.col("a.chrom").alias("chrom"), intervals.compare("a", "b").alias("side")).groupBy("chrom", "side").agg(F.count("*").alias("n"))


def point_in_block(spark, sf) -> DataFrame:
    ev = _t(spark, sf, "events").select(F.col("event_type").alias("chrom"), _elapsed("SECOND", "1970-01-01").alias("pos"), "value")
    b = ev.select("chrom", F.expr("pos div 21600").alias("number")).distinct()
    b = b.select("chrom", (F.col("number") * 21600).alias("st"), ((F.col("number") + 1) * 21600).alias("en"), "number")
    found = intervals.locate(ev, b, width=21600)
    return found.groupBy("chrom", "number").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def neutral_semi(spark, sf) -> DataFrame:
    return intervals.overlap_flags(order_blocks(spark, sf), loci(spark, sf), width=16).select("block_id", "hit")


def interval_positions(spark, sf) -> DataFrame:
    return intervals.positions(loci(spark, sf)).groupBy("chrom", "pos").agg(F.count("*").alias("depth"))


def linear_positions(spark, sf) -> DataFrame:
    genome = loci(spark, sf).groupBy("chrom").agg(F.lit(0).cast("long").alias("st"), F.max("en").alias("en"))
    there = intervals.linear_positions(loci(spark, sf), genome)
    back = intervals.from_linear(there.select("linear", F.col("st").alias("was"), F.col("chrom").alias("chrom_was")), genome)
    return back.groupBy("chrom").agg(F.sum("linear").alias("linear"), F.sum((F.col("st") == F.col("was")).cast("long")).alias("same"))


def pattern_counts(spark, sf) -> DataFrame:
    return patterns.pattern_counts(item_sites(spark, sf), ["block_id", "cls", "l_discount", "l_tax"])


def pattern_expand(spark, sf) -> DataFrame:
    per = patterns.expand_patterns(patterns.pattern_counts(item_sites(spark, sf), ["cls", "l_discount"]))
    return per.groupBy("cls", "l_discount").agg(F.count("*").alias("n"))


def site_counters(spark, sf) -> DataFrame:
    return patterns.site_counters(item_sites(spark, sf))


def interval_stats(spark, sf) -> DataFrame:
    return patterns.loci_info(loci(spark, sf))


def pattern_totals(spark, sf) -> DataFrame:
    return patterns.pattern_totals(patterns.pattern_counts(item_sites(spark, sf), ["cls", "l_discount", "l_tax"]))


def shrunk_mean(spark, sf) -> DataFrame:
    return _round(patterns.shrunk_mean(_t(spark, sf, "lineitem"), "l_discount", "l_quantity", 0.05, 347.0, 0.02, ["l_suppkey"]), 6, "mean")


def ratio_pseudocount(spark, sf) -> DataFrame:
    return _round(patterns.pseudocount_ratio(_t(spark, sf, "lineitem"), "l_returnflag = 'R'", "l_quantity", 0.2, 347.0, ["l_suppkey"]), 6, "ratio")


def _alleles(spark, sf) -> DataFrame:
    return item_sites(spark, sf).withColumn("p_maj", F.col("x_maj")).withColumn("p_min", F.col("x_min")).withColumn("weight", F.col("weight").cast("double"))


def class_matrix(spark, sf) -> DataFrame:
    return _round(patterns.class_matrix(_alleles(spark, sf), "weight"), 2, "maj", "min", "oth")


def block_normalised_matrix(spark, sf) -> DataFrame:
    return _round(patterns.block_normalised_matrix(_alleles(spark, sf)), 5, "maj", "min", "oth")


def coalesce_runs(spark, sf) -> DataFrame:
    ev = _t(spark, sf, "events").select(F.col("user_id").alias("chrom"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("st"))
    days = ev.groupBy("chrom", "st").agg(F.least(F.count("*"), F.lit(3)).alias("n")).withColumn("en", F.col("st") + 1)
    return intervals.coalesce_runs(days, "n", region=7).select("chrom", "st", "en", "n")


def _state_runs(spark, sf) -> DataFrame:
    """Hours of events as runs of eight cells; a run lasts to the cell's next."""
    ev = _t(spark, sf, "events").select((F.col("user_id") % 8).alias("cell"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 3600").alias("st"), F.length("event_type").alias("k"))
    return ev.groupBy("cell", "st").agg(F.max("k").alias("k"))


def breakpoint_segments(spark, sf) -> DataFrame:
    ev = _state_runs(spark, sf).select(F.col("cell").cast("string").alias("chrom"), "st", (F.col("st") + F.col("k")).alias("en"))
    return intervals.breakpoint_segments(ev, region=48)


def asof_state(spark, sf) -> DataFrame:
    ev = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("chrom"), _elapsed("MICROSECOND", "2024-01-01").alias("st"), "event_type", F.col("value").alias("v"))
    first = ev.groupBy().agg(F.min("event_type").alias("x"))
    runs = ev.join(F.broadcast(first), F.col("event_type") == F.col("x")).select("chrom", "st", "v")
    return intervals.asof_state(ev.select("event_id", "chrom", "st"), runs, "v", ["chrom"], region=86_400_000_000).select("event_id", F.col("v").alias("state"))


def aligned_counts(spark, sf) -> DataFrame:
    runs = _state_runs(spark, sf).withColumn("chrom", F.lit("c"))
    from pyspark.sql import Window

    hours = (runs.agg(F.max("st")).first()[0] or 0) + 1  # one number
    cells = runs.withColumn("en", F.coalesce(F.lead("st").over(Window.partitionBy("cell").orderBy("st")), F.lit(hours))).where("st < en")
    cells = cells.select("chrom", "st", "en", "cell", F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("k") % 8).cast("int")).alias("tagb"))
    ann = spark.range(-(-hours // 100)).select(F.lit("c").alias("chrom"), (F.col("id") * 100).alias("st"), F.least((F.col("id") + 1) * 100, F.lit(hours)).alias("en"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 2).cast("int")).alias("tagb"))
    aligned = intervals.align(ann, cells, region=128)
    targets = spark.createDataFrame([("even", 1, 0b01010101), ("odd", 2, 0b10101010), ("all", 3, 255)], "subset_id string, mask_ann long, mask_cts long")
    counted = cov.count_targets(aligned, targets)
    return intervals.coalesce_runs(counted, "n", ["subset_id", "chrom"], region=128).select("subset_id", "st", "en", "n")


def _part_tags(spark, sf) -> DataFrame:
    digits = [F.col("p_size") % 6, F.substring("p_brand", -1, 1).cast("int") % 6, F.length("p_type") % 4]
    return _t(spark, sf, "part").select("p_partkey", digits[0].cast("string").alias("ann_tags"), F.concat(digits[1].cast("string"), digits[2].cast("string")).alias("cts_tags"))


def onehot_encode(spark, sf) -> DataFrame:
    df = _part_tags(spark, sf).withColumn("ann", ANN.encode(F.col("ann_tags"))).withColumn("cts", CTS.encode(F.col("cts_tags")))
    return df.withColumn("back", CTS.decode(F.col("cts"))).select("p_partkey", "ann", "cts", "back")


def mask_filter(spark, sf) -> DataFrame:
    subset = Subset.parse("ANN:{size;1,2,3}:CTS:{brand;1,2},{kind;0,1}", COVSET)
    df = _part_tags(spark, sf).withColumn("ann", ANN.encode(F.col("ann_tags"))).withColumn("cts", CTS.encode(F.col("cts_tags")))
    return df.where(cov.in_set(F.col("ann"), subset.mask(ANN)) & cov.in_set(F.col("cts"), subset.mask(CTS))).select("p_partkey")


def mask_targets(spark, sf) -> DataFrame:
    subsets = {f"{c.name}{i}": Subset().with_values(c.name, [i]) for c in COVSET.covariates for i in range(1, c.top + 1)}
    df = _part_tags(spark, sf).select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("st"), (F.col("p_partkey") + 1).alias("en"), ANN.encode(F.col("ann_tags")).alias("ann"), CTS.encode(F.col("cts_tags")).alias("tagb"))
    counted = cov.count_targets(df, cov.target_table(spark, subsets, ANN, CTS))
    return counted.groupBy("subset_id").agg(F.sum("n").alias("n"))


def mask_accumulate(spark, sf) -> DataFrame:
    df = _part_tags(spark, sf).withColumn("cts", CTS.encode(F.col("cts_tags")))
    return df.groupBy("ann_tags").agg(cov.mask_of(F.col("cts")).alias("mask"))


def _log_parts(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", "p_brand", (-F.col("p_retailprice") / 10.0).alias("x"))


def logsumexp(spark, sf) -> DataFrame:
    return _round(num.log_sum_exp(_log_parts(spark, sf), "x", ["p_brand"]), 6, "lse")


def log_normalise(spark, sf) -> DataFrame:
    return _round(num.log_normalise(_log_parts(spark, sf), "x", ["p_brand"]), 6, "x").select("p_partkey", "x")


def grid_marginals(spark, sf) -> DataFrame:
    df = _t(spark, sf, "lineitem").groupBy(F.col("l_discount").alias("rho"), F.col("l_tax").alias("eta"), F.col("l_linenumber").cast("double").alias("gamma"))
    cells = df.agg(F.log(F.sum("l_quantity")).alias("log_prior"), F.log(F.count("*").cast("double")).alias("log_post"))
    return _round(grid.marginals(cells), 2, "prior", "post")


def weighted_expectation(spark, sf) -> DataFrame:
    return _round(grid.expectation(_t(spark, sf, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), 8, "expectation")


def interp_quantile(spark, sf) -> DataFrame:
    df = _t(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"))
    total = df.groupBy("l_returnflag").agg(F.sum("n").alias("t"))
    mass = df.join(total, "l_returnflag").select("l_returnflag", "value", (F.col("n") / F.col("t")).alias("post"))
    return _round(grid.quantiles(mass, [0.025, 0.5, 0.975], ["l_returnflag"]), 6, "x")


def _coefficients(spark, sf) -> DataFrame:
    return fit.coefficient_rows(_site_patterns(spark, sf), P)


def _nll(spark, sf, names: list[str], digits: int) -> DataFrame:
    terms = m.nll_terms(F.lit(P.rho), F.lit(P.eta), F.lit(P.gamma))
    df = _coefficients(spark, sf).agg(*[terms[n].alias(n) for n in names])
    return _round(df, digits, *names)


def mixture_nll(spark, sf) -> DataFrame:
    return _nll(spark, sf, ["nll"], 2)


def mixture_gradient(spark, sf) -> DataFrame:
    return _nll(spark, sf, ["d_rho", "d_eta", "d_gamma"], 2)


def mixture_hessian(spark, sf) -> DataFrame:
    return _nll(spark, sf, ["h_rho_rho", "h_rho_eta", "h_rho_gamma", "h_eta_eta", "h_eta_gamma", "h_gamma_gamma"], 1)


def coefficient_projection(spark, sf) -> DataFrame:
    df = _coefficients(spark, sf)
    return _round(df.agg(*[F.sum(F.col(k) * F.col("n")).alias(k) for k in "cregk"], F.sum("n").alias("n")), 3, *"cregk", "n")


def prior_pseudo_rows(spark, sf) -> DataFrame:
    cells = spark.createDataFrame(m.prior_cells(P, 347.0), "cls string, x_maj double, x_min double, lambda double, theta double, n double")
    items = _t(spark, sf, "lineitem").agg(F.count("*").alias("rows"))
    return _round(cells.crossJoin(F.broadcast(items)), 6, "n").select("cls", "x_maj", "x_min", "n", "rows")


def lambda_theta(spark, sf) -> DataFrame:
    df = item_sites(spark, sf)
    lam, theta = fit.lambda_theta(df, "weight", P, 347.0, 0.02)
    return spark.createDataFrame([(round(lam, 8), round(theta, 9))], "lam double, theta double")


def beta2_ratio(spark, sf) -> DataFrame:
    df = item_sites(spark, sf).withColumn("n", F.col("weight"))
    return spark.createDataFrame([(round(fit.beta2(df, 0.2, 347.0), 8),)], "beta2 double")


def site_posterior(spark, sf) -> DataFrame:
    df = sites.posteriors(item_sites(spark, sf), P)
    keys = ["cls", "l_discount", "l_tax", "l_linenumber"]
    return _round(df.select(*keys, *m.STATES, "p_selected").distinct(), 8, *m.STATES, "p_selected").distinct()


def posterior_sum(spark, sf) -> DataFrame:
    df = sites.posteriors(item_sites(spark, sf), P)
    return _round(sites.posterior_sum(df, "weight", ["cls"]), 6, *m.STATES)


def allele_joint(spark, sf) -> DataFrame:
    df = sites.allele_posteriors(item_sites(spark, sf).select("block_id", "cls", "lambda", "theta").groupBy("block_id", "cls").agg(F.min("lambda").alias("lambda"), F.min("theta").alias("theta")), P)
    names = [f"p_{z}{s}" for z in "aio" for s in "01"]
    return _round(df.select("block_id", "cls", *names), 8, *names)


def _counterfactual(spark, sf, mode: int) -> DataFrame:
    shown = ["cls", "x_maj", "x_min", "lambda", "theta", "l_discount", "l_tax", "l_linenumber"]
    df = sites.counterfactuals(item_sites(spark, sf).select(*shown).distinct(), P, mode)
    made = {f"{a}_selected": m.selected_mass(f"{a}_") for a in ("xa", "xi", "xo")} | {f"{a}_high": F.col(f"{a}_high") for a in ("xa", "xi", "xo")}
    keys = ["cls", "l_discount", "l_tax", "l_linenumber"]
    return _round(df.select(*keys, *[x.alias(n) for n, x in made.items()]), 8, *made).distinct()


def counterfactual_m1(spark, sf) -> DataFrame:
    return _counterfactual(spark, sf, 1)


def counterfactual_m2(spark, sf) -> DataFrame:
    return _counterfactual(spark, sf, 2)


def _cells(spark, sf) -> DataFrame:
    """Customers' orders by nation (a covariate's values): positions and a share."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    big = F.sum(F.when(F.col("o_totalprice") > 150000, 1).otherwise(0))
    return o.groupBy(F.col("c_mktsegment").alias("cov"), F.col("c_nationkey").alias("value")).agg(F.count("*").alias("n"), big.cast("long").alias("k"))


def ordered_prefix_splits(spark, sf) -> DataFrame:
    df = _cells(spark, sf).withColumn("score", F.col("k") / F.col("n"))
    made = cov.prefix_sets(df, "value", ["score", "value"], ["cov"])
    return made.select("cov", "value", F.array_join(F.array_sort("set_values"), ",").alias("set_values"), F.array_join(F.array_sort("coset_values"), ",").alias("coset_values"))


def _splits(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    df = _cells(spark, sf).withColumn("score", F.col("k") / F.col("n"))
    up = Window.partitionBy("cov").orderBy("score", "value").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("cov")
    df = df.select("cov", "value", F.sum("n").over(up).alias("n_set"), F.sum("k").over(up).alias("k_set"), F.sum("n").over(all_).alias("n"), F.sum("k").over(all_).alias("k"))
    df = df.where("n > n_set").select("cov", "value", "n_set", (F.col("n") - F.col("n_set")).alias("n_cos"), (F.col("k_set") / F.col("n_set")).alias("rho_set"), ((F.col("k") - F.col("k_set")) / (F.col("n") - F.col("n_set"))).alias("rho_cos"))
    err = lambda s: F.sqrt(F.col(f"rho_{s}") * (1 - F.col(f"rho_{s}")) / F.col(f"n_{s}"))
    nll = lambda s: F.col(f"n_{s}") * num.binary_entropy(F.col(f"rho_{s}"))
    total = Window.partitionBy("cov")
    rho = (F.col("n_set") * F.col("rho_set") + F.col("n_cos") * F.col("rho_cos")) / (F.col("n_set") + F.col("n_cos"))
    df = df.withColumn("parent_rho", rho).withColumn("parent_nll", (F.col("n_set") + F.col("n_cos")) * num.binary_entropy(F.col("parent_rho")))
    return df.select("*", F.lit("root").alias("node_id"), F.array("value").alias("set_values"), F.array().cast("array<int>").alias("coset_values"), *[f(s).alias(f"{n}_{s}") for n, f in (("err", err), ("nll", nll)) for s in ("set", "cos")], F.count("*").over(total).alias("tests"))


def binary_entropy_gain(spark, sf) -> DataFrame:
    df = tree.score_candidates(_splits(spark, sf), tree.Options())
    return _round(df.select("cov", "value", "gain_nats", "gain_bits", "entropy_bits"), 6, "gain_nats", "gain_bits", "entropy_bits")


def best_split_per_covariate(spark, sf) -> DataFrame:
    df = tree.score_candidates(_splits(spark, sf), tree.Options(min_positions=10))
    return _round(df.where("rank_in_cov = 1").select("cov", "value", "gain_nats", "rank"), 6, "gain_nats").select("cov", "value", "gain_nats", F.col("rank").cast("long").alias("rank"))


def qc_min_positions(spark, sf) -> DataFrame:
    return tree.score_candidates(_splits(spark, sf), tree.Options(min_positions=200)).select("cov", "value", "passes")


def ordering_error(spark, sf) -> DataFrame:
    df = tree.score_candidates(_splits(spark, sf), tree.Options(max_p1=0.05, max_p2=0.2))
    return _round(df, 8, "p1", "p2").select("cov", "value", "p1", "p2", "passes")


def value_summary(spark, sf) -> DataFrame:
    df = _cells(spark, sf).select("cov", "value", "n", (F.col("k") / F.col("n")).alias("rho"))
    return _round(tree.value_summary(df), 5, "conditional_bits", "rho", "unconditional_bits")


def text_functions(spark, sf) -> DataFrame:
    df = _t(spark, sf, "part")
    return df.select("p_partkey", F.size(st.tokenize(F.col("p_name"), " ")).alias("pieces"), st.delete_chars(F.col("p_brand"), "#").alias("bare"), st.tail(F.col("p_type"), 3).alias("ending"), st.erase_tail(F.col("p_type"), 2).alias("erased"), F.reverse("p_brand").alias("reversed"), F.upper("p_name").alias("upper_name"))


def number_formats(spark, sf) -> DataFrame:
    df = _t(spark, sf, "part")
    return df.select("p_partkey", st.fixed_or_scientific(F.col("p_retailprice"), digits=3).alias("fixed"), st.thousands(F.floor("p_retailprice")).alias("grouped"))


def expected_information(spark, sf) -> DataFrame:
    """Gain expected over two uncertain shares: discounts against taxes, by quantity."""
    df = _t(spark, sf, "lineitem")
    hi = df.groupBy((F.col("l_discount") * 5.0 + 0.2).alias("value")).agg(F.sum("l_quantity").alias("w"))
    lo = df.groupBy((F.col("l_tax") * 5.0 + 0.2).alias("value")).agg(F.sum("l_quantity").alias("w"))
    gain = tree.entropy_gain(F.lit(100.0), F.col("hi"), F.lit(50.0), F.col("lo"))
    return _round(grid.expected_information(hi, lo, gain), 6, "total", "ordered")


def numeric_functions(spark, sf) -> DataFrame:
    p = F.col("l_discount") * 9.0
    df = _t(spark, sf, "lineitem").select(
        "l_discount", num.entropy_term(p).alias("term"), num.to_bits(num.binary_entropy(p)).alias("bits"), num.ratio_to_fraction(p).alias("fraction"),
        num.clamp_probability(p * 2.0).alias("clamped"), num.bell(p, F.lit(0.5)).alias("bell"), num.log_near_one(p + 0.1).alias("log"),
    )
    return _round(df.distinct(), 9, "term", "bits", "fraction", "clamped", "bell", "log").distinct()


def coverage_gaps(spark, sf) -> DataFrame:
    """Users whose days with events do not tile the month."""
    from ..sources.readers import uncovered

    ev = _t(spark, sf, "events").select(F.col("user_id").alias("chrom"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("st")).distinct()
    runs = ev.withColumn("en", F.col("st") + 1)
    days = (ev.agg(F.max("st")).first()[0] or 0) + 1  # one number
    genome = ev.select("chrom").distinct().select("chrom", F.lit(0).cast("long").alias("st"), F.lit(days).cast("long").alias("en"))
    return uncovered(runs, genome).select("chrom", "covered")


def fit_beta3(spark, sf) -> DataFrame:
    df = item_sites(spark, sf).withColumn("n", F.col("weight").cast("double"))
    b2 = fit.beta2(df, 0.2, 347.0)
    b3 = fit.beta3(df, b2, P, 347.0)
    return spark.createDataFrame([(round(1 - b2 - b3, 7), round(b2, 7), round(b3, 7))], "beta1 double, beta2 double, beta3 double")


def fit_reg(spark, sf) -> DataFrame:
    rows = _coefficients(spark, sf)
    made = fit.fit(rows, P, fit.prior_rows(spark, P, P, 347.0))
    d = [round(x, n) for x, n in zip(fit.derived(made.params).values(), (1, 1, 3, 3))]
    return spark.createDataFrame([(round(made.params.rho, 5), round(made.params.eta, 5), round(made.params.gamma, 5), round(made.nll, 1), round(made.nll_prior, 1), *d, made.converged)], "rho double, eta double, gamma double, nll double, nll_prior double, dp double, pw double, alpha double, tau double, converged boolean")


#: The model that planted sites are drawn from and fitted with, but for its rho, eta and gamma.
PLANTED = m.Params(rho=0.3, eta=1.0, gamma=1.0, lam=0.06, theta=0.03, beta1=0.75, beta2=0.2, beta3=0.05)
# Shares of the cells of the class table at rho 0.4, eta 0.8 and gamma 0.9, summed up.
PLANTED_SHARES = (("Ma", 0.80186), ("Mo", 0.85139), ("La", 0.97219), ("Li", 0.97806), ("Lo", 0.98108), ("Ha", 0.99016), ("Hi", 0.99924), ("Ho", 1.0))


def planted_sites(spark, sf) -> DataFrame:
    """Line items as sites whose class and alleles are dealt by hash in the shares of a known model.

    Discounts and taxes blur the alleles' priors, and line numbers move lambda and theta.
    """
    u = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 100003) / 100003.0
    cell = F.lit("Ho")
    for name, top in reversed(PLANTED_SHARES[:-1]):
        cell = F.when(u < top, name).otherwise(cell)
    df = _t(spark, sf, "lineitem").withColumn("cell", cell)
    place = F.substring("cell", 2, 1)
    return df.select(
        F.substring("cell", 1, 1).alias("cls"), F.when(place == "a", 1.0 - F.col("l_discount") / 50.0).when(place == "i", 0.0).otherwise((F.col("l_tax") + 0.01) / 20.0).alias("x_maj"),
        F.when(place == "a", 0.0).when(place == "i", 1.0 - F.col("l_discount") / 50.0).otherwise((F.col("l_tax") + 0.01) / 20.0).alias("x_min"),
        (0.048 + 0.003 * F.col("l_linenumber")).alias("lambda"), (0.026 + 0.001 * F.col("l_linenumber")).alias("theta"), F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("len"),
    )


def _planted(spark, sf, scale: float = 1.0) -> DataFrame:
    keys = ["cls", "x_maj", "x_min", "lambda", "theta"]
    return fit.coefficient_rows(patterns.pattern_counts(planted_sites(spark, sf), keys), PLANTED, scale=scale)


def fit_interior(spark, sf) -> DataFrame:
    """A fit whose optimum lies inside all limits, with standard errors, derived values and theirs."""
    made = fit.fit(_planted(spark, sf), PLANTED, fit.prior_rows(spark, PLANTED, PLANTED, 347.0))
    derived, errors = fit.derived(made.params), fit.derived_errors(made.params, made.hessian)
    row = {n: getattr(made.params, n) for n in fit.NAMES} | {f"{n}_err": made.errors[n] for n in fit.NAMES} | derived | {f"{k}_err": v for k, v in errors.items()} | {"nll": made.nll, "nll_prior": made.nll_prior}
    spec = ", ".join(f"{k} double" for k in row)
    out = spark.createDataFrame([tuple(row.values())], spec)
    large = ["dp", "pw", "dp_err", "pw_err", "nll", "nll_prior"]
    return _round(_round(out, 3, *large), 5, *[k for k in row if k not in large]).withColumn("converged", F.lit(made.converged))


def beta3_interior(spark, sf) -> DataFrame:
    df = planted_sites(spark, sf).withColumn("n", F.col("weight").cast("double"))
    b2 = fit.beta2(df, 0.2, 347.0)
    b3 = fit.beta3(df, b2, PLANTED, 347.0)
    return spark.createDataFrame([(round(1 - b2 - b3, 7), round(b2, 7), round(b3, 7))], "beta1 double, beta2 double, beta3 double")


#: Grid and weight of the planted sites' posterior; a site counts little, so that the mass lies on many values.
PLANTED_GRID = {"rho": grid.axis(1e-9, 1 - 1e-9, 10, []), "eta": grid.axis(1e-9, 2.0, 5, []), "gamma": grid.axis(1e-9, 2.0, 5, [])}
PLANTED_SCALE = 0.02


def posterior_interior(spark, sf) -> DataFrame:
    """Marginals of a posterior that leaves mass on many values."""
    cells = grid.parameter_posterior(_planted(spark, sf, PLANTED_SCALE), fit.prior_rows(spark, PLANTED, PLANTED, 347.0 * PLANTED_SCALE), PLANTED_GRID)
    return _round(grid.marginals(cells), 6, "prior", "post").select("axis", "value", "prior", "post")


#: A grid of some hundred cells, as its SQL goes through all of them; ``fitted_posterior`` has the operator's own.
GRID = {"rho": grid.axis(1e-9, 1 - 1e-9, 6, [(0.3, 0.2)]), "eta": grid.axis(1e-9, 10 - 1e-9, 5, []), "gamma": grid.axis(1e-9, 10 - 1e-9, 5, [])}


def parameter_posterior(spark, sf) -> DataFrame:
    marginal = grid.marginals(grid.parameter_posterior(_coefficients(spark, sf), fit.prior_rows(spark, P, P, 347.0), GRID))
    return _round(marginal, 6, "prior", "post").select("axis", "value", "prior", "post")


def posterior_cells(spark, sf) -> DataFrame:
    cells = grid.parameter_posterior(_coefficients(spark, sf), fit.prior_rows(spark, P, P, 347.0), GRID)
    small, large = ["d_rho", "d_eta", "d_gamma", "log_size", "prior_nll", "log_prior", "prior_density"], ["data_nll", "log_post", "post_density"]
    return _round(_round(cells, 2, *small), -1, *large).select("rho", "eta", "gamma", *small, *large)


def fitted_posterior(spark, sf) -> DataFrame:
    """The posterior on the operator's own grid, around the fitted mode."""
    rows, prior = _coefficients(spark, sf).cache(), fit.prior_rows(spark, P, P, 347.0)
    cells = grid.parameter_posterior(rows, prior, grid.axes(fit.fit(rows, P, prior).params))
    rows.unpersist()
    return grid.marginals(cells).select("axis", "value", "prior", "post")


def tree_growth(spark, sf) -> DataFrame:
    parts = _part_tags(spark, sf).select("p_partkey", ANN.encode(F.col("ann_tags")).alias("ann"), CTS.encode(F.col("cts_tags")).alias("tagb"))
    aligned = parts.select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("st"), (F.col("p_partkey") + 1).alias("en"), "ann", F.lit("one").alias("cell"), "tagb")
    raw = _t(spark, sf, "lineitem")
    cls = F.when(F.col("l_returnflag") == "A", "M").when(F.col("l_returnflag") == "N", "L").otherwise("H")
    s = raw.select(F.lit("c").alias("chrom"), F.col("l_partkey").alias("st"), (F.col("l_partkey") + 1).alias("en"), cls.alias("cls"), (0.9 - 3.0 * F.col("l_discount")).alias("x_maj"), F.col("l_tax").alias("x_min"), F.lit(0.004).alias("lambda"), F.lit(0.0009).alias("theta"))
    nodes = tree.grow(spark, COVSET, aligned, s, P, tree.Options(min_gain=2500.0))
    return tree.node_table(spark, nodes, COVSET)


def _part_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Parts as positions with covariates, and line items as sites on them."""
    parts = _part_tags(spark, sf).select("p_partkey", ANN.encode(F.col("ann_tags")).alias("ann"), CTS.encode(F.col("cts_tags")).alias("tagb"))
    aligned = parts.select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("st"), (F.col("p_partkey") + 1).alias("en"), "ann", F.lit("one").alias("cell"), "tagb")
    cls = F.when(F.col("l_returnflag") == "A", "M").when(F.col("l_returnflag") == "N", "L").otherwise("H")
    items = _t(spark, sf, "lineitem").select(F.lit("c").alias("chrom"), F.col("l_partkey").alias("st"), (F.col("l_partkey") + 1).alias("en"), cls.alias("cls"), (0.9 - 3.0 * F.col("l_discount")).alias("x_maj"), F.col("l_tax").alias("x_min"), F.lit(0.004).alias("lambda"), F.lit(0.0009).alias("theta"))
    return aligned, items


def split_sums(spark, sf) -> DataFrame:
    """Sites by class in every ordered set and coset of two nodes, summed from single values."""
    aligned, items = _part_runs(spark, sf)
    nodes = {"a": Subset().with_values("size", [1, 2]), "b": Subset().with_values("size", [3, 4, 5])}
    values = tree.value_patterns(aligned, cov.target_table(spark, nodes, ANN, CTS), COVSET, items)
    orders = {(n, c.name): [v for v in s.values(c) if v] for n, s in nodes.items() for c in COVSET.covariates}
    return tree.split_patterns(spark, values, orders).groupBy("subset_id", "cls").agg(F.sum("n").cast("long").alias("n"))


def growth_replay(spark, sf) -> DataFrame:
    """Orders as nodes, line numbers as levels: the last state of each in the levels that were committed.

    The sixth level is written but not committed, as by a run that died there.
    """
    rows = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("node_id"), "l_linenumber").agg(F.max("l_returnflag").alias("status"), F.sum("l_quantity").alias("n"))
    log = GrowthLog(spark, shared_path(spark, "log"))
    for level in range(1, 7):
        log.stage(level, nodes=rows.where(F.col("l_linenumber") == level).drop("l_linenumber"))
        if level < 6:
            log.seal(level)
    return log.replay().select("node_id", "status", F.round("n", 2).alias("n"))


def _text(df: DataFrame, tag: str, *columns: str, separator: str = "\t") -> str:
    """Columns written as lines of text to the shared folder; the path."""
    path = shared_path(df.sparkSession, tag)
    df.select(F.concat_ws(separator, *columns).alias("value")).write.text(path)
    return path


def blocks_file(spark, sf) -> DataFrame:
    """Orders' blocks written in the block format and read back."""
    key = F.col("block_id") % 50
    df = order_blocks(spark, sf).withColumn("pair", F.concat_ws(" ", F.format_string("%.5f", 0.001 + key * 0.00001), F.format_string("%.4f", 0.003 + key * 0.0001)))
    read = readers.read_blocks(spark, _text(df, "blocks", "chrom", "st", "en", "pair"))
    made = read.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("en") - F.col("st")).alias("positions"), F.sum(F.col("theta").cast("double")).alias("theta"), F.sum(F.col("lambda").cast("double")).alias("lam"))
    return _round(made, 6, "theta", "lam")


def polys_file(spark, sf) -> DataFrame:
    df = _t(spark, sf, "lineitem").where("l_returnflag <> 'A'").select(F.lit("c").alias("chrom"), F.col("l_partkey").alias("st"), (F.col("l_partkey") + 1).alias("en"), F.when(F.col("l_returnflag") == "N", "L").otherwise("H").alias("freq"), F.col("l_linenumber").alias("maj"), F.col("l_quantity").cast("int").alias("min"))
    read = readers.read_polys(spark, _text(df, "polys", "chrom", "st", "en", "freq", "maj", "min"))
    return read.groupBy("freq").agg(F.count("*").alias("n"), F.sum("st").alias("st"), F.sum("maj_idx").cast("long").alias("maj"), F.sum("min_idx").cast("long").alias("min"))


def dictionary_file(spark, sf) -> DataFrame:
    df = _t(spark, sf, "lineitem").select(F.round(F.col("l_discount") * 100).cast("int").alias("idx"), F.format_string("%.2f", "l_discount").alias("tag")).distinct()
    return readers.read_dictionary(spark, _text(df, "tags", "idx", "tag", separator=" "))


def mono_runs(spark, sf) -> DataFrame:
    """Bytes of parts' sizes, in pieces of a thousand positions, as runs; size 0 mod 5 is missing."""
    code = F.lpad(F.hex((F.col("p_size") % 5).cast("long")), 2, "0")
    df = _t(spark, sf, "part").select(F.expr("p_partkey div 1000").alias("piece"), F.col("p_partkey"), code.alias("code"))
    pieces = df.groupBy("piece").agg(F.min("p_partkey").alias("s"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "code"))), lambda x: x["code"]), "")).alias("bytes"))
    return readers.read_mono_chunks(pieces.select(F.lit("c").alias("chrom"), F.lit(0).cast("long").alias("lo"), "s", "bytes")).select("st", "en", "idx")


def byte_file(spark, sf) -> DataFrame:
    """Customers' balances as codes of five chromosomes, written as a byte file and read under a filter."""
    code = F.lpad(F.hex((F.floor(F.abs("c_acctbal")) % 4).cast("long")), 2, "0")
    ranked = _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("chrom"), F.col("c_custkey"), code.alias("code"))
    pieces = ranked.groupBy("chrom", F.expr("c_custkey div 500").alias("number")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "code"))).alias("held"))
    pieces = pieces.select("chrom", "number", F.unhex(F.array_join(F.transform("held", lambda x: x["code"]), "")).alias("bytes"))
    base = shared_path(spark, "bytes")
    chroms = [r.chrom for r in pieces.select("chrom").distinct().orderBy(F.desc("chrom")).collect()]  # five segments
    write_byte_file(pieces, base, chroms)
    rows = read_byte_file(spark, base, chunk=64).where(F.col("chrom").isin("BUILDING", "MACHINERY") & (F.col("en") > 20) & (F.col("st") < 5000))
    return intervals.coalesce_runs(rows, "idx").where("idx > 1").groupBy("chrom", F.col("idx").cast("int").alias("idx")).agg(F.count("*").alias("n"), F.sum("st").alias("st"), F.sum("en").alias("en"))


def clustered_table(spark, sf) -> DataFrame:
    """Line items ordered by position; those that meet the blocks of a few orders, by a filter on stretches."""
    path = shared_path(spark, "clustered")
    clustered.write_clustered(loci(spark, sf), path)
    few = order_blocks(spark, sf).where("block_id % 97 = 0")
    rows = clustered.under(spark.read.parquet(path), few)
    return intervals.overlap_join(rows, few).groupBy("block_id").agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("weight"))


def weighted_bed_file(spark, sf) -> DataFrame:
    path = shared_path(spark, "bed")
    sinks.weighted_bed(loci(spark, sf), path)
    read = readers.read_weighted_bed(spark, path, 50)
    return read.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("en") - F.col("st")).alias("positions"), F.sum((F.col("en") - F.col("st")) * F.col("weight")).alias("weighted"))


def covariate_runs_file(spark, sf) -> DataFrame:
    df = _part_tags(spark, sf).select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("st"), (F.col("p_partkey") + 1).alias("en"), "cts_tags")
    return readers.read_covariate_runs(spark, _text(df, "runs", "chrom", "st", "en", "cts_tags"), CTS, "one").select("st", "en", "tagb", "cell")


def genome_file(spark, sf) -> DataFrame:
    df = loci(spark, sf).groupBy("chrom").agg(F.max("en").alias("en")).withColumn("st", F.lit(0))
    return readers.reference_genome(spark, _text(df, "genome", "chrom", "st", "en")).select("chrom", "st", "en")


def models_file(spark, sf) -> DataFrame:
    """Nations' numbers as result files, a region a job and a section of sums after them, read back and checked."""
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("job"), F.lit("PARAMETERS").alias("section"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    sums = rows.groupBy("job").agg(F.count("*").cast("string").alias("value")).select("job", F.lit("STATS").alias("section"), F.lit("Nations").alias("key"), "value")
    path = shared_path(spark, "models")
    sinks.model_text(rows.unionByName(sums)).write.partitionBy("job").text(path)
    return readers.read_models(spark, f"{path}/*").select(F.url_decode(F.regexp_extract("job", "job=([^/]*)", 1)).alias("job"), "section", "key", "value")


def whole_models(spark, sf) -> DataFrame:
    """Nations' segments as jobs with the required fields; of those with an odd number of customers one is negative."""
    c = _t(spark, sf, "customer").groupBy(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("job")).agg(F.count("*").alias("n"))
    fields = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key")) for s, k in readers.REQUIRED]))
    rows = c.withColumn("field", fields).select("job", "field.section", "field.key", F.when((F.col("field.key") == "maxSampW") & (F.col("n") % 2 == 1), -1).otherwise(F.col("n")).cast("string").alias("value"))
    return readers.whole_models(rows).groupBy("job").agg(F.count("*").alias("fields"))


def interchange_file(spark, sf) -> DataFrame:
    """Orders' blocks with line items as sites, in the older line format, read back."""
    blocks = order_blocks(spark, sf).withColumn("theta", F.lit(0.001).cast("float")).withColumn("lambda", F.lit(0.004).cast("float"))
    own = item_sites(spark, sf).select("cls", "x_maj", "x_min")
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block_id"), (F.col("l_orderkey") % 100).cast("string").alias("chrom"), _days("l_shipdate").alias("pos"), F.when(F.col("l_returnflag") == "A", "M").when(F.col("l_returnflag") == "N", "L").otherwise("H").alias("cls"), F.lit(0.9).alias("x_maj"), F.col("l_tax").alias("x_min"))
    path = shared_path(spark, "interchange")
    sinks.write_lines(sinks.interchange_lines(blocks, items.select("block_id", "chrom", "pos", *own.columns), P.alleles, (0.75, 0.2, 0.05)), path)
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("block ")).select(*readers.parse_block_header(F.col("value")))
    made = head.groupBy("chrom").agg(F.count("*").alias("blocks"), F.sum(F.col("en") - F.col("st")).alias("positions"), F.sum(F.col("theta").cast("double")).alias("theta"))
    at = lines.where(F.col("value").startswith("site ")).select(F.regexp_extract("value", r"^site (\S+):(\d+)\t(\w)", 1).alias("chrom"), F.regexp_extract("value", r"^site (\S+):(\d+)\t(\w)", 2).cast("long").alias("pos"))
    return _round(made.join(at.groupBy("chrom").agg(F.count("*").alias("sites"), F.sum("pos").alias("position_sum")), "chrom"), 6, "theta")


def table_cache(spark, sf) -> DataFrame:
    made = readers.as_table(loci(spark, sf), shared_path(spark, "cache"))
    return made.groupBy(F.col("chrom").cast("string").alias("chrom")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def partition_report(spark, sf) -> DataFrame:
    """Scored splits as the tree's report has them, stored and read back."""
    path = shared_path(spark, "partitions")
    sinks.partition_table(tree.score_candidates(_splits(spark, sf), tree.Options(min_positions=10))).write.parquet(path)
    return _round(spark.read.parquet(path), 6, "gain_nats").select("cov", "value", "gain_nats", F.col("rank").cast("long").alias("rank"), "best", "best_of_covariate")


def sorted_tags(spark, sf) -> DataFrame:
    """Covariate values as tags of two digits, in order."""
    tag = F.lpad((F.col("l_partkey") % 37).cast("string"), 2, "0")
    return _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_join(cov.sorted_tags(tag), ",").alias("tags"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        overlap_join, mixed_lengths, overlap_clip, interval_advance, interval_compare, point_in_block, neutral_semi, interval_positions, linear_positions,
        pattern_counts, pattern_expand, site_counters, interval_stats, pattern_totals, shrunk_mean, ratio_pseudocount, class_matrix,
        block_normalised_matrix, coalesce_runs, breakpoint_segments, asof_state, aligned_counts, onehot_encode, mask_filter, mask_targets,
        mask_accumulate, logsumexp, log_normalise, grid_marginals, weighted_expectation, interp_quantile, mixture_nll, mixture_gradient,
        mixture_hessian, coefficient_projection, prior_pseudo_rows, lambda_theta, beta2_ratio, site_posterior, posterior_sum, allele_joint,
        counterfactual_m1, counterfactual_m2, ordered_prefix_splits, binary_entropy_gain, best_split_per_covariate, qc_min_positions,
        ordering_error, value_summary, text_functions, number_formats, expected_information, numeric_functions, coverage_gaps, fit_beta3, fit_reg, parameter_posterior, posterior_cells, fitted_posterior,
        tree_growth, blocks_file, polys_file, dictionary_file, mono_runs, weighted_bed_file, covariate_runs_file, genome_file, models_file, whole_models, interchange_file, table_cache,
        partition_report, sorted_tags, split_sums, growth_replay, byte_file, clustered_table, fit_interior, beta3_interior, posterior_interior,
    ]
    return {f.__name__: f for f in made}
