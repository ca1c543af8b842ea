"""Command line: fit interval files, give site outputs, or grow a tree.

    python -m intervale.cli fit DATABASE LOCI.bed -o OUT --map
    python -m intervale.cli tree COVSET DATABASE RUNS GENOME -o OUT
    python -m intervale.cli convert DATABASE -o TABLES

A database is a folder with block.bedg, poly.bedg, polyn.bedg and monoDB.chroms,
.db and .tags, or with the tables that ``convert`` makes of these once. A parameter is ``start[,refine[,prior]]``: its first value, whether
it is fitted (1 or 0), and its prior's value.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .operators.covset import Layout, Subset, parse_covset
from .operators.intervals import align
from .plans import tree
from .plans.engine import HG19, HG19_NEUTRAL, HG19_PRIOR_WEIGHT, Config, Database, Engine
from .plans.growth_log import GrowthLog
from .sources import readers, sinks


def parameter(text: str) -> tuple[float, bool, float]:
    """``start[,refine[,prior]]``; the prior is the start where it is not given."""
    parts = text.split(",")
    start = float(parts[0])
    return start, len(parts) < 2 or bool(int(parts[1])), float(parts[2]) if len(parts) > 2 else start


def betas(text: str) -> tuple[float, float, float]:
    values = [float(x) for x in text.split(",")]
    total = sum(values)
    return tuple(v / total for v in values)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="intervale", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    kinds = top.add_subparsers(dest="command", required=True)
    f = kinds.add_parser("fit", help="fit the model to weighted intervals")
    f.add_argument("database")
    f.add_argument("loci")
    f.add_argument("-o", "--out", required=True)
    f.add_argument("--map", action="store_true", help="write the most probable parameters")
    f.add_argument("--expect", action="store_true", help="write posterior expectations as the parameters")
    f.add_argument("--distribution", action="store_true", help="write the posterior grid and its marginals")
    f.add_argument("--resolution", type=int, default=10)
    for name in ("rho", "eta", "gamma", "lambda", "theta"):
        f.add_argument(f"--{name}", type=parameter, metavar="START[,REFINE[,PRIOR]]")
    f.add_argument("--lambda-neutral", type=float)
    f.add_argument("--theta-neutral", type=float)
    f.add_argument("--betas", type=betas, metavar="B1,B2,B3")
    f.add_argument("--alleles", type=int, default=HG19.alleles)
    f.add_argument("--max-weight", type=float, default=1.0)
    f.add_argument("--prior-weight", type=float, default=HG19_PRIOR_WEIGHT)
    f.add_argument("--min-eta", type=float, default=0.0)
    f.add_argument("--poly-blocks-only", action="store_true")
    f.add_argument("--summary", action="store_true", help="tables of expected ancestral alleles")
    f.add_argument("--sites", choices=("posterior", "alleles", "counterfactual"), action="append", default=[])
    f.add_argument("--counterfactual-mode", type=int, choices=(1, 2), default=1)
    f.add_argument("--interchange", action="store_true", help="sites in the older line format")
    t = kinds.add_parser("tree", help="grow a decision tree over covariates")
    t.add_argument("covset")
    t.add_argument("database")
    t.add_argument("runs", help="folder with a run file per cell type, named CELL.bedg, and ANN.bedg")
    t.add_argument("-o", "--out", required=True)
    t.add_argument("--genome")
    t.add_argument("--min-gain", type=float, default=100.0)
    t.add_argument("--max-depth", type=int, default=5)
    t.add_argument("--min-positions", type=int, default=0)
    t.add_argument("--max-order-error", type=float)
    t.add_argument("--max-half-error", type=float)
    t.add_argument("--min-directed-bits", type=float)
    t.add_argument("--by-entropy", action="store_true")
    t.add_argument("--implied-rho", action="store_true")
    t.add_argument("--chromosome", help="use one chromosome only")
    t.add_argument("--cells", nargs="+", required=True)
    t.add_argument("--levels", type=int, help="stop after so many levels; open nodes stay pending")
    t.add_argument("--first-subset", metavar="TEMPLATE", help="grow from this subset of the genome, as in ANN:*:CTS:{rna;1,2}")
    t.add_argument("--log", metavar="FOLDER", help="commit each level there, and go on from its last whole level")
    t.add_argument("--restart", metavar="NODES", help="go on from the pending nodes of a stored table")
    t.add_argument("--expected", action="store_true", help="score splits by expected gain too")
    c = kinds.add_parser("convert", help="turn a database's files into tables")
    c.add_argument("database")
    c.add_argument("-o", "--out", required=True)
    return top


def config(a: argparse.Namespace) -> tuple[Config, dict]:
    """Fitting options, and the parameters' first values."""
    start, prior, fixed = {}, {}, []
    for flag, name in (("rho", "rho"), ("eta", "eta"), ("gamma", "gamma"), ("lambda", "lam"), ("theta", "theta")):
        if (given := getattr(a, flag)) is not None:
            start[name], refine, prior[name] = given
            if not refine:
                fixed.append(name)
    model = replace(HG19, alleles=a.alleles, **prior)
    if a.betas:
        model = replace(model, beta1=a.betas[0], beta2=a.betas[1], beta3=a.betas[2])
    neutral = replace(HG19_NEUTRAL, alleles=a.alleles, beta1=model.beta1, beta2=model.beta2, beta3=model.beta3)
    neutral = replace(neutral, lam=a.lambda_neutral or neutral.lam, theta=a.theta_neutral or neutral.theta)
    made = Config(
        prior=model, neutral_prior=neutral, prior_weight=a.prior_weight, max_weight=a.max_weight, min_eta=a.min_eta, resolution=a.resolution,
        fixed=tuple(n for n in fixed if n in ("rho", "eta", "gamma")), refine_lambda_theta=not {"lam", "theta"} & set(fixed), poly_blocks_only=a.poly_blocks_only,
    )
    return made, start


TABLES = ("blocks", "polys", "neutral", "mono", "dictionary")


def database(spark: SparkSession, path: str) -> Database:
    try:
        return Database(*[spark.read.parquet(f"{path}/{t}.parquet") for t in TABLES])
    except AnalysisException:  # no tables: the files
        pass
    mono = f"{path}/monoDB"
    return Database(
        readers.read_blocks(spark, f"{path}/block.bedg"), readers.read_polys(spark, f"{path}/poly.bedg"), readers.read_polys(spark, f"{path}/polyn.bedg"),
        readers.read_mono(spark, mono), readers.read_dictionary(spark, f"{mono}.tags"),
    )


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    made = database(spark, a.database)
    for t in TABLES:
        path = f"{a.out}/{t}.parquet"
        if t == "dictionary":
            made.dictionary.write.mode("overwrite").parquet(path)
        else:
            readers.as_table(getattr(made, t), path)


def fit(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.time()
    options, start = config(a)
    engine = Engine(database(spark, a.database))
    loci = readers.read_weighted_bed(spark, a.loci, int(a.max_weight))
    result = engine.fit(loci, options, start)
    made, mode = result.fit, "MaxAPosteriori" if a.prior_weight > 0 else "MaxLikelihood"
    if a.expect or a.distribution:
        out = engine.posterior(result)
        if a.distribution:
            out["grid"].write.mode("overwrite").parquet(f"{a.out}/posterior_grid")
        for name in ("marginals", "expectation", "quantiles"):
            out[name].write.mode("overwrite").parquet(f"{a.out}/posterior_{name}")
        if a.expect:
            sinks.summary_row(spark, made).write.mode("overwrite").parquet(f"{a.out}/map")
            values = {r.axis: r.expectation for r in out["expectation"].collect()}
            # The errors stay those of the most probable parameters.
            made, mode = replace(made, params=replace(made.params, **values)), "Expectation"
    given = {k: v for k, v in vars(a).items() if v is not None and k != "command"} | {"maxSampW": a.max_weight}
    rows = sinks.model_rows(spark, a.loci, made, result.stats, result.neutral_stats, options.prior, given, result.neutral, options.neutral_prior)
    rows.write.mode("overwrite").parquet(f"{a.out}/model")
    sinks.model_text(rows).select("value").write.mode("overwrite").text(f"{a.out}/model_text")
    sinks.summary_row(spark, made, mode, time.time() - began).write.mode("overwrite").parquet(f"{a.out}/summary")
    for what in a.sites:
        engine.site_posteriors(loci, made.params, what, a.counterfactual_mode).write.mode("overwrite").parquet(f"{a.out}/sites_{what}")
    if a.summary:
        for name, df in engine.summary(loci).items():
            df.write.mode("overwrite").parquet(f"{a.out}/alleles_{name}")
    if a.interchange:
        p = made.params
        for name, per, betas_ in (("interchange", engine.decoded_positions(loci), (p.beta1, p.beta2, p.beta3)), ("interchange_neutral", engine.neutral_positions(result.patterns), None)):
            blocks = engine.db.blocks.join(per.select("block_id").distinct(), "block_id", "left_semi")  # blocks without sites have no line
            sinks.write_lines(sinks.interchange_lines(blocks, per, p.alleles, betas_), f"{a.out}/{name}")


def grow(spark: SparkSession, a: argparse.Namespace) -> None:
    with open(a.covset, encoding="utf-8") as f:
        covset = parse_covset(f.read())
    ann = readers.read_covariate_runs(spark, f"{a.runs}/ANN.bedg", Layout.of(covset.of(False)))
    cells = None
    for cell in a.cells:
        part = readers.read_covariate_runs(spark, f"{a.runs}/{cell}.bedg", Layout.of(covset.of(True)), cell)
        cells = part if cells is None else cells.unionByName(part)
    genome = readers.reference_genome(spark, a.genome)
    if (gaps := readers.uncovered(cells, genome, ["cell"]).unionByName(readers.uncovered(ann, genome), allowMissingColumns=True).take(1)) and not a.chromosome:
        raise SystemExit(f"runs do not tile the genome: {gaps[0].asDict()}")
    engine = Engine(database(spark, a.database))
    if a.chromosome:
        ann, cells, genome = (df.where(F.col("chrom") == a.chromosome) for df in (ann, cells, genome))
    whole = genome.select("chrom", "st", "en", F.lit(1).alias("weight"))
    options = tree.Options(
        a.min_gain, a.max_depth, a.min_positions, a.max_order_error, a.max_half_error, a.min_directed_bits, a.expected, a.by_entropy, a.implied_rho
    )
    before = tree.load_nodes(spark.read.parquet(a.restart), covset, HG19) if a.restart else None
    kept: dict[str, list[DataFrame]] = {}
    log = GrowthLog(spark, a.log) if a.log else None
    first = Subset.parse(a.first_subset, covset) if a.first_subset else Subset()
    nodes = tree.grow(spark, covset, align(ann, cells), engine.runs(whole), HG19, options, len(a.cells), before, a.levels, kept, first, log)
    if log is not None:  # reports of levels that an earlier run has committed
        kept = {name: [df.drop("level")] for name in kept if (df := log.read(name)) is not None}
    tree.node_table(spark, nodes, covset).write.mode("overwrite").parquet(f"{a.out}/nodes")
    for name, levels in kept.items():
        table = levels[0]
        for df in levels[1:]:
            table = table.unionByName(df)
        if name == "partitions":
            table = sinks.partition_table(table)
        else:
            tree.value_summary(table).write.mode("overwrite").parquet(f"{a.out}/single_summary")
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"intervale {a.command}").getOrCreate()
    ship(spark)
    {"fit": fit, "tree": grow, "convert": convert}[a.command](spark, a)


if __name__ == "__main__":
    main()
