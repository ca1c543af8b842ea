"""One fit from intervals to parameters, and the per-site outputs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Params
from ..operators import grid as g
from ..operators import patterns, sites
from ..operators.intervals import levels_of, locate, overlap_join, positions
from ..sources.clustered import stretches, within
from . import fit as f

# Genome-wide prior means and their weight in pseudo-sites, for all sites and for neutral ones.
HG19 = Params(
    rho=0.07342932116859754443, eta=0.00021737936739721811, gamma=0.64059032649056757425, lam=0.00387775695968175290, theta=0.00094993578249541130,
    beta1=0.75666287190656289496, beta2=0.20531421372189487262, beta3=0.03802291437154223242,
)
HG19_NEUTRAL = replace(HG19, rho=0.0, lam=0.00390664095888410348, theta=0.00096222208636776438)
HG19_PRIOR_WEIGHT = 347.0


@dataclass(frozen=True)
class Config:
    prior: Params = HG19
    neutral_prior: Params = HG19_NEUTRAL
    prior_weight: float = HG19_PRIOR_WEIGHT
    max_weight: float = 1.0
    min_eta: float = 0.0
    fixed: tuple[str, ...] = ()
    refine_lambda_theta: bool = True
    refine_beta: bool = True
    #: Keep only the blocks that have polymorphisms when choosing neutral sites.
    poly_blocks_only: bool = False
    resolution: int = 10


@dataclass
class Database:
    """Blocks, polymorphic sites, neutral ones, monomorphic runs and the dictionary."""

    blocks: DataFrame
    polys: DataFrame
    neutral: DataFrame
    mono: DataFrame
    dictionary: DataFrame


@dataclass
class Result:
    fit: f.Fit
    derived: dict
    derived_errors: dict
    stats: dict
    patterns: DataFrame
    prior_rows: DataFrame | None
    config: Config
    neutral: Params
    neutral_stats: dict


class Engine:
    """Answers questions over weighted intervals against one database."""

    def __init__(self, db: Database):
        self.db = db
        codes = db.dictionary.select("idx", "p")  # at most 256 codes
        self._codes = F.broadcast(codes)
        self._found: dict[str, list[int]] = {}

    def _levels(self, table: str) -> list[int]:
        """The levels of bins that a table's intervals sit in, looked up once."""
        if table not in self._found:
            self._found[table] = levels_of(getattr(self.db, table))
        return self._found[table]

    def _decoded(self, df: DataFrame) -> DataFrame:
        a = self._codes.select(F.col("idx").alias("maj_idx"), F.col("p").alias("x_maj"))
        i = self._codes.select(F.col("idx").alias("min_idx"), F.col("p").alias("x_min"))
        return df.join(F.broadcast(a), "maj_idx").join(F.broadcast(i), "min_idx", "left").withColumn("x_min", F.coalesce("x_min", F.lit(0.0)))

    def sites(self, loci: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
        """Runs of sites of one block, class and pattern under the loci.

        Columns: ``keys`` of the loci, block_id, chrom, st, en, cls, maj_idx, min_idx, weight, len. A pair of
        overlapping loci counts the sites that they share twice. A filter on the loci's
        stretches goes to the scans, which skip what lies outside where tables are clustered.
        """
        held = within(stretches(loci))
        levels = levels_of(loci)
        under = overlap_join(loci.select(*keys, "chrom", "st", "en", "weight"), self.db.blocks.where(held).select("chrom", "st", "en", "block_id"), levels=(levels, self._levels("blocks")))
        under = under.select(*keys, "chrom", "st", "en", "weight", "block_id")
        shared = list(range(max(levels, default=0) + 1))  # what is cut out of loci is not longer than they are
        mono = overlap_join(under, self.db.mono.where("idx <> 0").where(held), levels=(shared, self._levels("mono")))
        mono = mono.select(*keys, "block_id", "chrom", "st", "en", F.lit("M").alias("cls"), F.col("idx").alias("maj_idx"), F.lit(None).cast("short").alias("min_idx"), "weight")
        poly = overlap_join(under, self.db.polys.where(held), levels=(shared, self._levels("polys")))
        poly = poly.select(*keys, "block_id", "chrom", "st", "en", F.col("freq").alias("cls"), "maj_idx", "min_idx", "weight")
        return mono.unionByName(poly).withColumn("len", F.col("en") - F.col("st"))

    def neutral_sites(self, touched: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
        """Neutral polymorphisms of blocks that have data, for each of the ``keys`` of ``touched``."""
        placed = locate(self.db.neutral.withColumn("pos", F.col("st")), self.db.blocks.select("chrom", "st", "en", "block_id"))
        kept = placed.join(touched.select(*keys, "block_id").distinct(), "block_id")
        return kept.select(*keys, "block_id", F.col("freq").alias("cls"), "maj_idx", "min_idx", F.lit(1).alias("weight"), F.lit(1).alias("len"))

    def pattern_rows(self, sites_: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
        """Pattern counts with decoded priors and their block's lambda and theta, by ``keys`` if given."""
        counts = patterns.pattern_counts(sites_, [*keys, "block_id", "cls", "maj_idx", "min_idx"])
        rows = self._decoded(counts).join(self.db.blocks.select("block_id", "lambda", "theta"), "block_id")
        return rows.select(*keys, "block_id", "cls", "x_maj", "x_min", F.col("lambda").cast("double"), F.col("theta").cast("double"), "n")

    def runs(self, loci: DataFrame) -> DataFrame:
        """Runs of sites with decoded priors and block values, as the tree takes them."""
        rows = self._decoded(self.sites(loci)).join(self.db.blocks.select("block_id", "lambda", "theta"), "block_id")
        return rows.select("chrom", "st", "en", "cls", "x_maj", "x_min", F.col("lambda").cast("double"), F.col("theta").cast("double"))

    def neutral_positions(self, touched: DataFrame) -> DataFrame:
        """A row per neutral polymorphism of blocks ``touched``: block_id, chrom, pos, cls, x_maj, x_min."""
        placed = locate(self.db.neutral.withColumn("pos", F.col("st")), self.db.blocks.select("chrom", "st", "en", "block_id"))
        kept = placed.join(touched.select("block_id").distinct(), "block_id", "left_semi")
        return self._decoded(kept.withColumnRenamed("freq", "cls")).select("block_id", "chrom", "pos", "cls", "x_maj", "x_min")

    def decoded_positions(self, loci: DataFrame) -> DataFrame:
        """A row per site under the loci: block_id, chrom, pos, cls, x_maj, x_min."""
        return positions(self._decoded(self.sites(loci))).select("block_id", "chrom", "pos", "cls", "x_maj", "x_min")

    def fit(self, loci: DataFrame, config: Config = Config(), start: dict | None = None) -> Result:  # noqa: B008
        """Lambda, theta and betas, then rho, eta and gamma; ``start`` holds first values."""
        scale, w, prior = 1.0 / config.max_weight, config.prior_weight, config.prior
        found = self.sites(loci).cache()
        rows = self.pattern_rows(found).cache()
        touched = rows.where("cls <> 'M'") if config.poly_blocks_only else rows
        neutral_sites = self.neutral_sites(touched).cache()
        neutral = self.pattern_rows(neutral_sites).cache()
        params = replace(prior, **(start or {}))
        if config.refine_lambda_theta:
            lam, theta = f.lambda_theta(rows, "n", prior, w, scale)
            params = replace(params, lam=lam, theta=theta)
        if config.refine_beta:
            b2 = f.beta2(neutral, prior.beta2, w)
            b3 = f.beta3(neutral, b2, config.neutral_prior, w)
            params = replace(params, beta1=1 - b2 - b3, beta2=b2, beta3=b3)
        # The neutral model's lambda and theta weigh each block that has data by its length.
        blocks = self.db.blocks.withColumn("len", F.col("en") - F.col("st")).join(touched.select("block_id").distinct(), "block_id", "left_semi")
        lam, theta = f.lambda_theta(blocks, "len", config.neutral_prior, w, scale)
        neutral_model = replace(config.neutral_prior, lam=lam, theta=theta, beta1=params.beta1, beta2=params.beta2, beta3=params.beta3)
        data = f.coefficient_rows(rows, params, scale=scale)
        pseudo = f.prior_rows(loci.sparkSession, params, prior, w) if w > 0 else None
        made = f.fit(data, params, pseudo, config.fixed, config.min_eta)
        stats = {**patterns.loci_info(loci).first().asDict(), **patterns.site_counters(found).first().asDict()}
        neutral_stats = patterns.site_counters(neutral_sites).first().asDict()
        neutral.unpersist()
        neutral_sites.unpersist()
        found.unpersist()
        return Result(made, f.derived(made.params), f.derived_errors(made.params, made.hessian), stats, rows, pseudo, config, neutral_model, neutral_stats)

    def posterior(self, result: Result) -> dict[str, DataFrame]:
        """Grid posterior of the parameters, marginals, expectations and intervals."""
        scale = 1.0 / result.config.max_weight
        data = f.coefficient_rows(result.patterns, result.fit.params, scale=scale).cache()
        prior = result.prior_rows if result.prior_rows is not None else data.limit(0)
        values = g.axes(result.fit.params, result.config.resolution)
        whole = g.parameter_posterior(data, prior, values).cache()
        marginal = g.marginals(whole).cache()
        return {"grid": whole, "marginals": marginal, "expectation": g.expectation(marginal, "value", "post", ["axis"]), "quantiles": g.quantiles(marginal, [0.025, 0.5, 0.975])}

    def site_posteriors(self, loci: DataFrame, params: Params, what: str = "posterior", mode: int = 1) -> DataFrame:
        """A row per position under the loci, with its latent posterior.

        ``what`` is posterior, alleles or counterfactual. Each site carries the weight
        of the locus that holds it.
        """
        per = positions(self._decoded(self.sites(loci))).join(self.db.blocks.select("block_id", "lambda", "theta"), "block_id")
        if what == "alleles":
            return sites.allele_posteriors(per, params)
        return sites.counterfactuals(per, params, mode) if what == "counterfactual" else sites.posteriors(per, params)

    def summary(self, loci: DataFrame) -> dict[str, DataFrame]:
        """Expected ancestral alleles by class: raw, weighted, and per block."""
        rows = self._decoded(self.sites(loci)).withColumn("w", (F.col("weight") * F.col("len")).cast("double"))
        one = positions(rows).withColumn("p_maj", F.col("x_maj")).withColumn("p_min", F.col("x_min")).withColumn("weight", F.col("weight").cast("double"))
        return {"raw": patterns.class_matrix(one), "weighted": patterns.class_matrix(one, "weight"), "per_block": patterns.block_normalised_matrix(one)}
