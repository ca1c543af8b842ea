"""Categorical covariates: definitions, subsets, bit layouts and candidate splits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_NAME, NULL_TEXT = "NULL", "MissingValue"
MAX_BITS = 48


@dataclass(frozen=True)
class Covariate:
    name: str
    cell_specific: bool
    monotonic: bool
    #: (mnemonic, description) by value; value 0 is the missing one.
    values: tuple[tuple[str, str], ...]
    digits: int = 1

    @property
    def top(self) -> int:
        return len(self.values) - 1


@dataclass(frozen=True)
class Covset:
    name: str
    annotation_dir: str
    cell_dir: str
    covariates: tuple[Covariate, ...]

    def of(self, cell_specific: bool) -> list[Covariate]:
        return [c for c in self.covariates if c.cell_specific == cell_specific]

    def __getitem__(self, name: str) -> Covariate:
        return next(c for c in self.covariates if c.name == name)


def parse_covset(text: str) -> Covset:
    """Read a definition: ``covset name dir dir``, then stanzas
    ``covariate name CTS|ANN MONO|NONMONO digits count`` with one
    ``value mnemonic description`` line a value, and ``end``.
    Lines that begin with # are notes.
    """
    head, covariates, current = None, [], None
    for line in text.splitlines():
        parts = line.split()
        if not parts or parts[0].startswith("#"):
            continue
        if parts[0] == "covset":
            head = parts[1:4]
        elif parts[0] == "covariate":
            current = {"name": parts[1], "cts": parts[2].upper() == "CTS", "mono": parts[3].upper() == "MONO", "digits": int(parts[4]), "count": int(parts[5]), "values": [(NULL_NAME, NULL_TEXT)]}
            covariates.append(current)
        elif parts[0] == "end":
            break
        elif current is None:
            raise ValueError(f"a value before any covariate: {line!r}")
        else:
            value = int(parts[0])
            if value == 0:
                continue
            if value != len(current["values"]):
                raise ValueError(f"{current['name']}: value {value} where {len(current['values'])} is due")
            current["values"].append((parts[1], " ".join(parts[2:])))
    if head is None or len(head) < 3:
        raise ValueError("no covset line")
    for c in covariates:
        if len(c["values"]) - 1 != c["count"]:
            raise ValueError(f"{c['name']}: {len(c['values']) - 1} values, {c['count']} declared")
    return Covset(*head, tuple(Covariate(c["name"], c["cts"], c["mono"], tuple(c["values"]), c["digits"]) for c in covariates))


@dataclass(frozen=True)
class Layout:
    """Bits of the covariates of one kind: each has top + 1 bits, earlier ones higher."""

    covariates: tuple[Covariate, ...]
    offsets: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(covariates: list[Covariate]) -> Layout:
        offsets, at = {}, 0
        for c in reversed(covariates):
            offsets[c.name] = at
            at += c.top + 1
        if at > MAX_BITS:
            raise ValueError(f"{at} bits; {MAX_BITS} fit")
        return Layout(tuple(covariates), offsets)

    def bits(self, name: str, values) -> int:
        return reduce(lambda m, v: m | 1 << (v + self.offsets[name]), values, 0)

    def encode(self, tags: Column) -> Column:
        """Fixed-width digits as one-hot bits; null where a value is out of range."""
        out, at = F.lit(0).cast("long"), 1
        for c in self.covariates:
            v = F.substring(tags, at, c.digits).try_cast("int")
            bit = F.when(v.between(0, c.top), F.call_function("shiftleft", F.lit(1).cast("long"), (v + self.offsets[c.name]).cast("int")))
            out, at = out.bitwiseOR(bit), at + c.digits
        return out

    def decode(self, bits: Column) -> Column:
        """One-hot bits as fixed-width digits."""
        parts = []
        for c in self.covariates:
            v = F.coalesce(*[F.when(bits.bitwiseAND(F.lit(1 << (i + self.offsets[c.name]))) != 0, F.lit(str(i).zfill(c.digits))) for i in range(c.top + 1)])
            parts.append(v)
        return F.concat(*parts)


@dataclass(frozen=True)
class Subset:
    """Allowed values of each covariate; those not named are free."""

    allowed: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def values(self, c: Covariate) -> tuple[int, ...]:
        return self.allowed.get(c.name) or tuple(range(c.top + 1))

    def with_values(self, name: str, values) -> Subset:
        return replace(self, allowed={**self.allowed, name: tuple(sorted(values))})

    def mask(self, layout: Layout) -> int:
        return reduce(lambda m, c: m | layout.bits(c.name, self.values(c)), layout.covariates, 0)

    def template(self, covset: Covset) -> str:
        """``ANN:{cov;v,v},...:CTS:{cov;v},...``; a free kind is ``*``."""
        made = []
        for kind, cts in (("ANN", False), ("CTS", True)):
            stanzas = [f"{{{c.name};{','.join(map(str, self.allowed[c.name]))}}}" for c in covset.of(cts) if self.allowed.get(c.name)]
            made.append(f"{kind}:{','.join(stanzas) or '*'}")
        return ":".join(made)

    @staticmethod
    def parse(text: str, covset: Covset) -> Subset:
        allowed: dict[str, tuple[int, ...]] = {}
        for stanza in text.replace(" ", "").split("{")[1:]:
            name, _, values = stanza.split("}")[0].partition(";")
            if values and values != "*":
                allowed[name] = tuple(sorted({int(v) for v in values.split(",")}))
                if allowed[name][-1] > covset[name].top:
                    raise ValueError(f"{name} has no value {allowed[name][-1]}")
        return Subset(allowed)

    def can_split(self, covset: Covset) -> bool:
        return any(len([v for v in self.values(c) if v]) > 1 for c in covset.covariates)


def in_set(record: Column, mask) -> Column:
    """Every bit of the record is in the mask."""
    return record.bitwiseAND(mask if isinstance(mask, Column) else F.lit(mask)) == record


def sorted_tags(tag: Column) -> Column:
    """Aggregate: the distinct tags of all rows in byte order."""
    return F.array_sort(F.collect_set(tag))


def mask_of(values: Column) -> Column:
    """Aggregate: the bits of all rows together."""
    return F.bit_or(values)


def ordered_splits(subset: Subset, c: Covariate, scores: dict[int, float] | None = None) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(set, coset) for every cut of a covariate's ordered values.

    The missing value takes part in no split. Values that are not ordered by nature
    are ordered by ``scores``, ties by value.
    """
    values = [v for v in subset.values(c) if v]
    if scores is not None and not c.monotonic:
        values.sort(key=lambda v: (scores.get(v, 0.0), v))
    return [(tuple(sorted(values[:i])), tuple(sorted(values[i:]))) for i in range(1, len(values))]


def prefix_sets(df: DataFrame, value: str, order: list, keys: list[str]) -> DataFrame:
    """For rows in order within keys: the values up to each row, and those after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("set_values", F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("coset_values", F.collect_list(value).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return rows.where(F.size("coset_values") > 0)


def target_table(spark: SparkSession, subsets: dict[str, Subset], annotation: Layout, cells: Layout) -> DataFrame:
    """Candidate targets as masks: subset_id, mask_ann, mask_cts; one row a candidate."""
    return spark.createDataFrame([(k, s.mask(annotation), s.mask(cells)) for k, s in subsets.items()], "subset_id string, mask_ann long, mask_cts long")


def count_targets(aligned: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells of each segment that fall in each target: subset_id, chrom, st, en, n.

    The annotation is tested first; targets are broadcast, as there is one row a
    candidate. Segments without a hit have no row.
    """
    hits = aligned.join(F.broadcast(targets), in_set(F.col("ann"), F.col("mask_ann")) & in_set(F.col("tagb"), F.col("mask_cts")))
    return hits.groupBy("subset_id", "chrom", "st", "en").agg(F.count("*").alias("n"))


def row_values(covset: Covset, annotation: Layout, cells: Layout, ann: str = "ann", tagb: str = "tagb") -> Column:
    """The covariates' values of a row of one-hot bits, as an array of (cov, value)."""
    made = []
    for layout, bits in ((annotation, F.col(ann)), (cells, F.col(tagb))):
        for c in layout.covariates:
            value = F.coalesce(*[F.when(bits.bitwiseAND(F.lit(1 << (i + layout.offsets[c.name]))) != 0, F.lit(i)) for i in range(c.top + 1)])
            made.append(F.struct(F.lit(c.name).alias("cov"), value.alias("value")))
    return F.array(*made)


def count_values(aligned: DataFrame, nodes: DataFrame, covset: Covset, annotation: Layout, cells: Layout) -> DataFrame:
    """Cells of each segment by node, covariate and single value: node_id, cov, value, chrom, st, en, n.

    ``nodes`` (subset_id, mask_ann, mask_cts) are the open nodes of a level, which hold
    no row in common. A row is looked at once for each covariate, however many sets of
    values are to be tried: the counts of a set are sums of these.
    """
    hits = aligned.join(F.broadcast(nodes), in_set(F.col("ann"), F.col("mask_ann")) & in_set(F.col("tagb"), F.col("mask_cts")))
    listed = hits.select(F.col("subset_id").alias("node_id"), "chrom", "st", "en", F.explode(row_values(covset, annotation, cells)).alias("v"))
    return listed.groupBy("node_id", "v.cov", "v.value", "chrom", "st", "en").agg(F.count("*").alias("n"))


def prefix_sums(values: DataFrame, ranks: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """Sums over every cut of ordered values: node_id, cov, cut, side, ``keys``, ``measure``.

    ``values`` has sums by (node_id, cov, value, ``keys``), ``ranks`` the order of each
    covariate's values: node_id, cov, value, rank from 1 to ``top``. The set of a cut
    (side s) holds the values up to it, the coset (side c) those after it.
    """
    ranked = values.join(F.broadcast(ranks), ["node_id", "cov", "value"])  # one row a value of an open node
    cuts = ranked.where("top > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("top") - 1)))
    sided = cuts.withColumn("side", F.when(F.col("rank") <= F.col("cut"), "s").otherwise("c"))
    return sided.groupBy("node_id", "cov", "cut", "side", *keys).agg(F.sum(measure).alias(measure))
