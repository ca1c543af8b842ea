"""Interval algebra on DataFrames with columns chrom, st, en (half-open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: str, b: str) -> Column:
    """Rows of aliases ``a`` and ``b`` share a position."""
    return (F.col(f"{a}.chrom") == F.col(f"{b}.chrom")) & (F.col(f"{a}.st") < F.col(f"{b}.en")) & (F.col(f"{b}.st") < F.col(f"{a}.en"))


def compare(a: str, b: str) -> Column:
    """-1, 0 or 1: ``a`` lies before, overlaps or lies after ``b``, by chromosome, then position."""
    before = (F.col(f"{a}.chrom") < F.col(f"{b}.chrom")) | ((F.col(f"{a}.chrom") == F.col(f"{b}.chrom")) & (F.col(f"{a}.en") <= F.col(f"{b}.st")))
    return F.when(before, -1).when(overlaps(a, b), 0).otherwise(1)


def clip(df: DataFrame, st: str, en: str) -> DataFrame:
    """Intersect each row's interval with columns ``st`` and ``en``; empty ones go."""
    return df.withColumn("st", F.greatest("st", st)).withColumn("en", F.least("en", en)).where("st < en")


def advance(df: DataFrame, to: str) -> DataFrame:
    """Take away the part of each interval before column ``to``."""
    return df.withColumn("st", F.least(F.greatest("st", to), "en"))


def _binned(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.expr(f"st div {width}"), F.expr(f"(en - 1) div {width}"))))


#: Bits of the narrowest bins' width, bits that each level adds, and the number of levels.
BIN_BITS, LEVEL_BITS, BIN_LEVELS = 6, 3, 12


def bin_level(length: Column) -> Column:
    """The least level of bins as wide as the interval; such an interval touches two at most."""
    level = F.lit(BIN_LEVELS - 1)
    for j in reversed(range(BIN_LEVELS - 1)):
        level = F.when(length <= F.lit(1 << (BIN_BITS + LEVEL_BITS * j)), j).otherwise(level)
    return level


def levels_of(df: DataFrame) -> list[int]:
    """The levels that a table's intervals sit in, BIN_LEVELS numbers at most."""
    return sorted(r[0] for r in df.where("st < en").select(bin_level(F.col("en") - F.col("st"))).distinct().collect())


def _touched(level: int, code: int) -> Column:
    """The bins of a level that an interval touches, each with the code of its kind of meeting."""
    bits = BIN_BITS + LEVEL_BITS * level
    return F.transform(F.sequence(F.expr(f"shiftright(st, {bits})"), F.expr(f"shiftright(en - 1, {bits})")), lambda b: F.struct(F.lit(code).alias("code"), b.cast("long").alias("bin")))


def placed_bins(own: list[int], other: list[int], left: bool) -> Column:
    """Where an interval meets those of the other side, as an array of (code, bin).

    Two intervals meet at the level of the wider one. So an interval is in the bins of its
    own level, for narrower ones, and in those that hold it at each wider level that the
    other side has. Codes below BIN_LEVELS are meetings where the left one is not wider.
    """
    level, parts = bin_level(F.col("en") - F.col("st")), []
    none = F.array().cast("array<struct<code:int,bin:bigint>>")
    for j in range(BIN_LEVELS):
        at_home = level == j
        if left:
            if j in other:  # the other is as wide or wider
                parts.append(F.when(level <= j, _touched(j, j)).otherwise(none))
            if j in own and any(k < j for k in other):
                parts.append(F.when(at_home, _touched(j, BIN_LEVELS + j)).otherwise(none))
        else:
            if j in own and any(k <= j for k in other):
                parts.append(F.when(at_home, _touched(j, j)).otherwise(none))
            if j in other:
                parts.append(F.when(level < j, _touched(j, BIN_LEVELS + j)).otherwise(none))
    return F.concat(*parts) if parts else none


_WHOLE = "st IS NOT NULL AND en IS NOT NULL AND st < en"
#: The bin, at a meeting's level, of the position where two intervals begin to overlap.
_FIRST = f"shiftright(greatest(st, r_st), {BIN_BITS} + {LEVEL_BITS} * pmod(_code, {BIN_LEVELS}))"


def overlap_join(left: DataFrame, right: DataFrame, width: int | None = None, how: str = "inner", levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Pairs of overlapping intervals, with columns of both and the shared part as st, en.

    Intervals sit in a tree of bins, each at the level that is as wide as it, and meet on
    (chrom, level, bin) with those of its level and of the others; so a long interval is
    not cut up, the plan is an equi-join, and the rows of the join follow the overlaps and
    the levels. Which levels the sides have is looked up first, unless ``levels`` tells.
    With ``width`` all bins have that width instead. A pair is kept in the first bin that
    both touch. Columns of ``right`` that clash get the prefix ``r_``. ``left_semi`` and
    ``left_anti`` keep rows of ``left``.

    Defined cases: empty intervals and null bounds match nothing; overlapping or
    repeated intervals pair each with each; unknown chromosomes match nothing.
    """
    if how != "inner":
        flagged = overlap_flags(left, right, width, levels)
        return flagged.where(F.col("hit") == (how == "left_semi")).drop("hit")
    names = {c: f"r_{c}" if c in left.columns else c for c in right.columns}
    l, r = left.where(_WHOLE), right.where(_WHOLE)  # noqa: E741
    if width:
        l, r = _binned(l, width).withColumn("_code", F.lit(0)), _binned(r, width).withColumn("_code", F.lit(0))  # noqa: E741
        first = f"greatest(st, r_st) div {width}"
    else:
        own, other = levels or (levels_of(l), levels_of(r))
        place = lambda df, bins: df.withColumn("_at", F.explode(bins)).withColumns({"_code": F.col("_at.code"), "_bin": F.col("_at.bin")}).drop("_at")
        l, r = place(l, placed_bins(own, other, True)), place(r, placed_bins(other, own, False))  # noqa: E741
        first = _FIRST
    r = r.select(F.col("_bin").alias("_rbin"), F.col("_code").alias("_rcode"), *[F.col(c).alias(n) for c, n in names.items()])
    on = [l["_bin"] == F.col("_rbin"), l["_code"] == F.col("_rcode"), l["chrom"] == r["r_chrom"], l["st"] < r["r_en"], r["r_st"] < l["en"]]
    pairs = l.join(r, on=on).where(F.col("_bin") == F.expr(first))
    others = [F.col(c) for c in left.columns if c not in ("st", "en")]
    return pairs.select(
        *others,
        F.col("st").alias("l_st"), F.col("en").alias("l_en"),
        *[F.col(n) for c, n in names.items() if c != "chrom"],
        F.greatest("st", "r_st").alias("st"), F.least("en", "r_en").alias("en"),
    )


def _ends(df: DataFrame, *others: str) -> DataFrame:
    """Both ends of each interval as rows: chrom, ``others``, at, and way, 1 for a start and -1 for an end."""
    ends = F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(way).cast("long").alias("way")) for c, way in (("st", 1), ("en", -1))])
    return df.select("chrom", *others, F.explode(ends).alias("_end")).select("chrom", *others, "_end.at", "_end.way")


def _running(df: DataFrame, sums: list[str], region: int) -> DataFrame:
    """``df``, a row for each (chrom, at), with ``sums`` added up over the positions so far, the row's own included.

    A task orders the rows of a region, or one row for each region of a chromosome.
    """
    placed = df.withColumn("_region", _region("at", region))
    earlier = Window.partitionBy("chrom").orderBy("_region").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("chrom", "_region").agg(*[F.sum(c).alias(c) for c in sums])
    begun = totals.select("chrom", "_region", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    own = Window.partitionBy("chrom", "_region").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumns({c: F.sum(c).over(own) for c in sums})
    # Every region has its row; an inner join would filter one of the two uses of ``df``, and then it is made twice.
    return inner.join(begun, ["chrom", "_region"], "left").withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_region", *[f"_{c}" for c in sums])


def overlap_sums(left: DataFrame, right: DataFrame, weight: str = "weight", region: int = 1 << 16) -> DataFrame:
    """Rows of ``right`` that overlap any of ``left``, with sums over the pairs that ``overlap_join`` would list.

    Added columns: n, the pairs; shared, their positions; weighted, their positions times
    ``weight`` of ``left``, a whole number (null where all weights met are null). No pair is
    made: n is what starts before the interval's end less what ends by its start, and the
    positions are those before its end less those before its start. These counts are
    running sums over the distinct ends, so the work follows the rows of both sides,
    however many overlap. With ``at`` a position and d what starts there less what ends
    there, the positions before ``at`` are ``at`` times the sum of d less the sum of d * at.

    Defined cases are those of ``overlap_join``. ``region`` bounds what a task orders.
    """
    whole = f"{_WHOLE} AND chrom IS NOT NULL"
    l = _ends(left.where(whole).select("chrom", "st", "en", F.col(weight).cast("long").alias("weight")), "weight")  # noqa: E741
    asked = _ends(right.where(whole).select("chrom", "st", "en").distinct(), "st", "en")
    rows = l.unionByName(asked.select("chrom", "at", F.lit(0).cast("long").alias("way"), F.lit(None).cast("long").alias("weight")))
    when = lambda way, c: F.sum(F.when(F.col("way") == way, c).otherwise(0))
    held = F.col("weight").isNotNull().cast("long")
    at = rows.groupBy("chrom", "at").agg(
        when(1, F.lit(1)).cast("long").alias("own"), when(-1, F.lit(1)).cast("long").alias("ended"),
        when(1, held).alias("own_held"), when(-1, held).alias("ended_held"), F.coalesce(F.sum(F.col("way") * F.col("weight")), F.lit(0)).alias("w"),
    )
    at = at.withColumns({"started": F.col("own"), "started_held": F.col("own_held"), "moment": (F.col("own") - F.col("ended")) * F.col("at"), "w_moment": F.col("w") * F.col("at")})
    so_far = _running(at, ["started", "ended", "moment", "started_held", "ended_held", "w", "w_moment"], region)
    so_far = so_far.select(
        "chrom", "at", "ended", "ended_held", (F.col("started") - F.col("own")).alias("before"), (F.col("started_held") - F.col("own_held")).alias("before_held"),
        (F.col("at") * (F.col("started") - F.col("ended")) - F.col("moment")).alias("area"), (F.col("at") * F.col("w") - F.col("w_moment")).alias("w_area"),
    )
    less = lambda end, start: F.sum(F.when(F.col("way") == -1, F.col(end)).otherwise(-F.col(start)))
    found = asked.join(so_far, ["chrom", "at"]).groupBy("chrom", "st", "en").agg(
        less("before", "ended").alias("n"), less("area", "area").alias("shared"), F.when(less("before_held", "ended_held") > 0, less("w_area", "w_area")).alias("weighted"),
    )
    return right.join(found.where("n > 0"), ["chrom", "st", "en"]).select(*right.columns, "n", "shared", "weighted")


def overlap_flags(left: DataFrame, right: DataFrame, width: int | None = None, levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Rows of ``left`` and whether any interval of ``right`` overlaps them, as ``hit``.

    Equal rows are counted first and given back in their number, so one join on bins and
    one aggregate per row answer for all; empty intervals and null bounds have no hit.
    """
    rows = left.groupBy(*left.columns).agg(F.count("*").alias("_copies"))
    r = right.where(_WHOLE).select("chrom", "st", "en")
    if width:
        uniform = F.transform(F.sequence(F.expr(f"st div {width}"), F.expr(f"(en - 1) div {width}")), lambda b: F.struct(F.lit(0).alias("code"), b.cast("long").alias("bin")))
        bins = own_bins = uniform
    else:
        own, other = levels or (levels_of(left.where(_WHOLE)), levels_of(r))
        bins, own_bins = placed_bins(own, other, True), placed_bins(other, own, False)
    cut = rows.withColumn("_at", F.explode_outer(F.when(F.expr(_WHOLE), bins)))
    r = r.withColumn("_at", F.explode(own_bins)).distinct().select(*[F.col(c).alias(f"_r_{c.strip('_')}") for c in ("chrom", "st", "en", "_at")])
    on = (F.col("_at.bin") == F.col("_r_at.bin")) & (F.col("_at.code") == F.col("_r_at.code")) & (F.col("chrom") == F.col("_r_chrom")) & (F.col("st") < F.col("_r_en")) & (F.col("_r_st") < F.col("en"))
    found = cut.join(r, on, "left").groupBy(*left.columns, "_copies").agg(F.max(F.col("_r_st").isNotNull()).alias("hit"))
    return found.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")


def locate(points: DataFrame, blocks: DataFrame, at: str = "pos", width: int = 65_536) -> DataFrame:
    """Points (chrom, ``at``) with the columns of the interval each lies in."""
    p = points.withColumn("_bin", F.expr(f"{at} div {width}"))
    b = _binned(blocks.where("st < en"), width).withColumnRenamed("_bin", "_rbin")
    b = b.select("_rbin", *[F.col(c).alias(f"r_{c}" if c in points.columns else c) for c in blocks.columns])
    chrom = "r_chrom" if "chrom" in points.columns else "chrom"
    st, en = ("r_st" if "st" in points.columns else "st"), ("r_en" if "en" in points.columns else "en")
    return p.join(b, (F.col("_bin") == F.col("_rbin")) & (p["chrom"] == b[chrom]) & (F.col(at) >= F.col(st)) & (F.col(at) < F.col(en))).drop("_bin", "_rbin", chrom)


def positions(df: DataFrame) -> DataFrame:
    """One row per position of each interval, as ``pos``."""
    return df.where("st < en").withColumn("pos", F.explode(F.sequence("st", F.expr("en - 1"))))


def _islands(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Runs of rows that touch and carry the same value, in order of position within keys."""
    w = Window.partitionBy(*keys).orderBy("st", "en")
    new = ~(F.lag("en").over(w).eqNullSafe(F.col("st")) & F.lag(value).over(w).eqNullSafe(F.col(value)))
    marked = rows.withColumn("_island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "_island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.first(value).alias(value))
    return merged.drop("_island")


def coalesce_runs(df: DataFrame, value: str, keys: list[str] = ["chrom"], drop_zero: bool = True, region: int | None = None) -> DataFrame:  # noqa: B006
    """Merge adjacent intervals that touch and carry the same ``value``.

    Zero values are dropped. With ``region`` (positions), for intervals of a key that do
    not overlap, islands are made within regions, and only a region's first and last are
    glued to their neighbours; so a task holds a region, or two rows a region of a key.
    """
    rows = df.where(F.col(value) != 0) if drop_zero else df
    if not region:
        return _islands(rows, value, keys)
    inner = _islands(rows.withColumn("_region", F.expr(f"st div {region}")), value, [*keys, "_region"])
    w = Window.partitionBy(*keys, "_region")
    edge = (F.col("st") == F.min("st").over(w)) | (F.col("en") == F.max("en").over(w))
    marked = inner.withColumn("_edge", edge).drop("_region")
    glued = _islands(marked.where("_edge"), value, keys)
    return marked.where("NOT _edge").select(*glued.columns).unionByName(glued)


def breakpoint_segments(*runs: DataFrame, keys: list[str] = ["chrom"], region: int | None = None) -> DataFrame:  # noqa: B006
    """Atomic segments between consecutive borders of any of the runs.

    With ``region`` (positions) a task orders the borders of a region, and the first
    borders of a key's regions, one a region.
    """
    borders = None
    for r in runs:
        part = r.select(*keys, F.col("st").alias("st")).unionByName(r.select(*keys, F.col("en").alias("st")))
        borders = part if borders is None else borders.unionByName(part)
    if not region:
        w = Window.partitionBy(*keys).orderBy("st")
        return borders.distinct().withColumn("en", F.lead("st").over(w)).where("en IS NOT NULL")
    placed = borders.distinct().withColumn("_region", _region("st", region))
    inner = placed.withColumn("en", F.lead("st").over(Window.partitionBy(*keys, "_region").orderBy("st")))
    following = placed.groupBy(*keys, "_region").agg(F.min("st").alias("_next")).withColumn("_next", F.lead("_next").over(Window.partitionBy(*keys).orderBy("_region")))
    joined = inner.join(following, [*keys, "_region"]).withColumn("en", F.coalesce("en", "_next"))
    return joined.where("en IS NOT NULL").select(*keys, "st", "en")


def _region(at: str, region: int) -> Column:
    """Number of a position's region, rounded down below zero too."""
    return F.expr(f"({at} - pmod({at}, {region})) div {region}")


def asof_state(points: DataFrame, runs: DataFrame, state: str, keys: list[str], at: str = "st", region: int | None = None) -> DataFrame:
    """Each point with the latest ``state`` that started at or before it, within keys.

    With ``region`` (positions) a task orders the points and runs of a region; the state
    that a region begins with comes from the last ones of earlier regions, one row each.
    """
    none = F.lit(None).cast(runs.schema[state].dataType)
    left = points.withColumn("_kind", F.lit(1)).withColumn("_state", none)
    right = runs.select(*keys, F.col("st").alias(at), F.lit(0).alias("_kind"), F.col(state).alias("_state"))
    groups = list(keys)
    if region:
        groups.append("_region")
        left, right = (df.withColumn("_region", _region(at, region)) for df in (left, right))
        last = right.where("_state IS NOT NULL").groupBy(*groups).agg(F.max_by("_state", F.struct(at, "_state")).alias("_last"))
        met = left.select(*groups).distinct().withColumn("_last", none).unionByName(last).groupBy(*groups).agg(F.first("_last", ignorenulls=True).alias("_last"))
        earlier = Window.partitionBy(*keys).orderBy("_region").rowsBetween(Window.unboundedPreceding, -1)
        begun = met.withColumn("_state", F.last("_last", ignorenulls=True).over(earlier)).where("_state IS NOT NULL")
        begun = begun.select(*groups, (F.col("_region") * region).cast(right.schema[at].dataType).alias(at), F.lit(-1).alias("_kind"), "_state")
        right = right.unionByName(begun)
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*groups).orderBy(at, "_kind", "_state").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn(state, F.last("_state", ignorenulls=True).over(w))
    return carried.where("_kind = 1").drop("_kind", "_state", "_region")


def align(annotation: DataFrame, cells: DataFrame, region: int = 1_000_000) -> DataFrame:
    """Segments on which the annotation and every cell's run are constant.

    ``annotation`` has (chrom, st, en, tagb), ``cells`` also ``cell``. The result has a
    row per (segment, cell): chrom, st, en, ann, cell, tagb. Runs are cut at region
    borders first, so the windows and joins below hold one region at most.
    """

    def cut(df: DataFrame) -> DataFrame:
        parts = df.where("st < en").withColumn("region", F.explode(F.sequence(F.expr(f"st div {region}"), F.expr(f"(en - 1) div {region}"))))
        return parts.withColumn("st", F.greatest("st", F.col("region") * region)).withColumn("en", F.least("en", (F.col("region") + 1) * region))

    a, c = cut(annotation), cut(cells)
    keys = ["chrom", "region"]
    segments = breakpoint_segments(a, c, keys=keys)
    ann = asof_state(segments, a, "tagb", keys).withColumnRenamed("tagb", "ann")
    per_cell = ann.join(c.select(*keys, "cell").distinct(), keys)
    return asof_state(per_cell, c, "tagb", [*keys, "cell"]).where("ann IS NOT NULL AND tagb IS NOT NULL").select("chrom", "st", "en", "ann", "cell", "tagb")


def linear_positions(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Add ``linear``: position on the chromosomes laid end to end in byte order."""
    w = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = genome.select("chrom", F.coalesce(F.sum(F.col("en") - F.col("st")).over(w), F.lit(0)).alias("_offset"))
    return df.join(F.broadcast(offsets), "chrom").withColumn("linear", F.col("_offset") + F.col("st")).drop("_offset")


def from_linear(df: DataFrame, genome: DataFrame, width: int = 1 << 24) -> DataFrame:
    """The inverse: ``linear`` as chrom and st, by an equi-join on stretches of ``width``."""
    w = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = genome.select("chrom", F.coalesce(F.sum(F.col("en") - F.col("st")).over(w), F.lit(0)).alias("_lo"), (F.col("en") - F.col("st")).alias("_len"))
    bins = F.explode(F.sequence(F.expr(f"_lo div {width}"), F.expr(f"(_lo + _len - 1) div {width}")))
    offsets = offsets.where("_len > 0").withColumn("_bin", bins)
    placed = df.withColumn("_bin", F.expr(f"linear div {width}"))
    found = placed.join(offsets, "_bin").where("linear >= _lo AND linear < _lo + _len")
    return found.withColumn("st", F.col("linear") - F.col("_lo")).drop("_lo", "_len", "_bin")
