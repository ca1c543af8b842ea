"""Operator 6: mixing sources to target weights, DataFrame functions only.

Sources get targets in words by weight, held at ``max_epochs`` times their size. The
words of a source, its documents shuffled by hash, form a stream that repeats; it is
cut into blocks of equal length. A schedule of slots, one block each, maps the
golden-ratio sequence through the sources' cumulative targets, so that every stretch
of the schedule is near the target mix. The r-th slot of a source takes its r-th
block; the last block of a source ends at its target. The mix is the blocks in the
order of their slots: ``stream`` gives each stretch of a document its slot, and a
document's place in the mix is the slot of its first word.

Running sums and ranks are taken in levels (per chunk, then over chunks), over
documents, slots and sources alike, so a source that holds a third of all rows, or
sources of any number, are spread over tasks. Equal rows are counted before that and
placed one after the other.

Defined cases: a null text has size 0, and size 0 takes 0; null is a source of its
own, the last; repeated rows are documents of their own; a source without words has
target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, running_sums, two_level_sum

# Fixed values of the mix.
WEIGHTS, SHARE, MAX_EPOCHS = (5, 2, 1), 1.5, 2

#: Words in a block (slot), unless that makes more than MAX_SLOTS of them; cells, at least, that
#: the unit interval is cut into to map slots to sources; slots in a chunk of ranks.
BLOCK_WORDS, MAX_SLOTS, CELLS, RANK_CHUNK = 1024, 1 << 24, 4096, 16_384
#: 2^32 over the golden ratio: multiples of it mod 2^32 are the schedule's points.
GOLDEN = 2654435769


def content() -> Column:
    """Names a text; with doc_id and source it names a row."""
    return F.xxhash64("text")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and content, and how many rows have them."""
    words = F.regexp_count("text", F.lit(WORD_PATTERN))
    rows = docs.select("doc_id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"), content().alias("content"))
    return rows.groupBy("doc_id", "source", "size", "content").agg(F.count("*").alias("copies"))


def targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """One row a source: source, rank, source_size, weight, target.

    Water filling: a source is full when the level reaches cap / weight. Sources in
    that order are held at their caps until the rest can take their weights' shares.
    """
    rows = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    rows = running_sums(rows, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(max_epochs)
    rows = running_sums(rows.withColumn("level", cap / F.col("weight")), ["level", "rank"], full=cap, passed=F.col("weight"))
    total = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    rows = rows.withColumn("offered", (F.lit(float((total.words or 0) * share)) - F.col("full")) / (F.lit(total.weight or 0.0) - F.col("passed")))
    # The level at which filling stops is offered to the first source that it does not fill.
    stop = rows.agg(F.min(F.when(F.col("offered") < F.col("level"), F.struct("level", "rank", "offered"))).alias("stop")).first().stop
    target = cap if stop is None else F.least(cap, F.col("weight") * F.lit(stop.offered))
    return rows.select("source", F.col("rank").cast("int").alias("rank"), "source_size", "weight", target.alias("target"))


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS, cells: int = CELLS, chunk: int = RANK_CHUNK) -> DataFrame:
    """Slots of the mix: slot, rank (of the source), r (the source's r-th slot).

    ``plan`` is ``targets`` with ``words`` (what the source gives). A source needs
    ceil(words / block_words) slots; those that the sequence left out come last.
    """
    spark = plan.sparkSession
    quota = plan.select("rank", "words", F.ceil(F.col("words") / block_words).cast("long").alias("quota"))
    total, sources = quota.agg(F.sum("quota"), F.count("*")).first()
    if not total:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("rank"), F.col("id").alias("r"))
    cells = max(cells, 1 << (sources - 1).bit_length())
    # Limits in 2^-32: a slot's point is a whole number below 2^32.
    part = lambda x: F.floor(x / float(total) * float(1 << 32)).cast("long")
    ends = running_sums(quota.where("quota > 0"), ["rank"], upto=F.col("quota"))
    ends = ends.select("rank", "quota", part(F.col("upto")).alias("lo"), part(F.col("upto") + F.col("quota")).alias("hi"))
    cell = (1 << 32) // cells
    ranges = ends.select("rank", "quota", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"least(greatest(lo, hi - 1) div {cell}, {cells - 1})"))).alias("cell"))
    n = total + 64 * (total.bit_length() + 1)
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 32)) * GOLDEN % (1 << 32)).alias("x"))
    drawn = points.withColumn("cell", F.expr(f"x div {cell}")).join(ranges, "cell").where("x >= lo AND x < hi")
    drawn = drawn.select("slot", "rank", "quota", F.expr(f"slot div {chunk}").alias("part"), F.lit(1).alias("one"))
    ranked = two_level_sum(drawn, ["rank"], "part", ["slot"], "one", "r", -(-n // chunk)).where("r < quota")
    met = ranked.groupBy("rank").agg(F.count("*").alias("met"))
    short = quota.join(met, "rank", "left").select("rank", "quota", F.coalesce("met", F.lit(0)).alias("met")).where("met < quota")
    rest = short.select((F.lit(n) + F.col("rank")).alias("slot"), "rank", F.explode(F.sequence("met", F.col("quota") - 1)).alias("r"))
    return ranked.select("slot", "rank", "r").unionByName(rest)


def mixed(docs: DataFrame, block_words: int | None = None, chunk_docs: int = 4096, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, source, text) with what the mix takes, the slots, and the mix.

    Rows: doc_id, source, size, source_size, target, taken, first_slot (null if nothing is
    taken). Slots: slot, rank, r. The mix has a row per stretch of a document in a block:
    slot, at (the first word's place in the source's stream), words, rank, doc_id,
    source, content, size, copy (of equal rows) and epoch.
    """
    sized = materialize(sizes(docs), "sizes")
    plan = materialize(targets(sized, max_epochs=max_epochs).withColumn("words", F.round("target").cast("long")), "targets")
    documents = sized.count()
    if block_words is None:
        block_words = max(BLOCK_WORDS, -(-(plan.agg(F.sum("words")).first()[0] or 0) // MAX_SLOTS))
    slots = materialize(schedule(plan, block_words).repartition("rank", "r"), "slots")
    chunks = max(1, -(-documents // chunk_docs))
    placed = sized.join(plan, sized.source.eqNullSafe(plan.source)).drop(plan.source)
    placed = placed.withColumns({"mark": F.xxhash64("doc_id", "content", F.lit(1)), "all": F.col("size") * F.col("copies")}).withColumn("part", F.pmod("mark", F.lit(chunks)))
    placed = two_level_sum(placed, ["rank"], "part", ["mark", "doc_id", "content", "size"], "all", "start", chunks)
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    placed = materialize(placed.drop("mark", "all", "part", "copies"), "placed")
    epochs = F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("epoch")
    spans = placed.where("size > 0").select("doc_id", "source", "content", "copy", "rank", "start", "size", "words", "source_size", epochs)
    spans = spans.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "words"))
    spans = spans.where("lo < hi").withColumn("r", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
    at = F.greatest("lo", F.col("r") * block_words)
    inside = F.least("hi", (F.col("r") + 1) * block_words) - at
    stream = spans.join(slots, ["rank", "r"]).select("slot", at.alias("at"), inside.alias("words"), "rank", "start", "doc_id", "source", "content", "size", "copy", "epoch")
    taken = stream.groupBy("rank", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = placed.join(taken, (placed["rank"] == taken["rank"]) & (placed["start"] == taken["start"]) & (placed["size"] > 0), "left")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return rows, slots, stream.drop("start")


def mix(docs: DataFrame, block_words: int | None = None, chunk_docs: int = 4096, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The taken words of every row of ``docs`` (doc_id, source, text), and the slots."""
    rows, slots, _ = mixed(docs, block_words, chunk_docs, max_epochs)
    return rows.drop("first_slot"), slots


def whole_documents(stream: DataFrame) -> DataFrame:
    """The mix in whole documents: doc_id, source, content, epoch, slot, at.

    A document is in an epoch if the mix takes half of its words there or more; it comes
    at its first word's slot. Of equal rows the first is the most taken; it stands for all.
    """
    own = stream.where("copy = 0").groupBy("doc_id", "source", "content", "epoch")
    return own.agg(F.sum("words").alias("_words"), F.max("size").alias("_size"), F.min("slot").alias("slot"), F.min("at").alias("at")).where("2 * _words >= _size").drop("_words", "_size")
