"""Operator 12: near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles, named by 128 bits; documents of one
set are one entry. An entry has a sketch of minwise values. A tree branches entries from
its root: every node chooses two places of the sketch, and an entry goes to one child for
each of them, the one that its minwise token names. Two sets of similarity s share a child
with probability s for each choice, so they stay together along some path to any depth
with probability 1 - q at least, q the least root of q = (1 - s + s q)^2; unrelated sets
part. Trees are repeated until the chance q^trees of a miss at the threshold is below
1 - ``recall``. (Places are shared by the trees below the first level.)

A node is compared exhaustively once few of its pairs are open: a pair whose entries are
connected already is not. Larger nodes first meet their hub, the entry with the most
common minwise values, and what is verified there joins; then they branch on. Nodes whose
entries are so close to each other that a branching would not leave fewer pairs, and those
that are still large at DEPTH, are compared in blocks, so nothing is capped. Pairs pass a
filter of sizes and sketches, and all links are confirmed on the full sets: first those of
a forest that spans each node, then the pairs that this left apart, in the tasks where they
meet, so that rows are made of entries and links only and never of all candidates.

Defined cases: words are lower-cased in ASCII and cut at ASCII white space; a text of
fewer words is one shingle; texts without words (null, empty) are linked with nothing
unless ``empties`` makes them copies of each other; equal sets are linked; repeated rows
each keep a row; a null doc_id takes part and is never a component's least; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected

SEED, SHINGLE = 42, 5
#: Least similarity as a fraction, and the chance that a pair at it is found.
LEAST, RECALL = (17, 20), 0.99999
#: Minwise values of a sketch; places that each level may choose from; places that tell a hub.
PLACES, LEVEL, HUB = 128, 16, 16
#: Entries outside a node's largest class up to which it is compared, entries of a block, depth of a tree.
OPEN, BLOCK, DEPTH = 2048, 2048, 24
#: Average share of minwise values from which a node is dense; entries up to which dense nodes are compared.
CLOSE, DENSE = 0.4, 50_000
#: Links and pairs that a task takes at a time.
TASK = 100_000
#: Members of the full sets that a task holds at a time, for about half of its entries.
HELD = 2_000_000
#: Rows of a bucket of nodes; places of the filter of texts; words a worker remembers; texts of a slice.
BUCKET, TEXTS, _MEMO, _SLICE = 20_000, 1 << 22, 100_000, 1000

_RNG = np.random.default_rng(SEED)
_A, _B = (_RNG.integers(0, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """A word's hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _MEMO:
            self.clear()
        self[word] = made = xxh64_intdigest(word, SEED)
        return made


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    found = (text or "").encode().lower().split()
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(ids))
    n = len(ids) - size + 1 if size else 0
    key = np.full(n, size, np.uint64)
    for k in range(size):
        key = (key ^ ids[k : k + n]) * _MIX
        key ^= key >> np.uint64(32)
    return np.unique(key)


def sketch(found: np.ndarray) -> np.ndarray:
    """The least value of each place's hash function over a set."""
    least = np.full(PLACES, 2**32 - 1, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, ((found[None, i : i + 512] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32)


def missed(similarity: float) -> float:
    """The chance that a pair parts somewhere on all paths of an endless tree."""
    q = 0.0
    for _ in range(500):
        q = (1 - similarity + similarity * q) ** 2
    return q


def trees_for(similarity: float, recall: float) -> int:
    """How many trees leave a miss below 1 - ``recall``."""
    return max(1, min(LEVEL // 2, math.ceil(math.log(1 - recall) / math.log(missed(similarity)))))


def content() -> Column:
    """Names a text; rows of one text share it."""
    return F.xxhash64("text")


def _lists(sets: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *(s.view(kind) for s in sets)])))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in small parts, which bounds a worker's memory."""
    return (batch.slice(i, _SLICE) for i in range(0, batch.num_rows, _SLICE))


def _mark(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        words, first = _Words(), np.arange(2 * trees)
        for batch in (part for whole in batches for part in _slices(whole)):
            names, sizes, sketches, nodes = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                names.append(xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                values = sketch(found)
                nodes.append(_child(first.astype(np.uint64), first, values[first].astype(np.uint64), 0))
                sketches.append(values.astype(np.uint16))
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), _lists(sketches, np.int16), _lists(nodes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "name", "n", "sketch", "nodes"])

    return run


def mark(docs: DataFrame, trees: int) -> DataFrame:
    """``docs`` (doc_id, text) with each text's set: its name, size, sketch and nodes of the first level."""
    rows = docs.select("doc_id", content().alias("content"), "text")
    return materialize(rows.mapInArrow(_mark(trees), "doc_id long, content long, name binary, n int, sketch array<short>, nodes array<bigint>"), "marked")


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, PLACES)  # of 16 bits


def _child(node: np.ndarray, place: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    """Names the children of nodes by the chosen places and the tokens there."""
    name = (node + np.uint64(depth + 1)) * _MIX
    for part in (place.astype(np.uint64), value):
        name = (name ^ (name >> np.uint64(31)) ^ part) * np.uint64(0xD6E8FEB86659FD93)
    return name ^ (name >> np.uint64(32))


def _children(depth: int):
    """Children of nodes below the first level: two places of the level's own, chosen by the node."""
    first = (depth * LEVEL) % PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("sketch")).view(np.uint16).astype(np.uint64)
            node = batch.column("node").to_numpy().view(np.uint64)
            mixed = (node ^ (node >> np.uint64(29))) * _MIX
            one = (mixed >> np.uint64(40)) % np.uint64(LEVEL)
            two = (one + np.uint64(1) + (mixed >> np.uint64(50)) % np.uint64(LEVEL - 1)) % np.uint64(LEVEL)
            for at in (one.astype(np.int64), two.astype(np.int64)):
                made = _child(node, at, values[np.arange(len(values)), first + at], depth)
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), batch.column("key")], ["node", "key"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each of the HUB last values occurs in a node, by batch."""
    for batch in batches:
        node, values = batch.column("node").to_numpy(), _matrix(batch.column("sketch"))[:, -HUB:].astype(np.int64) & 0xFFFF
        coded = (np.arange(HUB) << 16 | values).ravel()
        pairs, n = np.unique(np.stack([np.repeat(node, HUB), coded]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], ["node", "coded", "n"])


def _units(bucket: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """A bucket's units: places in the bucket, keys, roots, sizes, whether minor, sketches."""
    unit = bucket.column("unit").to_numpy()
    order = np.argsort(unit, kind="stable")
    keys, root, n = (bucket.column(c).to_numpy().astype(np.int64) for c in ("key", "root", "n"))
    minor, values = bucket.column("minor").to_numpy(zero_copy_only=False), _matrix(bucket.column("sketch"))
    for at in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
        yield at, keys[at], root[at], n[at], minor[at], values[at]


def _candidates(root, n, minor, values, low: int, part: int, whole: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A unit's minor rows, each with the open rows whose sizes and sketches let them be similar enough, and the values shared.

    A row that joins the class of a minor one meanwhile is no longer open.
    """
    later = np.arange(len(n))
    for i in np.flatnonzero(minor).tolist():
        able = np.flatnonzero((root != root[i]) & (whole * np.minimum(n, n[i]) >= part * np.maximum(n, n[i])) & (~minor | (later > i)))
        if len(able):
            same = ((values[able] if len(able) < len(n) else values) == values[i]).sum(axis=1)
            near = same >= low
            if near.any():
                yield i, able[near], same[near]


def _compare(low: int, part: int, whole: int, forest: bool):
    """Candidate pairs of a bucket's units; with ``forest`` one that likelier ones connect already is left out."""

    def run(bucket: pa.Table) -> pa.Table:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, keys, root, n, minor, values in _units(bucket):
            if found := list(_candidates(root, n, minor, values, low, part, whole)):
                a, same = np.repeat([i for i, _, _ in found], [len(able) for _, able, _ in found]), np.concatenate([s for _, _, s in found])
                b = np.concatenate([able for _, able, _ in found])
                a, b = np.where(keys[a] > keys[b], a, b), np.where(keys[a] > keys[b], b, a)
                if forest:  # equal pairs of other units are taken in the same order
                    order = np.lexsort((keys[b], keys[a], -same))
                    a, b = _spanning(a[order], b[order], root)
                left.append(keys[a])
                right.append(keys[b])
        return pa.table([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def _touched(low: int, part: int, whole: int):
    """Rows of a bucket's units that are in a candidate pair there."""

    def run(bucket: pa.Table) -> pa.Table:
        kept = np.zeros(bucket.num_rows, bool)
        for at, _, root, n, minor, values in _units(bucket):
            for i, able, _ in _candidates(root, n, minor, values, low, part, whole):
                kept[at[i]] = True
                kept[at[able]] = True
        return bucket.select(["unit", "key", "root", "minor"]).filter(pa.array(kept))

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])


def _confirm(low: int, part: int, whole: int):
    """Links of a bucket's units that connect what the candidates similar on their full sets connect."""

    def run(bucket: pa.Table) -> pa.Table:
        made, sets = [], bucket.column("found").combine_chunks()
        starts, members = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
        for at, keys, root, n, minor, values in _units(bucket):
            sizes = starts[at + 1] - starts[at]
            _, ids = np.unique(members[_ranges(starts[at], sizes)], return_inverse=True)
            first, held = np.cumsum(sizes) - sizes, np.zeros(ids.max() + 1, np.int32)
            for i, able, _ in _candidates(root, n, minor, values, low, part, whole):
                own = ids[first[i] : first[i] + sizes[i]]
                held[own] = 1
                common = np.add.reduceat(held[ids[_ranges(first[able], sizes[able])]], np.cumsum(sizes[able]) - sizes[able])
                held[own] = 0
                for j in able[common.astype(np.int64) * (part + whole) >= (sizes[i] + sizes[able]) * part].tolist():
                    if root[j] != root[i]:
                        made.append((max(keys[i], keys[j]), min(keys[i], keys[j])))
                        root[root == root[j]] = root[i]
        a, b = np.array(made, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _spanning(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a forest over classes, the first ones first."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(root[a].tolist(), root[b].tolist())):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def _chosen(places):
    """Sets of the texts whose hash has a place in the filter, so that no other text moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        words, seen = _Words(), set()
        for batch in (part for whole in batches for part in _slices(whole)):
            keys, sets = [], []
            for i in np.flatnonzero(places.value[batch.column(0).to_numpy() & (TEXTS - 1)]).tolist():
                text = batch.column(1)[i].as_py()
                if (name := xxh3_128_digest((text or "").encode())) not in seen:  # a text once a task
                    seen.add(name)
                    sets.append(shingles(text, words))
                    keys.append(xxh3_128_digest(sets[-1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(sets)], ["name", "found"])

    return run


class Join:
    """The links of similarity ``least`` or more among the sets of ``docs``."""

    def __init__(self, docs: DataFrame, least: tuple[int, int] = LEAST, recall: float = RECALL, trees: int | None = None):
        self.docs, self.spark = docs, docs.sparkSession
        self.part, self.whole = least
        s = self.part / self.whole
        self.trees = trees or trees_for(s, recall)
        #: Six standard deviations below the values that sketches at the threshold share.
        self.low = max(1, math.floor(PLACES * s - 6 * math.sqrt(PLACES * s * (1 - s))))
        self.marked = mark(docs, self.trees)
        distinct = self.marked.where("n > 0").select("name", "n", "sketch", "nodes").dropDuplicates(["name"])
        self.sets = materialize(distinct.withColumn("key", F.monotonically_increasing_id()), "sets")  # numbered as stored
        self.aside: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def verified(self, pairs: DataFrame, n: int) -> DataFrame:
        """Those of ``n`` ``pairs`` (a, b) whose full sets are similar enough."""
        sets = self.full(pairs.select(F.explode(F.array("a", "b")).alias("key")), n)
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("found").alias(f"found_{side}")), side)
        both, common = F.size("found_a") + F.size("found_b"), F.size(F.array_intersect("found_a", "found_b"))
        return materialize(pairs.where(common * (self.part + self.whole) >= both * self.part).select("a", "b"), "links")

    def full(self, keys: DataFrame, n: int) -> DataFrame:
        """The full sets of the entries named in ``n`` ``keys`` (key), as (key, found)."""
        names = keys.distinct().join(self.sets.select("key", "name"), "key")
        keys = materialize(names.coalesce(-(-n // TASK)), "keys")
        named = self.marked.select("name", "content").join(keys, "name", "left_semi")
        places = np.zeros(TEXTS, bool)
        places[named.select(F.col("content").bitwiseAND(TEXTS - 1).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
        held = self.spark.sparkContext.broadcast(places)
        found = self.docs.select(content().alias("content"), "text").mapInArrow(_chosen(held), "name binary, found array<long>")
        return materialize(found.join(keys, "name").dropDuplicates(["key"]).select("key", "found"), "full")

    def add(self, pairs: DataFrame) -> None:
        """Verify ``pairs`` and join the classes that they link."""
        if n := pairs.count():
            self.merge(self.verified(pairs, n), n)

    def merge(self, made: DataFrame, n: int) -> None:
        """Join the classes that ``made`` (a, b) links, found among ``n`` rows."""
        tasks = -(-n // TASK)
        if self.roots is not None:
            for side in "ab":
                made = self.rooted(made.withColumnRenamed(side, "key")).select(F.col("root").alias(side), *[c for c in made.columns if c != side])
        links = materialize(made.where("a <> b").distinct().coalesce(tasks), "between")
        if links.isEmpty():
            return
        merged = connected(links, task_rows=TASK).select(F.col("node").alias("was"), F.col("root").alias("now")).coalesce(tasks)
        if self.roots is None:
            self.roots = materialize(merged.select(F.col("was").alias("key"), F.col("now").alias("root")), "roots")
            return
        merged = materialize(merged, "merged")
        old = self.roots.join(merged, F.col("root") == F.col("was"), "left").select("key", F.coalesce("now", "root").alias("root"))
        new = merged.join(self.roots, F.col("was") == F.col("key"), "left_anti").select(F.col("was").alias("key"), F.col("now").alias("root"))
        self.roots = materialize(old.unionByName(new), "roots")

    def rooted(self, rows: DataFrame) -> DataFrame:
        if self.roots is None:
            return rows.withColumn("root", F.col("key"))
        return rows.join(self.roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    def open_nodes(self, rows: DataFrame) -> DataFrame:
        """``rows`` (node, key) of the nodes with more than one class, with their classes and counts."""
        rows = self.rooted(rows)
        classes = rows.groupBy("node", "root").count()
        nodes = classes.groupBy("node").agg(F.sum("count").alias("size"), F.max("count").alias("most"), F.max_by("root", F.struct("count", "root")).alias("top"))
        return rows.join(nodes.where("size > most"), "node").withColumn("minor", F.expr("root <> top"))

    def settle(self, rows: DataFrame, dense: DataFrame | None = None) -> DataFrame:
        """Put aside the nodes of ``rows`` (node, key) that are to be compared; the rows of the others."""
        live = self.open_nodes(rows)
        live = live.withColumn("dense", F.lit(False)) if dense is None else live.join(dense, "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
        live = materialize(live.select("node", "key", ((F.col("size") - F.col("most") <= OPEN) | F.col("dense") & (F.col("size") <= DENSE)).alias("few")), "nodes")
        self.aside.append(live.where("few").select("node", "key"))
        return live.where("NOT few").select("node", "key")

    def units(self, rows: DataFrame, blocks: Column, parts: Column) -> DataFrame:
        """``rows`` (node, key, root, minor) in units: a block of a node's rows with a part of its minor rows."""
        number = lambda n: F.pmod(F.xxhash64("node", "key"), n)
        each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        # A minor row goes to all blocks for its own part, and any row to its own block for all parts.
        own = rows.withColumns({"block": F.explode(each(blocks)), "part": number(parts)}).where("minor")
        rest = rows.withColumns({"block": number(blocks), "part": F.explode(each(parts))})
        rest = rest.where(~F.col("minor") | (F.col("part") != number(parts))).withColumn("minor", F.lit(False))
        return materialize(own.unionByName(rest).select(F.xxhash64("node", "block", "part").alias("unit"), "key", "root", "minor"), "units")

    def of_nodes(self, rows: DataFrame) -> DataFrame:
        """Units of nodes, with the sketches of their entries, grouped by bucket."""
        units = self.units(rows, F.ceil(F.col("size") / BLOCK), F.ceil(F.expr("size - most") / BLOCK))
        return self.in_buckets(units.join(self.sets.select("key", "n", "sketch"), "key"), units.count() // BUCKET)

    def in_buckets(self, units: DataFrame, n: int):
        n = max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), n)
        return units.withColumn("bucket", F.pmod("unit", F.lit(n)).cast("int")).groupBy("bucket")

    def compare(self, rows: DataFrame, forest: bool) -> DataFrame:
        """Candidates (a, b) among the minor rows of each node and all its rows.

        ``forest`` gives pairs that connect what the candidates of a unit connect, else all are given.
        """
        made = materialize(self.of_nodes(rows).applyInArrow(_compare(self.low, self.part, self.whole, forest), "a long, b long"), "found")
        return materialize(made.distinct().coalesce(max(1, -(-made.count() // TASK))), "pairs")

    def confirm(self, rows: DataFrame) -> None:
        """Join the classes of all similar pairs of the nodes of ``rows``.

        The entries with a candidate in a unit meet there again with their full sets, in
        units of their own where these are large, and are compared; the links of a unit are
        a forest.
        """
        limits = self.low, self.part, self.whole
        touched = materialize(self.of_nodes(rows).applyInArrow(_touched(*limits), "unit long, key long, root long, minor boolean"), "touched")
        if not (n := touched.count()):
            return
        sets = self.full(touched.select("key"), n)
        weighed = touched.withColumnRenamed("unit", "node").join(self.sets.select("key", "n"), "key")
        nodes = weighed.groupBy("node").agg(F.sum("n").alias("held"), F.sum(F.expr("if(minor, n, 0)")).alias("minors"))
        units = self.units(weighed.join(nodes, "node"), F.ceil(F.col("held") / HELD), F.ceil(F.col("minors") / HELD)).join(self.sets.select("key", "n", "sketch"), "key")
        held = units.agg(F.sum("n")).first()[0]
        made = self.in_buckets(units.join(sets, "key"), held // HELD).applyInArrow(_confirm(*limits), "a long, b long")
        made = materialize(made.distinct(), "confirmed")
        self.merge(made, max(1, made.count()))

    def meet_hubs(self, rows: DataFrame) -> DataFrame:
        """Verify the pairs of each node's hub, the entry with most of the node's common values.

        Returns whether a node is ``dense``: its pairs share so many minwise values that a
        branching would not leave fewer pairs.
        """
        values = materialize(rows.join(self.sets, "key").select("node", "key", "sketch"), "values")
        counts = values.mapInArrow(_counts, "node long, coded long, n long").groupBy("node", "coded").agg(F.sum("n").alias("count"))
        counts = materialize(counts.withColumn("at", F.expr("shiftright(coded, 16)")), "counts")
        common = counts.groupBy("node", "at").agg(F.max_by(F.expr("coded & 65535").cast("int"), F.struct("count", "coded")).alias("value"))
        common = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("modes"))  # HUB values a node
        mine = F.slice("sketch", PLACES - HUB + 1, HUB)
        share = F.aggregate(F.zip_with(mine, "modes", lambda x, m: F.when(x.cast("int").bitwiseAND(65535) == m["value"], 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
        hubs = values.join(common, "node").groupBy("node").agg(F.max_by("key", F.struct(share.alias("share"), F.col("key"))).alias("hub"))
        size = rows.groupBy("node").agg(F.count("*").alias("size"))
        met = self.rooted(rows).join(hubs.join(size, "node"), "node").withColumns({"minor": F.expr("key = hub"), "most": F.expr("size - 1"), "top": F.when(F.expr("key <> hub"), F.col("root"))})
        self.add(self.compare(materialize(met.select("node", "key", "root", "size", "most", "top", "minor"), "hubs"), False))
        shared = counts.groupBy("node").agg(F.sum(F.col("count") * F.col("count")).alias("shared"))
        return shared.join(size, "node").select("node", (F.col("shared") >= CLOSE * HUB * F.col("size") * F.col("size")).alias("dense"))

    def branch(self, rows: DataFrame, depth: int) -> DataFrame:
        return materialize(rows.mapInArrow(_children(depth), "node long, key long"), "children")

    def links(self) -> None:
        """Connect the classes of all similar pairs."""
        rows = materialize(self.sets.select("key", F.explode("nodes").alias("node")), "children")
        for depth in range(1, DEPTH):
            rows = self.settle(rows)
            if rows.isEmpty():
                break
            dense = self.meet_hubs(rows)
            rows = self.settle(rows, dense)
            if rows.isEmpty():
                break
            rows = self.branch(rows.join(self.sets, "key").select("node", "key", "sketch"), depth)
        self.aside.append(rows)
        every = reduce(DataFrame.unionByName, self.aside)
        self.add(self.compare(materialize(self.open_nodes(every), "open"), True))
        self.confirm(materialize(self.open_nodes(every), "open"))

    def classes(self) -> DataFrame:
        """Rows of ``docs`` as (doc_id, content, n, root); those without words have root -1."""
        self.links()
        named = self.marked.select("doc_id", "content", "name", "n").join(self.rooted(self.sets.select("key", "name")).select("name", "root"), "name", "left")
        return materialize(named.select("doc_id", "content", "n", F.coalesce("root", F.lit(-1).cast("long")).alias("root")), "classes")


def near_duplicates(docs: DataFrame, least: tuple[int, int] = LEAST, recall: float = RECALL) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_shingles, component_id, kept)."""
    rows = Join(docs, least, recall).classes()
    firsts = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(firsts, "root").withColumn("component_id", F.expr("if(n = 0, doc_id, component_id)"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", kept.alias("kept"))
