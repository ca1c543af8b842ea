"""Operator 10: nearest neighbours by vantage-point trees per shard.

Vectors are scaled to length one, where the chord is a metric and orders like the
cosine. Equal vectors share one entry that lists the few least ids, which is all a
result can name. Entries are dealt to shards by a vantage-point tree fitted on a
bounded sample, and every shard holds a vantage-point tree of its own. A query first
searches the shard it falls in, which gives a bound on its k-th distance; then it
goes to every shard that the triangle inequality cannot rule out.

``factor`` relaxes the pruning: a branch is skipped when its least possible distance,
times ``factor``, exceeds the k-th distance so far. One restores exact search; more
skips branches that might hold a neighbour nearer by less than that ratio. Scores
are recomputed in double precision on the original vectors. ``visited`` tells how much
the pruning leaves.

A shard's entries are split into parts of bounded size, and the queries sent to it into
blocks; a task holds one part and one block. A part is copied once for QUERY_BLOCK
queries that come to it, so what is copied never outgrows what is sent.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers
take no part, as query or candidate; vectors of another length than the query are no
candidates; ties go to the smaller vec_id; rows that repeat a vec_id and vector count
once; fewer candidates than k give as many rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, FACTOR, QUERY_EVERY = 5, 1.0, 50
#: Vectors that fit the shard trees, entries a shard should hold and a part holds, and shards of a tree at most.
TREE_SAMPLE, SHARD_SIZE, MAX_SHARDS = 8192, 8192, 2048
LEAF, QUERY_BLOCK = 256, 50_000
_SLACK = 1e-6  # above the rounding of chords in double precision


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id and the vector in doubles, of the rows that take part."""
    v = F.transform(name, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
    return rows.where(F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, each sum taken from the first component to the last."""
    dot, own, other = np.zeros(len(m)), 0.0, np.zeros(len(m))
    for j, x in enumerate(q.tolist()):
        column = m[:, j]
        dot += column * x
        other += column * column
        own += x * x
    return dot / (np.sqrt(other) * np.sqrt(own))


def _chord(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q @ p.T)))


class Tree:
    """A vantage-point tree; a leaf is an array of places, a node (point, radius, in, out)."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaves, self.rng = points, [], np.random.default_rng(5)
        self.root = self._grow(np.arange(len(points)), leaf)

    def _grow(self, at: np.ndarray, leaf: int):
        if len(at) > leaf:
            p = self.points[at[self.rng.integers(len(at))]]
            d = _chord(self.points[at], p[None])[:, 0]
            radius = float(np.median(d))
            within = d <= radius
            if 0 < within.sum() < len(at):
                return p, radius, self._grow(at[within], leaf), self._grow(at[~within], leaf)
        self.leaves.append(at)
        return len(self.leaves) - 1

    def home(self, queries: np.ndarray) -> np.ndarray:
        """The leaf each query falls in."""
        out, todo = np.empty(len(queries), np.int32), [(self.root, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
            elif len(at):
                p, radius, within, without = node
                d = _chord(queries[at], p[None])[:, 0]
                todo += [(within, at[d <= radius]), (without, at[d > radius])]
        return out

    def reach(self, queries: np.ndarray, bound, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the queries that may find something nearer than ``bound`` there.

        ``bound`` is read at each leaf anew, so that what was found narrows the rest;
        the side a query lies on is visited first.
        """
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, at, least = todo.pop()
            open_ = least * factor <= bound[at] + _SLACK
            at, least = at[open_], least[open_]
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            p, radius, within, without = node
            d = _chord(queries[at], p[None])[:, 0]
            near_in, near_out = np.maximum(least, d - radius), np.maximum(least, radius - d)
            inside = d <= radius
            todo += [(without, at[inside], near_out[inside]), (within, at[~inside], near_in[~inside])]
            todo += [(without, at[~inside], near_out[~inside]), (within, at[inside], near_in[inside])]


def _search(queries: np.ndarray, tree: Tree, bound: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
    """Places of each query's k nearest entries, ties at the k-th included."""
    best = [(np.empty(0), np.empty(0, np.int64)) for _ in queries]
    for leaf, at in tree.reach(queries, bound, factor):
        places = tree.leaves[leaf]
        d = _chord(queries[at], tree.points[places])
        for row, q in zip(d, at.tolist()):
            keep = row <= bound[q] + _SLACK
            far, where = np.concatenate([best[q][0], row[keep]]), np.concatenate([best[q][1], places[keep]])
            if len(far) >= k:
                bound[q] = min(bound[q], np.partition(far, k - 1)[k - 1])
                near = far <= bound[q] + _SLACK
                far, where = far[near], where[near]
            best[q] = far, where
    return [w for _, w in best]


def _lookup(k: int, factor: float):
    """Search one shard's entries for the queries that came to it.

    Entries: v, ids. Queries: query_id, v, bound. An entry that is the query's own
    gives no distance of its own, so one more entry than k is looked for.
    """

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if entries.num_rows and queries.num_rows:
            raw, asked = _matrix(entries.column("v")), _matrix(queries.column("v"))
            ids, names = entries.column("ids").to_pylist(), queries.column("query_id").to_pylist()
            bound = queries.column("bound").to_numpy().copy()
            found = _search(_unit(asked), Tree(_unit(raw), LEAF), bound, k + 1, factor)
            for name, q, places in zip(names, asked, found):
                scores = cosines(q, raw[places])
                rows = sorted((-s, i) for s, p in zip(scores.tolist(), places.tolist()) for i in ids[p] if i != name)
                out += [(name, i, -s) for s, i in rows[:k]]
        columns = list(zip(*out)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "vec_id", "score"])

    return run


class Forest:
    """A shard tree for each length of vectors; shards are numbered through."""

    def __init__(self, sample: list[list[float]], sizes: dict[int, int]):
        by_length: dict[int, list] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.trees: dict[int, tuple[Tree, int]] = {}
        self.shards = 0
        for length, n in sorted(sizes.items()):
            if points := by_length.get(length):
                wanted = min(MAX_SHARDS, -(-n // SHARD_SIZE))
                tree = Tree(_unit(np.array(points, float)), max(1, len(points) // wanted))
                self.trees[length] = tree, self.shards
                self.shards += len(tree.leaves)
            else:  # the sample missed a rare length: one shard, below the others
                self.shards += 1

    def home(self, length: int, unit: np.ndarray) -> np.ndarray:
        if length not in self.trees:
            return np.full(len(unit), -length, np.int32)
        tree, first = self.trees[length]
        return tree.home(unit) + np.int32(first)

    def reach(self, length: int, unit: np.ndarray, bound: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        if length in self.trees:
            tree, first = self.trees[length]
            for leaf, at in tree.reach(unit, bound, factor):
                yield first + leaf, at


def _lengths(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths of a batch's vectors, and the places of each."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(n).tolist():
        yield length, np.flatnonzero(n == length)


def _deal(forest, name: str):
    """Put each row (``name``, v) into its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at in _lengths(batch.column(1)):
                part = batch.take(pa.array(at))
                shard = forest.value.home(length, _unit(_matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *part.columns], ["shard", name, "v"])

    return run


def _visit(forest, factor: float):
    """Send each query to the shards that its bound leaves open, but its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for length, rows in _lengths(whole.column(2)):
                batch = whole.take(pa.array(rows))
                queries, bound = _unit(_matrix(batch.column(2))), batch.column(3).to_numpy(zero_copy_only=False)
                own = batch.column(0).to_numpy(zero_copy_only=False)
                for shard, at in forest.value.reach(length, queries, bound, factor):
                    at = at[own[at] != shard]
                    if len(at):
                        sent = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), *sent.columns[1:]], ["shard", "query_id", "v", "bound"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SENT = "shard int, query_id long, v array<double>, bound double"


class _Search:
    """The entries of a table in their shards, and its queries."""

    def __init__(self, vectors: DataFrame, k: int, every: int, factor: float):
        self.k, self.factor, self.spark = k, factor, vectors.sparkSession
        rows = materialize(usable(vectors).distinct(), "vectors")
        least = Window.partitionBy("v").orderBy("vec_id")
        few = rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)
        entries = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
        sizes = {r.length: r["count"] for r in entries.groupBy(F.size("v").alias("length")).count().collect()}  # one row a vector length
        sample = [r.v for r in entries.orderBy(F.xxhash64("v")).select("v").limit(TREE_SAMPLE).collect()]
        self.forest = Forest(sample, sizes)
        self.tree = self.spark.sparkContext.broadcast(self.forest)
        self.dealt = materialize(entries.select("ids", "v").mapInArrow(_deal(self.tree, "ids"), "shard int, ids array<bigint>, v array<double>"), "dealt")
        self.parts = {r.shard: -(-r["count"] // (2 * SHARD_SIZE)) for r in self.dealt.groupBy("shard").count().collect()}  # one row a shard
        asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(_deal(self.tree, "query_id"), "shard int, query_id long, v array<double>")
        self.asked = materialize(asked.withColumn("bound", F.lit(2.1)), "asked")

    def meet(self, sent: DataFrame) -> DataFrame:
        """What queries ``sent`` (shard, query_id, v, bound) find: query_id, vec_id, score."""
        sent = materialize(sent, "sent")
        counts = sent.groupBy("shard").count().collect()  # one row a shard
        plan = [(r.shard, self.parts[r.shard], -(-r["count"] // QUERY_BLOCK)) for r in counts if r.shard in self.parts]
        plan = F.broadcast(self.spark.createDataFrame(plan, "shard int, parts int, blocks int"))
        number = lambda *by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        entries = self.dealt.join(plan, "shard").withColumn("part", number("v", n="parts")).withColumn("block", each("blocks")).drop("parts", "blocks")
        queries = sent.join(plan, "shard").withColumn("block", number("query_id", "v", n="blocks")).withColumn("part", each("parts")).drop("parts", "blocks")
        keys = ["shard", "part", "block"]
        entries, queries = (df.select(*keys, *[c for c in df.columns if c not in keys]) for df in (entries, queries))
        return entries.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_lookup(self.k, self.factor), "query_id long, vec_id long, score double")

    def at_home(self) -> DataFrame:
        return materialize(self.meet(self.asked), "home")

    def away(self, at_home: DataFrame) -> DataFrame:
        """Queries as they go to other shards, each with its bound."""
        kth = _best(at_home, self.k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        kth = kth.where(F.col("n") == self.k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth"))).alias("near"))
        bound = self.asked.drop("bound").join(kth, "query_id", "left").select("shard", "query_id", "v", F.coalesce("near", F.lit(2.1)).alias("bound"))
        return bound.mapInArrow(_visit(self.tree, self.factor), _SENT)


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, factor: float = FACTOR) -> DataFrame:
    """``vectors`` (vec_id, embedding) as (query_id, rank, vec_id, score).

    Queries are the rows whose vec_id is divisible by ``every``.
    """
    search = _Search(vectors, k, every, factor)
    home = search.at_home()
    return _best(home.unionByName(search.meet(search.away(home))), k)


def visited(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, factor: float = FACTOR) -> float:
    """The share of (query, shard) pairs that the pruning leaves."""
    search = _Search(vectors, k, every, factor)
    pairs = search.asked.count() * search.forest.shards
    return (search.asked.count() + search.away(search.at_home()).count()) / pairs if pairs else 0.0
