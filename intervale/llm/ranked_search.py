"""Operator 13: ranked lexical search over a clustered index, documents reordered by
recursive graph bisection.

A bounded sample of documents, with some terms of each, is bisected again and again: each half keeps the documents
whose terms are frequent in it, by swapping those that gain most under the log-gap cost of
the halves' term counts. The halves' counts form a tree; every document of the corpus goes
down it by the same cost and ends in a leaf. Leaves are cut into clusters of bounded size,
and in a cluster the documents are bisected once more, which gives their order. A cluster
is one row of the index: its documents, its terms, and for each term the documents that
hold it, their impacts, and the largest impact, the term's bound.

A query's bound on a cluster sums its terms' weights times bounds. The clusters with the
highest bounds are visited first; the k-th best score they give decides which others can
still hold a result, and only these are visited. A bound equal to that score is still
visited, so ties are settled by doc_id and the result is exact.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its
impact (1000000000 tf) div (1000 tf + 8 m), with m = 100 - 75 + (75 n N) div L.

Defined cases: only A-Z are lower-cased; a null text has no terms; documents without terms
are not counted and never found; queries without terms find nothing; queries that share an
item_id are one query each where their texts differ, and count once where they do not;
rows that share a doc_id are documents of their own, and equal scores of theirs rank side
by side; a null doc_id can be found and ranks after others of its score; a null item_id
has no results; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Documents that fit the tree, and terms of each; documents and postings that a cluster should hold; leaves of the tree at most.
TREE_SAMPLE, SAMPLE_TERMS, CLUSTER, POSTINGS, MAX_LEAVES = 2048, 128, 512, 200_000, 64
#: Distinct terms that a batch of the forward table holds before it is passed on.
BATCH_TERMS = 200_000
#: Rounds of swaps of a bisection; smallest set that is bisected; terms that tell halves apart, a node.
ROUNDS, SMALLEST, NODE_TERMS = 8, 32, 4096
#: Clusters that each query visits first.
FIRST = 4
#: A query block: the visits of a cluster that one task takes at a time.
VISITS = 4096

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile(TERM_PATTERN)


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_UPPER))


_FORWARD = "leaf int, doc_id long, n long, terms array<string>, tfs array<int>"


def _forward(tree):
    """Each document's distinct terms, their counts, and its leaf of the broadcast ``tree`` (without one: 0)."""

    def batch(rows: list[tuple[int | None, int, Counter]]) -> pa.RecordBatch:
        words = [w for _, _, held in rows for w in held]
        ends = np.r_[0, np.cumsum([len(held) for _, _, held in rows])].astype(np.int64)
        leaves = tree.value.leaves(ends, words) if tree else np.zeros(len(rows), np.int32)
        offsets = pa.array(ends, pa.int32())
        counts = pa.array([c for _, _, held in rows for c in held.values()], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(words, pa.string()), counts)]
        names, sizes = (pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), names, sizes, *lists], ["leaf", "doc_id", "n", "terms", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for whole in batches:
            for name, text in zip(whole.column(0).to_pylist(), whole.column(1)):
                if found := terms(text.as_py()):
                    rows.append((name, len(found), Counter(found)))
                    size += len(rows[-1][2])
                if size >= BATCH_TERMS:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def forward(docs: DataFrame, tree=None) -> DataFrame:
    """``docs`` (doc_id, text) as (leaf, doc_id, n, terms, tfs), documents without terms left out."""
    return docs.select("doc_id", "text").mapInArrow(_forward(tree), _FORWARD)


def _cost(counts: np.ndarray, size: float) -> np.ndarray:
    """Bits that a term's gaps take in a half of ``size`` documents, by the half's count of the term.

    Counts of -1, of terms that a half hasn't, give a number that no document uses.
    """
    return counts * np.log2(size / np.maximum(counts + 1.0, 1.0))


def bisect(ends: np.ndarray, words: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split documents, given as runs of term numbers, in halves; and the halves' term counts.

    In each round the documents of either half are ordered by what a move gains, and
    pairs swap as long as both together gain.
    """
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    right = np.arange(n) >= n // 2
    every = np.bincount(words, minlength=n_words)
    for _ in range(ROUNDS):
        side = right[doc]
        b = np.bincount(words[side], minlength=n_words)
        a = every - b
        size_a, size_b = max(1, int((~right).sum())), max(1, int(right.sum()))
        now = _cost(a, size_a) + _cost(b, size_b)
        to_right, to_left = now - _cost(a - 1.0, size_a) - _cost(b + 1.0, size_b), now - _cost(a + 1.0, size_a) - _cost(b - 1.0, size_b)
        gain = np.bincount(doc, np.r_[to_right, to_left][words + side * n_words], minlength=n)
        left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
        left_at, right_at = left_at[np.argsort(-gain[left_at], kind="stable")], right_at[np.argsort(-gain[right_at], kind="stable")]
        m = min(len(left_at), len(right_at))
        swap = gain[left_at[:m]] + gain[right_at[:m]] > 1e-9
        m = int(np.argmin(swap)) if not swap.all() else m
        if not m:
            break
        right[left_at[:m]], right[right_at[:m]] = True, False
    b = np.bincount(words[right[doc]], minlength=n_words)
    return right, every - b, b


def _taken(ends: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the documents ``at``."""
    sizes = np.diff(ends)[at]
    new = np.r_[0, np.cumsum(sizes)]
    return new, words[np.repeat(ends[at] - new[:-1], sizes) + np.arange(new[-1])]


def reordered(ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the documents in the order of recursive bisection."""
    todo, done = [np.arange(len(ends) - 1)], []
    while todo:
        at = todo.pop()
        if len(at) < SMALLEST:
            done.append(at)
            continue
        own, held = _taken(ends, words, at)
        _, held = np.unique(held, return_inverse=True)
        right, _, _ = bisect(own, held, int(held.max()) + 1 if len(held) else 0)
        todo += [at[right], at[~right]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Tree:
    """The sample's halves: an inner node scores a document by its terms, a leaf is a number."""

    def __init__(self, docs: list[list[str]], leaves: int):
        self.count = 0
        names: dict[str, int] = {}
        ends = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
        words = np.fromiter((names.setdefault(w, len(names)) for d in docs for w in d), np.int64, int(ends[-1]))
        self.names = names
        self.root = self._grow(ends, words, leaves)

    def _grow(self, ends: np.ndarray, words: np.ndarray, leaves: int):
        n = len(ends) - 1
        if leaves < 2 or n < 2 * SMALLEST:
            self.count += 1
            return self.count - 1
        right, a, b = bisect(ends, words, len(self.names))
        size_a, size_b = int((~right).sum()), int(right.sum())
        # What a term adds to the cost of the right half more than to that of the left.
        pull = (_cost(b + 1.0, size_b + 1) - _cost(b, size_b)) - (_cost(a + 1.0, size_a + 1) - _cost(a, size_a))
        told = np.argsort(-np.abs(pull) * (a + b), kind="stable")[:NODE_TERMS]
        unseen = float(_cost(np.ones(1), size_b + 1)[0] - _cost(np.ones(1), size_a + 1)[0])
        told = told[a[told] + b[told] > 0]
        left, other = (self._grow(*_taken(ends, words, np.flatnonzero(side)), part) for side, part in ((~right, leaves - leaves // 2), (right, leaves // 2)))
        return told, pull[told], unseen, left, other

    def leaves(self, ends: np.ndarray, words: list[str]) -> np.ndarray:
        """The leaves of documents given as runs of ``words``, none of them empty."""
        miss, at = len(self.names), self.names.get
        found = np.fromiter((at(w, miss) for w in words), np.int64, len(words))
        out = np.zeros(len(ends) - 1, np.int32)
        todo = [(self.root, np.arange(len(out)))]
        while todo:
            node, docs = todo.pop()
            if isinstance(node, int):
                out[docs] = node
            elif len(docs):
                told, pull, unseen, left, right = node
                pulls = np.full(miss + 1, unseen)
                pulls[told] = pull
                own, held = _taken(ends, found, docs)
                stays = np.add.reduceat(pulls[held], own[:-1]) >= 0
                todo += [(left, docs[stays]), (right, docs[~stays])]
        return out


_INDEX = "cluster long, docs array<bigint>, terms array<string>, ends array<int>, places array<int>, impacts array<bigint>, tops array<bigint>"


def _clusters(total: int, length: int):
    """Invert a cluster's documents into its row."""

    def run(bucket: pa.Table) -> pa.Table:
        cluster = bucket.column("cluster")[0].as_py()
        named = list(zip(bucket.column("doc_id").to_pylist(), bucket.column("n").to_pylist()))
        times = Counter(named)
        first = sorted(range(len(named)), key=lambda i: (named[i][0] is None, named[i][0] or 0, named[i][1], bucket.column("terms")[i].as_py() if times[named[i]] > 1 else []))
        found, tfs = (_whole(bucket.column(c)) for c in ("terms", "tfs"))
        coded = found.flatten().dictionary_encode()
        ends = np.r_[0, np.cumsum(found.value_lengths().to_numpy())].astype(np.int64)
        words, tf = coded.indices.to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        first = np.array(first, np.int64)
        order = first[reordered(*_taken(ends, words, first))]
        sizes = np.diff(ends)[order]
        (_, words), (_, tf) = (_taken(ends, x, order) for x in (words, tf))
        named = [named[i] for i in order.tolist()]
        m = np.array([100 - 75 + (75 * n * total) // length for _, n in named], np.int64)
        place = np.repeat(np.arange(len(named)), sizes)
        by_word = np.argsort(words, kind="stable")
        stops = np.cumsum(np.bincount(words, minlength=len(coded.dictionary)))
        impacts = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))[by_word]
        tops = np.maximum.reduceat(impacts, np.r_[0, stops[:-1]])
        lists = {"docs": pa.array([name for name, _ in named], pa.int64()), "terms": coded.dictionary, "ends": pa.array(stops, pa.int32()), "places": pa.array(place[by_word], pa.int32()), "impacts": pa.array(impacts, pa.int64()), "tops": pa.array(tops, pa.int64())}
        return pa.table([pa.array([cluster], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values())], ["cluster", *lists])

    return run


def _whole(column: pa.ChunkedArray) -> pa.ListArray:
    return pa.concat_arrays(column.chunks)


class Index:
    """The clustered index of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        count = docs.count()
        # About twice the sample by hash, then the least hashes of it; of a document the terms of least hash.
        few = forward(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, count // (2 * TREE_SAMPLE)))) == 0))
        told = F.slice(F.array_sort(F.transform("terms", lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), 1, SAMPLE_TERMS)["t"]
        sample = few.select(F.xxhash64("doc_id", "n", "terms").alias("mark"), told.alias("terms")).orderBy("mark", "terms").limit(TREE_SAMPLE).toArrow().column("terms").to_pylist()
        self.tree = Tree(sample, max(1, min(MAX_LEAVES, count // CLUSTER)))
        routed = materialize(forward(docs, self.spark.sparkContext.broadcast(self.tree)), "routed")
        sizes = routed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum(F.size("terms")).alias("p")).collect()  # one row a leaf
        self.total, self.length = sum(r.docs for r in sizes), sum(r.n for r in sizes)
        cuts = {r.leaf: max(-(-r.docs // CLUSTER), -(-r.p // POSTINGS)) for r in sizes}
        first, at = [], 0
        for leaf in range(self.tree.count):
            first.append((leaf, at, cuts.get(leaf, 1)))
            at += cuts.get(leaf, 1)
        plan = F.broadcast(self.spark.createDataFrame(first, "leaf int, first long, cuts long"))  # MAX_LEAVES rows
        number = F.col("first") + F.pmod(F.xxhash64("doc_id", "n", "terms"), F.col("cuts"))
        dealt = routed.join(plan, "leaf").withColumn("cluster", number)
        made = dealt.select("cluster", "doc_id", "n", "terms", "tfs").groupBy("cluster").applyInArrow(_clusters(self.total, max(1, self.length)), _INDEX)
        self.rows = materialize(made, "index")

    def bounds(self) -> DataFrame:
        """A row for each term of each cluster: how many documents hold it, and its largest impact."""
        ends = F.col("ends")
        counts = F.zip_with(ends, F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1)), lambda a, b: a - b)
        listed = F.explode(F.arrays_zip(F.col("terms").alias("term"), counts.alias("df"), F.col("tops").alias("top")))
        return self.rows.select("cluster", listed.alias("t")).select("cluster", F.col("t.term").alias("term"), F.col("t.df").alias("df"), F.col("t.top").alias("top"))


_FOUND = "query long, doc_id long, score long"


def _visit(k: int):
    """Score a cluster's documents for the queries that visit it, and keep the k best of each."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index.num_rows and queries.num_rows:
            asked = list(zip(*(queries.column(c).to_pylist() for c in ("cluster", "query", "terms", "weights"))))
            wanted = {t for _, _, names, _ in asked for t in names}
            for r in range(index.num_rows):
                cluster, docs = index.column("cluster")[r].as_py(), index.column("docs")[r].as_py()
                ends, places, impacts = (np.asarray(index.column(c)[r].values) for c in ("ends", "places", "impacts"))
                at = {t: i for i, t in enumerate(index.column("terms")[r].values.to_pylist()) if t in wanted}
                for own, query, names, weights in asked:
                    if own != cluster:
                        continue
                    score = np.zeros(len(docs), np.int64)
                    for name, w in zip(names, weights):
                        if (i := at.get(name)) is not None:
                            span = slice(ends[i - 1] if i else 0, ends[i])
                            score[places[span]] += w * impacts[span]
                    hits = np.flatnonzero(score)
                    if len(hits) > k:
                        hits = hits[score[hits] >= np.partition(score[hits], -k)[-k]]
                    best = sorted(((-int(score[i]), docs[i] is None, docs[i] or 0) for i in hits))[:k]
                    out += [(query, None if none else name, -s) for s, none, name in best]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


class Search:
    """``items`` (item_id, text) against an index; ``visited`` tells the share of clusters with a term that were opened."""

    def __init__(self, index: Index, items: DataFrame, k: int = K):
        self.index, self.k = index, k
        named = items.where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
        self.queries = materialize(named.withColumn("query", F.xxhash64("item_id", "text")), "queries")
        lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = self.queries.select("query", F.explode(F.regexp_extract_all(lower, F.lit(TERM_PATTERN), F.lit(0))).alias("term"))
        words = words.groupBy("query", "term").agg(F.count("*").alias("times"))
        bounds = materialize(index.bounds().join(words.select("term").distinct(), "term"), "bounds")
        df = bounds.groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.total + 2.0) / (2.0 * F.col("df") + 1.0)))
        weighed = materialize(words.join(df, "term").select("query", "term", (F.col("times") * weight).cast("long").alias("weight")).where("weight > 0"), "weighed")
        self.asked = materialize(weighed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t")).select("query", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "asked")
        self.reach = materialize(bounds.join(weighed, "term").groupBy("query", "cluster").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0"), "reach")

    def visit(self, pairs: DataFrame) -> DataFrame:
        """Results of the queries in the clusters of ``pairs`` (query, cluster).

        Clusters meet their queries in blocks of VISITS; a cluster is copied once for each.
        """
        pairs = materialize(pairs.select("query", "cluster"), "visits")
        many = F.ceil(F.count("*") / VISITS)
        blocks = pairs.groupBy("cluster").agg(many.alias("blocks"))
        queries = pairs.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("query"), "blocks")).drop("blocks").join(self.asked, "query")
        index = self.index.rows.join(blocks, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "tops")
        left = index.select("cluster", "block", "docs", "terms", "ends", "places", "impacts")
        right = queries.select("cluster", "block", "query", "terms", "weights")
        return materialize(left.groupBy("cluster", "block").cogroup(right.groupBy("cluster", "block")).applyInArrow(_visit(self.k), _FOUND), "found")

    def run(self) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "cluster")
        first = materialize(self.reach.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= FIRST).select("query", "cluster"), "first")
        found = self.visit(first)
        kth = _best(found, self.k).where(F.col("rank") == self.k).select("query", F.col("score").alias("kth"))
        self.open = self.reach.join(kth, "query", "left").where("kth IS NULL OR bound >= kth").join(first, ["query", "cluster"], "left_anti")
        best = _best(found.unionByName(self.visit(self.open)), self.k)
        return best.join(self.queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")

    def visited(self) -> float:
        """Visits after ``run`` as a share of all (query, cluster) pairs with a common term."""
        pairs = self.reach.count()
        return (self.open.count() + self.reach.groupBy("query").agg(F.least(F.count("*"), F.lit(FIRST)).alias("n")).agg(F.sum("n")).first()[0]) / pairs if pairs else 0.0


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents of each item: (item_id, rank, doc_id, score)."""
    return Search(Index(docs), items, k).run()
