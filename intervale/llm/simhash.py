"""Operator 7: SimHash near-duplicates by vantage-point trees.

A fingerprint's bits are majorities over the XXH64 hashes of a text's word shingles.
Distinct fingerprints are dealt to shards by a vantage-point tree: each inner node
holds a fingerprint and a distance; those within the distance go in, the others out.
A fingerprint within reach of a node's shell from inside also goes out (triangle
bound), so every pair within ``max_bits`` meets in a shard. In a shard the same
splitting goes on down to small sets, whose pairs are compared. A set that no shell
divides (a dense ball) is searched by listing each member's neighbours instead, which
stays linear. A shard returns its links as a forest, and components join the forests.

The shard tree is fitted on the least fingerprints by hash, SAMPLED a shard and TREE_SAMPLE
(8 MB) at most; all fingerprints pass through it. Beyond MAX_SHARDS x SHARD_SIZE distinct
fingerprints shards grow, at 8 bytes a fingerprint and copy.

Defined cases: a text without words (null, empty) has fingerprint zero and is linked
like any other; equal texts have equal fingerprints; repeated rows each keep a row;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Fingerprints that fit the shard tree, and how many a shard should hold.
TREE_SAMPLE, SHARD_SIZE, MAX_SHARDS = 1 << 20, 20_000, 16_384
#: Fingerprints of the sample to a shard.
SAMPLED = 64
#: Sets of at most LEAF are compared pair by pair; denser sets above DENSE by listing neighbours.
LEAF, DENSE = 256, 4096
_CHUNK = 50_000


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [line]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [line[a:b] for a, b in zip(starts, ends[size - 1 :])]


def _fingerprints(seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                found = shingles(text.as_py(), size)
                ones = np.zeros(64, np.int64)
                for k in range(0, len(found), _CHUNK):
                    part = found[k : k + _CHUNK]
                    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in part), "<u8", len(part))
                    ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, seed: int = SEED, size: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fp), fp the 64 bits as a long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(seed, size), "doc_id long, fp long")


def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def split(fps: np.ndarray, rng, reach: int) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """A vantage point, its shell, and masks of who goes in and who out; None if no shell divides."""
    best = None
    for at in rng.integers(0, len(fps), 4):
        d = _distance(fps, fps[at])
        counts = np.bincount(d, minlength=66)
        inside = np.cumsum(counts)
        for shell in range(65):
            overlap = counts[max(0, shell - reach + 1) : shell + 1].sum()
            largest = max(inside[shell], len(fps) - inside[shell] + overlap)
            if best is None or largest + overlap < best[0]:
                best = (largest + overlap, int(at), shell, largest)
    _, at, shell, largest = best
    if largest > 0.9 * len(fps):
        return None
    d = _distance(fps, fps[at])
    return fps[at], shell, d <= shell, d > shell - reach


class ShardTree:
    """A vantage-point tree as nested tuples; leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, shards: int, reach: int):
        self.reach, self.count = reach, 0
        self.root = self._grow(sample, shards, np.random.default_rng(7))

    def _grow(self, fps: np.ndarray, shards: int, rng):
        cut = split(fps, rng, self.reach) if shards > 1 and len(fps) >= 32 else None
        if cut is None:
            self.count += 1
            return self.count - 1
        point, shell, within, without = cut
        few = max(1, min(shards - 1, round(shards * within.sum() / (within.sum() + without.sum()))))
        return point, shell, self._grow(fps[within], few, rng), self._grow(fps[without], shards - few, rng)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shards and the places of the fingerprints that go there."""
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            point, shell, within, without = node
            d = _distance(fps[at], point)
            todo += [(within, at[d <= shell]), (without, at[d > shell - self.reach])]


def _route(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at in tree.value.route(fps):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(fps[at].view(np.int64))], ["shard", "fp"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _compare(fps: np.ndarray, at: np.ndarray, forest: _Forest, reach: int) -> None:
    """All pairs of a set, a block of rows at a time."""
    for i in range(0, len(at), 512):
        a, b = np.nonzero(_distance(fps[at[i : i + 512], None], fps[None, at]) <= reach)
        later = a + i < b
        forest.join(at[a[later] + i], at[b[later]])


def _neighbours(fps: np.ndarray, at: np.ndarray, forest: _Forest, reach: int) -> None:
    """Pairs of a dense set: look up every fingerprint that differs in few bits."""
    order = at[np.argsort(fps[at])]
    known, one = fps[order], np.uint64(1)
    for bits in range(1, reach + 1):
        for places in combinations(range(64), bits):
            mask = np.bitwise_or.reduce([one << np.uint64(p) for p in places])
            near = known ^ mask
            found = np.minimum(np.searchsorted(known, near), len(known) - 1)
            hit = (known[found] == near) & (near > known)
            if hit.any():
                forest.join(order[hit], order[found[hit]])


def linked(fps: np.ndarray, reach: int = MAX_BITS, leaf: int = LEAF, dense: int = DENSE) -> np.ndarray:
    """For distinct fingerprints, the place of the least one in each one's component."""
    forest, rng, todo = _Forest(len(fps)), np.random.default_rng(11), [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        cut = split(fps[at], rng, reach) if len(at) > leaf else None
        if cut is not None:
            todo += [at[cut[2]], at[cut[3]]]
        elif len(at) > dense:
            _neighbours(fps, at, forest, reach)
        elif len(at) > 1:
            _compare(fps, at, forest, reach)
    return np.array([forest.find(i) for i in range(len(fps))], np.int64)


def _links(reach: int):
    def run(shard: pa.Table) -> pa.Table:
        fps = np.unique(shard.column("fp").to_numpy().view(np.uint64))
        root = linked(fps, reach)
        own = root != np.arange(len(fps))
        return pa.table({"a": fps[own].view(np.int64), "b": fps[root[own]].view(np.int64)})

    return run


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect what pairs of ``distinct`` (fp) within ``max_bits`` connect."""
    spark = distinct.sparkSession
    n = distinct.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_SIZE))
    shards = max(1, min(MAX_SHARDS, wanted, n // LEAF))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(TREE_SAMPLE, max(16_384, SAMPLED * shards))).toArrow()
    tree = spark.sparkContext.broadcast(ShardTree(sample.column("fp").to_numpy().view(np.uint64), shards, max_bits))
    dealt = distinct.mapInArrow(_route(tree), "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(_links(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, seed: int = SEED, size: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, fp, component_id)."""
    marked = materialize(fingerprints(docs, seed, size), "simhash")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(link_fingerprints(least.select("fp"), max_bits))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(firsts, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
