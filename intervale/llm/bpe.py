"""Operator 1: BPE encoding and decoding by a distinct-word table.

Words are runs without ASCII white space; this tokenizer drops white space, so a
text's ids are the ids of its words in order. Documents are gathered into blocks
of bounded size. A block keeps each of its distinct words once, and each document
as positions in that list. The distinct words of all blocks meet in hash buckets,
where each is encoded once, and their ids go back to the block by position.
Decoding looks each id up in the id-to-piece table, which the vocabulary bounds.

Defined cases: a null or empty text, or one of white space, has no ids and decodes
to the empty string; repeated rows stay as they are; a text longer than a block is
a block of its own; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Code points to a block; a block's dictionary and positions are held in memory.
BLOCK_CHARS = 12_000_000
#: Distinct words that an encoding task remembers before it starts anew.
MEMO_WORDS = 1_000_000

_HELD = "block long, doc_id long, positions binary"
_LISTED = "block long, bucket int, words binary"


def _pack(values: np.ndarray) -> bytes:
    """Integers as zlib-compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Block:
    def __init__(self, number: int):
        self.number, self.chars, self.at, self.docs = number, 0, {}, []

    def add(self, doc_id, text: str) -> None:
        at, words = self.at, text.encode().split()
        self.docs.append((doc_id, np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))))
        self.chars += len(text)

    def rows(self, buckets: int, listed: bool) -> Iterator[pa.RecordBatch]:
        """The words of each bucket, or the documents as positions.

        A word's position is its rank by frequency in its bucket, interleaved, so
        that common words have small positions and a position names its bucket.
        """
        words = list(self.at)
        counts = np.bincount(np.concatenate([p for _, p in self.docs]), minlength=len(words))
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.lexsort((np.arange(len(words)), -counts, bucket))
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        if listed:
            found = [b for b in range(buckets) if starts[b] < starts[b + 1]]
            made = ((self.number, b, zlib.compress(b"\n".join([words[i] for i in order[starts[b] : starts[b + 1]]]), 6)) for b in found)
            names, second = ["block", "bucket", "words"], pa.int32()
        else:
            place = np.empty(len(words), np.int64)
            place[order] = (np.arange(len(words)) - starts[bucket[order]]) * buckets + bucket[order]
            made = ((self.number, d, _pack(place[p])) for d, p in self.docs)
            names, second = ["block", "doc_id", "positions"], pa.int64()
        while part := list(islice(made, 1000)):
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), second, pa.binary()))], names)


def _split(buckets: int, block_chars: int, listed: bool):
    """Cut a task's documents into blocks.

    The words and the positions come from two passes over the same scan, which cuts
    the same blocks; that costs a second split of the text and saves a stored copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if block.docs and block.chars + len(text) > block_chars:
                    yield from block.rows(buckets, listed)
                    number += 1
                    block = _Block(number)
                block.add(doc_id, text)
        if block.docs:
            yield from block.rows(buckets, listed)

    return run


def _encode(tokenizer_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        memo: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for block, bucket, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = zlib.decompress(blob).split(b"\n")
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                new = [w for w in words if w not in memo]
                for i in range(0, len(new), 4096):
                    part = new[i : i + 4096]
                    for w, e in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                        memo[w] = np.array(e.ids, "<u4").tobytes()
                ids = [memo[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                out.append((block, bucket, _pack(sizes), _pack(np.frombuffer(b"".join(ids), "<u4"))))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    ["block", "bucket", "sizes", "ids"],
                )

    return run


def _assemble(pieces, buckets: int):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        piece = pieces.value
        parts = [(b, _unpack(s), _unpack(i)) for b, s, i in zip(*(words.column(k).to_pylist() for k in ("bucket", "sizes", "ids")))]
        top = max((len(s) for _, s, _ in parts), default=0) * buckets
        start, size, flat = np.zeros(top, np.int64), np.zeros(top, np.int64), [np.empty(0, "<u4")]
        at = 0
        for b, s, i in parts:
            place = np.arange(len(s)) * buckets + b
            size[place], start[place] = s, at + np.cumsum(s) - s
            flat.append(i)
            at += len(i)
        flat = np.concatenate(flat)
        ids, texts = [], []
        for blob in docs.column("positions").to_pylist():
            p = _unpack(blob)
            n = size[p]
            end = np.cumsum(n)
            found = flat[np.repeat(start[p] - end + n, n) + np.arange(end[-1] if len(end) else 0)]
            ids.append(found.tobytes())
            texts.append(" ".join([piece[i] for i in found.tolist()]))
        return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())})

    return run


def pieces_of(tokenizer_json: str) -> dict[int, str]:
    """The id-to-piece table of a tokenizer file, added tokens included."""
    made = json.loads(tokenizer_json)
    return {i: p for p, i in made["model"]["vocab"].items()} | {t["id"]: t["content"] for t in made["added_tokens"]}


def encode_decode(docs: DataFrame, tokenizer_path: str, block_chars: int = BLOCK_CHARS, stable: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, ids, decoded).

    ``ids`` is binary: little-endian unsigned 32-bit integers. ``tokenizer_path`` is
    read on the driver; tasks get its content, which the vocabulary bounds. The texts are
    gone through twice: they are stored first, unless ``stable`` says that ``docs`` are read
    straight from files, in the same order each time.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", "text")
    if not stable:
        texts = materialize(texts, "texts")
    words = texts.mapInArrow(_split(buckets, block_chars, True), _LISTED)
    encoded = words.repartition(buckets, "bucket").mapInArrow(_encode(tokenizer_json), "block long, bucket int, sizes binary, ids binary")
    held = texts.mapInArrow(_split(buckets, block_chars, False), _HELD)
    pieces = spark.sparkContext.broadcast(pieces_of(tokenizer_json))
    return held.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(pieces, buckets), "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The query's columns of ``encode_decode``'s result."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
