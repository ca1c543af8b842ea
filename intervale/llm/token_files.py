"""Operator 5: token files of patched frame-of-reference blocks.

Documents are encoded, each ends with ``end_id``, and ids are written in ascending
doc_id order (null first; equal doc_ids by the hash of their text, then by text). The
file format is a sequence of segments, rows of a Parquet table that Spark commits as a
whole: (shard, segment, offset in the shard, n_ids, payload). A payload holds whole
documents:

    magic "PFR1", counts of documents, blocks and exceptions (unsigned 64-bit)
    doc ids (signed 64-bit) and their null flags, tokens of each document (u32)
    start of each block's packed bits (u32), block minimum (u32), bit width (u8),
    exceptions of each block (u8), their places (u8) and high parts (u32)
    packed low bits of 128 differences to the minimum, block after block

A block's width is the least that fits nine of ten of its differences. The rest
keep their low bits in place and their high parts in the exception list. ``fetch``
seeks by the block index: it decodes only the blocks that a range of ids touches.

Text is cut before blanks, and each distinct piece is encoded once by the library's own
model step; words of Latin text are split by a copy of the tokenizer's published pattern,
which tests hold against the library. Where no token of a byte-level vocabulary holds a
blank inside, every blank starts a token, so a cut there changes no id. Texts with one of
the few tokens that do hold one go to the library whole. Tokenizers of other kinds are
refused.

Defined cases: a null or empty text is just the end id; repeated rows are written
each; the last block of a segment repeats its last id to fill up; empty input gives
no segments. Rows of one doc_id spread over tasks by the hash of their text.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path

BLOCK, FITS = 128, 115
#: Ids in a segment; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 20
#: Rows of a writing task, where the cluster's shuffle partitions would be fewer.
TASK_ROWS = 50_000
#: Bytes of text that are cut at once, and pieces and words that a worker remembers before it starts anew.
_CHUNK, _MEMO = 8_000_000, 1_300_000
_FILE = "shard int, segment int, offset long, n_ids long, payload binary"
_READ = "doc_id long, start long, n_tokens long, shard int, segment int, at long, ids binary"
#: Code points beyond Latin, and those that are joined or split by; pieces with one go to the library whole.
_ODD = re.compile(r"[^\x01-\x1b\x20-\x84\x86-\u024f]")
# The byte-level tokenizer's split, for Latin text.
_LETTER, _DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")
#: A piece of letters that ends with one of these has two words.
_MARKS = set(string.punctuation)
#: The letter that stands for a blank.
_BLANK = chr(0x120)
#: Distinct texts of tokens with a blank inside up to which a tokenizer is taken.
MAX_CROSSINGS = 16


def byte_letters() -> str:
    """The letters that stand for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def refusal(tokenizer_json: str) -> str | None:
    """Why texts of this tokenizer cannot be cut before blanks; None if they can."""
    made = json.loads(tokenizer_json)
    model, split = made["model"], made.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return "its model is not plain BPE"
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return "it does not split into byte-level words that start with their blank"
    if made.get("normalizer") is not None:
        return "it normalizes text"
    if any(t.get(k) for t in made["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or any(" " in t["content"] for t in made["added_tokens"]):
        return "an added token takes blanks or words around it"
    if len(crossings(tokenizer_json)) > MAX_CROSSINGS:
        return "many tokens hold a blank after their start"
    return None


def crossings(tokenizer_json: str) -> list[str]:
    """The shortest texts of tokens that hold a blank after their start, which a cut could break."""
    letters = {c: b for b, c in enumerate(byte_letters())}
    tokens = [t for t in json.loads(tokenizer_json)["model"]["vocab"] if _BLANK in t[1:]]
    found = sorted({bytes(letters[c] for c in t).decode("utf-8", "replace") for t in tokens}, key=len)
    return [t for k, t in enumerate(found) if not any(u in t for u in found[:k])]


class Encoder:
    """The tokenizer's ids of texts, by way of the ids of their distinct pieces."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if why := refusal(tokenizer_json):
            raise ValueError(f"this tokenizer cannot be used: {why}")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.crossings = crossings(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        """Forget all pieces. A piece is a number: its place in ``size`` and ``start``, which point into ``ids``."""
        self.pieces: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.count = self.used = 0
        self.start, self.size, self.ids = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), np.empty(1 << 18, np.uint32)
        self.words: dict[str, int] = {}

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Store pieces' ids; their numbers."""
        while self.count + len(sizes) > len(self.size):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        at = slice(self.count, self.count + len(sizes))
        self.size[at], self.start[at] = sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.count, self.used = at.stop, self.used + len(ids)
        return np.arange(at.start, at.stop)

    def _library(self, texts: list[str]) -> np.ndarray:
        """Numbers of texts that the library encodes whole."""
        made = [e.ids for i in range(0, len(texts), 256) for e in self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return self._keep(np.array([x for m in made for x in m], np.uint32), np.array([len(m) for m in made], np.int64))

    def _pieces(self, names: list[str]) -> np.ndarray:
        """Numbers of pieces, each behind a blank."""
        found = list(map(self.pieces.get, names))
        if None in found:
            new = [p for p, k in zip(names, found) if k is None]
            if _ODD.search("\n".join(new)) or any(s in p for s in self.special for p in new):
                odd = [p for p in new if _ODD.search(p) or any(s in p for s in self.special)]
                self.pieces.update(zip(odd, self._library([f" {p}" for p in odd]).tolist()))
                new = [p for p in new if p not in self.pieces]
            self._learn(new)
            found = list(map(self.pieces.__getitem__, names))
        return np.array(found, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Number new pieces by way of the words that the tokenizer's split leaves whole."""
        words, counts, split = [], [], _WORDS.findall
        for p in new:
            if p.isalpha():
                words.append(" " + p)
                counts.append(1)
            elif p[-1:] in _MARKS and p[:-1].isalpha():
                words += (" " + p[:-1], p[-1])
                counts.append(2)
            else:
                found = split(" " + p)
                words += found
                counts.append(len(found))
        number = list(map(self.words.get, words))
        if None in number:
            fresh = list({w for w, k in zip(words, number) if k is None})
            mapped = "\0".join(fresh).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
            made = list(map(self.tokenizer.model.tokenize, mapped))
            ids = np.fromiter(map(attrgetter("id"), chain.from_iterable(made)), np.uint32)
            self.words.update(zip(fresh, self._keep(ids, np.fromiter(map(len, made), np.int64, len(made))).tolist()))
            number = list(map(self.words.__getitem__, words))
        if new:
            ids, size = self._gathered(np.array(number, np.int32))
            counts = np.array(counts)
            self.pieces.update(zip(new, self._keep(ids, np.add.reduceat(size, np.cumsum(counts) - counts)).tolist()))

    def _gathered(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        size = self.size[number]
        at = np.repeat(self.start[number] - np.cumsum(size, dtype=np.int32) + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for crossing in self.crossings:
            whole |= pc.match_substring(texts, crossing).to_numpy(zero_copy_only=False)
        borders = np.flatnonzero(np.diff(whole, prepend=not whole[0], append=not whole[-1])).tolist()
        parts = [(self._whole if whole[i] else self._cut)(texts.slice(i, j - i)) for i, j in zip(borders, borders[1:])]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.count > _MEMO:
            self.clear()
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        at = self._pieces(names := coded.dictionary.to_pylist())[codes]
        # The first piece of a text has no blank before it.
        heads = [names[c] for c in codes[first].tolist()]
        if new := list({h for h in heads if h not in self.heads}):
            self.heads.update(zip(new, self._library(new).tolist()))
        at[first] = [self.heads[h] for h in heads]
        ids, size = self._gathered(at)
        return ids, np.add.reduceat(size, first, dtype=np.int64)

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder, which outlives a task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """Left by ``by`` bits, right where it is negative."""
    return x << np.uint64(by) if by >= 0 else x >> np.uint64(-by)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2^width as rows of bytes, high bits first. Eight values fill ``width`` bytes."""
    v = values.astype(np.uint64).reshape(len(values), -1, 8)
    out = np.zeros((*v.shape[:2], width), np.uint8)
    for k in range(width):  # byte k holds bits 8 k to 8 k + 7 of the eight values laid end to end
        byte = np.zeros(v.shape[:2], np.uint64)
        for i in range(8 * k // width, (8 * k + 7) // width + 1):
            byte |= _shift(v[:, :, i], 8 * (k + 1) - width * (i + 1))
        out[:, :, k] = byte.astype(np.uint8)
    return out.reshape(len(values), -1)


def _unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    b = packed.reshape(len(packed), -1, width).astype(np.uint64)
    out = np.zeros((*b.shape[:2], 8), np.uint64)
    for i in range(8):
        for k in range(width * i // 8, (width * (i + 1) - 1) // 8 + 1):
            out[:, :, i] |= _shift(b[:, :, k], width * (i + 1) - 8 * (k + 1))
    return (out & np.uint64((1 << width) - 1)).reshape(len(packed), -1)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of whole numbers below 2^53, from the exponents of doubles."""
    return np.maximum((values.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.uint8)


def pack(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """One segment's payload."""
    n = -(-len(ids) // BLOCK)
    flat = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.int64).reshape(n, BLOCK)
    least = flat.min(axis=1)
    flat -= least[:, None]
    bits = bit_lengths(flat)
    width = np.partition(bits, FITS - 1, axis=1)[:, FITS - 1]
    block, place = np.nonzero(bits > width[:, None])
    high = flat[block, place] >> width[block]
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * BLOCK // 8)])
    out = np.zeros(start[-1], np.uint8)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            packed = _pack_bits(flat[rows] & ((1 << w) - 1), w)
            out[start[rows][:, None] + np.arange(packed.shape[1])] = packed
    known = [0 if d is None else d for d in doc_ids]
    parts = [
        struct.pack("<4sQQQ", b"PFR1", len(doc_ids), n, len(block)),
        np.array(known, "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array(sizes, "<u4"),
        start[:-1].astype("<u4"), least.astype("<u4"), width, np.bincount(block, minlength=n).astype("u1"),
        place.astype("u1"), high.astype("<u4"), out,
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Segment:
    """A payload's index; ids are decoded block by block on demand."""

    def __init__(self, payload: bytes):
        magic, docs, self.blocks, exceptions = struct.unpack_from("<4sQQQ", payload)
        if magic != b"PFR1":
            raise ValueError("not a PFR1 segment")
        at = struct.calcsize("<4sQQQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, count, at)
            at += got.nbytes
            return got

        known, null, self.sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.start, self.least, self.width, count = take("<u4", self.blocks), take("<u4", self.blocks), take("u1", self.blocks), take("u1", self.blocks)
        self.place, self.high = take("u1", exceptions), take("<u4", exceptions)
        self.bits = np.frombuffer(payload, "u1", offset=at)
        self.patches = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        self.doc_ids = [None if z else d for d, z in zip(known.tolist(), null)]

    def decode(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` up to ``last``."""
        start, width = self.start[first:last].astype(np.int64), self.width[first:last]
        flat = np.zeros((last - first, BLOCK), np.int64)
        for w in np.unique(width).tolist():
            if w:
                rows = np.flatnonzero(width == w)
                flat[rows] = _unpack_bits(self.bits[start[rows][:, None] + np.arange(w * BLOCK // 8)], w)
        lo, hi = self.patches[first], self.patches[last]
        block = np.repeat(np.arange(last - first), np.diff(self.patches[first : last + 1]))
        flat[block, self.place[lo:hi]] |= self.high[lo:hi].astype(np.int64) << width[block].astype(np.int64)
        return (flat + self.least[first:last].astype(np.int64)[:, None]).reshape(-1).astype("<u4")

    def slice(self, at: int, n: int) -> np.ndarray:
        """``n`` ids from place ``at`` on; only their blocks are decoded."""
        first, last = at // BLOCK, -(-(at + n) // BLOCK)
        return self.decode(first, last)[at - first * BLOCK :][:n]


def unpack(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, sizes and ids of a segment."""
    s = Segment(payload)
    return s.doc_ids, s.sizes, s.decode(0, s.blocks)[: int(s.sizes.sum(dtype=np.int64))]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most _CHUNK bytes; a longer text is a range of its own."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        top = (ends[at - 1] if at else 0) + _CHUNK
        end = max(at + 1, int(np.searchsorted(ends, top, side="right")))
        yield at, end
        at = end


def _write(tokenizer_json: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_json)
        shard, segment, offset = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, ids = [], np.empty(0, np.int64), np.empty(0, np.uint32)

        def flush(docs: int) -> pa.RecordBatch:
            nonlocal segment, offset, doc_ids, sizes, ids
            n = int(sizes[:docs].sum())
            row = (shard, segment, offset, n, pack(doc_ids[:docs], sizes[:docs], ids[:n]))
            segment, offset, doc_ids, sizes, ids = segment + 1, offset + n, doc_ids[docs:], sizes[docs:], ids[n:]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [x.split()[0] for x in _FILE.split(", ")])

        for batch in batches:
            for i, j in _chunks(batch.column(1)):
                found, n = known.encode(batch.column(1).slice(i, j - i))
                ended = np.full(len(found) + len(n), end_id, np.uint32)
                own = np.ones(len(ended), bool)
                own[np.cumsum(n + 1) - 1] = False
                ended[own] = found
                doc_ids, sizes, ids = doc_ids + batch.column(0).slice(i, j - i).to_pylist(), np.concatenate([sizes, n + 1]), np.concatenate([ids, ended])
                while len(ids) > segment_ids and len(sizes) > 1:
                    yield flush(max(1, int(np.searchsorted(np.cumsum(sizes), segment_ids, side="right"))))
        if doc_ids:
            yield flush(len(doc_ids))

    return run


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) into token files under ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    if why := refusal(tokenizer_json):
        raise ValueError(f"{tokenizer_path} cannot be used: {why}")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_ROWS))
    hashed = F.xxhash64("text").alias("hash")
    ordered = docs.select("doc_id", "text", hashed).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.drop("hash").mapInArrow(_write(tokenizer_json, end_id, segment_ids), _FILE).write.parquet(path)


def _binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of 32-bit ids, up to each of ``ends``, as binary values."""
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, shard, segment, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            doc_ids, sizes, ids = unpack(payload.as_py())
            n = sizes.astype(np.int64)
            ends = np.cumsum(n)
            columns = [
                pa.array(doc_ids, pa.int64()), pa.array(first + ends - n), pa.array(n), pa.array([shard] * len(n), pa.int32()),
                pa.array([segment] * len(n), pa.int32()), pa.array(ends - n), _binaries(ids, ends),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _READ.split(", ")])


def files(spark, path: str) -> DataFrame:
    return spark.read.schema(_FILE).parquet(path)


def read(spark, path: str) -> DataFrame:
    """Token files as (doc_id, start, n_tokens, shard, segment, at, ids), ids in little-endian 32-bit.

    ``start`` counts from the first id of all, ``at`` from the first of the segment.
    """
    held = files(spark, path)
    # One row a shard: the number of shards is the number of writing tasks.
    sizes = sorted(held.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([s for s, _ in sizes], accumulate([0, *(n for _, n in sizes)])))
    starts = spark.createDataFrame(list(before.items()), "shard int, first long")
    placed = held.join(F.broadcast(starts), "shard").select((F.col("first") + F.col("offset")).alias("first"), "shard", "segment", "payload")
    return placed.mapInArrow(_read, _READ)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, asked in zip(batch.column(0), batch.column(1)):
            segment, rows = Segment(payload.as_py()), asked.as_py()
            raw = [segment.slice(r["at"], r["n"]).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], pa.int64()), pa.array(raw, pa.binary())], ["key", "ids"])


def fetch(spark, path: str, asked: DataFrame) -> DataFrame:
    """Ranges of ids, ``asked`` (key, shard, segment, at, n), as (key, ids).

    A segment is read once for all its ranges, and only their blocks are decoded.
    """
    wanted = asked.groupBy("shard", "segment").agg(F.collect_list(F.struct("key", "at", "n")).alias("asked"))
    return files(spark, path).join(wanted, ["shard", "segment"]).select("payload", "asked").mapInArrow(_fetch, "key long, ids binary")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    path = path or shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, end_id)
    return read(docs.sparkSession, path)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
