"""Operator 4: quality rules by tokeniser fertility.

A public sentencepiece vocabulary gives each text its characters per token, its
share of byte-fallback tokens and the entropy of its tokens (held against the most
that its length allows). For every language (or script, where the language is null)
the quartiles of each measure over all its documents set a band: the quartiles and
REACH times their distance on both sides, never narrower than FLOORS; entropy has no
upper limit. A short text's measures scatter more, so its distance from the median
counts by the square root of its share of FULL tokens. A document outside a band is
rejected. Base rules on words, symbols and repeats come first.

Words are encoded one by one, so the tokens of blanks and line ends between them do not
count; only the words' own do.

Defined cases: a null or empty text has no words and fails the base rules; repeated
rows stay; a document that fails the base rules neither shapes nor meets the bands;
languages of any number are grouped, none is special; a language of one document is its
own band, so nothing speaks against it; a text without letters has the script ``none``;
empty input gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_sums

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

#: How many quartile distances a band reaches beyond the quartiles.
REACH = 2.5
#: Bands are at least this wide on each side of the median: characters a token, byte share, entropy in bits.
FLOORS = {"chars_per_token": 0.1, "byte_share": 0.02, "token_entropy": 0.3}
#: Tokens from which a text's measures count in full.
FULL = 500
#: Keys over which the documents of one language are dealt when they meet its band.
SALTS = 256
_MEMO = 400_000

_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, grp string, n_pieces long, chars_per_token double, byte_share double, token_entropy double"
)


def repeat_words(ids: np.ndarray) -> int:
    """Words in windows of five that the text has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(WINDOW)):  # two windows share a hash
        _, key = np.unique(np.stack([ids[k : k + n] for k in range(WINDOW)]), axis=1, return_inverse=True)
        order = np.argsort(key.reshape(-1), kind="stable")
        same = key.reshape(-1)[order][1:] == key.reshape(-1)[order][:-1]
        a, b = order[1:][same], order[:-1][same]
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[a + k] = covered[b + k] = True
    return int(covered.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=100_000)
def _script(c: str) -> str | None:
    return unicodedata.name(c, "UNKNOWN").split()[0].lower() if c.isalpha() else None


def script_of(text: str) -> str:
    """The script of most letters of a text, by the letters' Unicode names; ties go by name."""
    counts = Counter()
    for c, n in Counter(text).items():
        if script := _script(c):
            counts[script] += n
    return min(counts, key=lambda s: (-counts[s], s), default="none")


class _Pieces(dict):
    """A word's piece ids as bytes, unsigned 16-bit."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = made = np.array(self.sp.encode(word.decode()), "<u2").tobytes()
        return made


def measure(text: str | None, pieces: _Pieces) -> tuple:
    text = text or ""
    words = text.encode().split()
    at: dict[bytes, int] = {}
    ids = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
    n, chars = len(words), len(text) - sum(map(text.count, WHITE))
    repeated = repeat_words(ids)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    tokens = np.frombuffer(b"".join(map(pieces.__getitem__, words)), "<u2")
    _, counts = np.unique(tokens, return_counts=True)
    m = len(tokens)
    entropy = float(np.log2(m) - (counts * np.log2(counts)).sum() / m) if m else None
    return n, chars, sum(map(text.count, SYMBOLS)), dup_lines(text), repeated, failed, m, chars / m if m else None, float(pieces.bytes[tokens].mean()) if m else None, entropy


def _measure(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(model)
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                base = measure(text, pieces)
                out.append((doc_id, *base[:6], lang if lang is not None else script_of(text or ""), *base[6:]))
            if out:
                types = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.int64(), *[pa.float64()] * 3]
                names = [x.split()[0] for x in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def fertility(docs: DataFrame, model_path: str) -> DataFrame:
    """Base measures and the three fertility measures of ``docs`` (doc_id, lang, text)."""
    with open(model_path, "rb") as f:
        model = f.read()
    return docs.select("doc_id", "lang", "text").mapInArrow(_measure(model), _SCHEMA)


def quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact quartiles of ``value`` by ``group``: (group, value_q1, value_q2, value_q3).

    A quartile is the least value with a quarter, half or three quarters of the group's
    rows up to it. Equal values are one row with their count, and the counts are summed in
    order over ranges, so that no task holds a group and every run gives the same.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    summed = materialize(running_sums(counts, [group, value], before=F.col("n")), "ranks")
    whole = summed.groupBy(group).agg(F.sum("n").alias("total"), F.min("before").alias("first"))
    upto = F.col("before") - F.col("first") + F.col("n")
    placed = summed.join(whole, group)
    return placed.groupBy(group).agg(*[F.min(F.when(4 * upto >= k * F.col("total"), F.col(value))).alias(f"{value}_q{k}") for k in (1, 2, 3)])


def _band(x: str) -> list[Column]:
    low, mid, high = (F.col(f"{x}_q{k}") for k in (1, 2, 3))
    top = F.lit(float("inf")) if x == "token_entropy" else F.greatest(high + REACH * (high - low), mid + FLOORS[x])
    return [mid.alias(f"{x}_mid"), F.least(low - REACH * (high - low), mid - FLOORS[x]).alias(f"{x}_low"), top.alias(f"{x}_high")]


def judge(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` (doc_id, lang, text) with measures, base_failed and kept."""
    measured = materialize(fertility(docs, model_path), "fertility")
    most = F.log2(F.least(F.col("n_pieces"), F.lit(FULL)).cast("double"))
    scaled = measured.withColumn("token_entropy", F.col("token_entropy") - most)
    good = scaled.where("NOT base_failed")
    found = reduce(lambda l, r: l.join(r, "grp", "full"), [quartiles(good, "grp", x) for x in FLOORS])
    bands = materialize(found.select("grp", *[b for x in FLOORS for b in _band(x)]), "bands")
    # One language can hold most documents: its band is copied to SALTS keys, and they are dealt over these.
    salted = bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = scaled.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_pieces"), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"], "left")
    part = F.sqrt(F.least(F.col("n_pieces"), F.lit(FULL)) / float(FULL))
    held = [(F.col(f"{x}_mid") + (F.col(x) - F.col(f"{x}_mid")) * part).between(F.col(f"{x}_low"), F.col(f"{x}_high")) for x in FLOORS]
    kept = ~F.col("base_failed") & F.coalesce(held[0] & held[1] & held[2], F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "chars_per_token", "byte_share", (F.col("token_entropy") + most).alias("token_entropy"),
    )
