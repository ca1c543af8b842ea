"""Operator 2: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with
its code point. The vector of a letter n-gram binds its letters' vectors, each
rotated by its place, by multiplication. A text bundles (adds) the vectors of its
n-grams, a language prototype bundles those of its training texts, and a text gets
the language of the nearest prototype by cosine. Prototypes are centred on their
mean first, since all languages share most of their bulk.

Bundling is linear, so a prototype is summed from n-gram counts, one partial
vector per task and language. Texts are read in slices of SLICE code points and n-grams
are summed BLOCK at a time, so memory does not grow with a text's length, the number of
texts or the size of the alphabet (but for 512 bytes a distinct letter).

Defined cases: a null text, one without letters, or no training rows at all give
``und`` with score 0; repeated rows stay; letters of any script have vectors; a text of any
length counts whole; other columns are ignored. Of equally near languages the first by name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the vectors, letters in an n-gram, and how sharply cosines become a score.
DIMENSIONS, ORDER, SHARPNESS = 512, 3, 12.0
#: Code points and texts that are read together, n-grams that are summed together, and
#: cells of the matrix of texts by n-grams up to which one is made.
SLICE, TEXTS, BLOCK, CELLS = 600_000, 2048, 8192, 1 << 23
#: Above this many possible n-grams, distinct ones are found by sorting.
DENSE_GRAMS = 4_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


class Profiles:
    """Letter vectors and n-gram sums of one process."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.is_letter = _letters()
        self.symbol = np.full(0x110000, -1, np.int32)
        self.known, self.vectors = 0, np.empty((64, dimensions), np.int8)
        self._learn(np.array([32]))

    def _learn(self, codes: np.ndarray) -> None:
        self.symbol[codes] = np.arange(self.known, self.known + len(codes))
        while self.known + len(codes) > len(self.vectors):
            self.vectors = np.resize(self.vectors, (2 * len(self.vectors), self.dimensions))
        for c in codes.tolist():
            self.vectors[self.known] = np.random.default_rng(c).integers(0, 2, self.dimensions) * 2 - 1
            self.known += 1

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        found = self.symbol[codes]
        if (found < 0).any():
            self._learn(np.unique(codes[found < 0]))
            found = self.symbol[codes]
        return found.astype(np.int64)

    def _bound(self, grams: np.ndarray, size: int) -> np.ndarray:
        """The vectors of n-grams, numbers in base ``size``: their letters', each rotated by its place, multiplied."""
        out, rest = None, grams
        for k in reversed(range(ORDER)):
            part = np.roll(self.vectors[rest % size], ORDER - 1 - k, axis=1)
            out, rest = part if out is None else out * part, rest // size
        return out

    def _add(self, total: np.ndarray, row: np.ndarray, symbols: np.ndarray, doc: np.ndarray | None = None) -> None:
        """Add the n-grams of ``symbols`` to the rows of ``total``; none spans two texts (``doc``)."""
        n = len(symbols) - ORDER + 1
        if n <= 0:
            return
        size, gram = self.known, np.zeros(n, np.int64)
        for k in range(ORDER):
            gram = gram * size + symbols[k : n + k]
        row = row[:n]
        if doc is not None:
            whole = doc[:n] == doc[ORDER - 1 :]
            gram, row = gram[whole], row[whole]
        if size**ORDER <= DENSE_GRAMS:
            found = np.flatnonzero(np.bincount(gram, minlength=1))
            number = np.empty(size**ORDER, np.int64)
            number[found] = np.arange(len(found))
            gram = number[gram]
        else:
            found, gram = np.unique(gram, return_inverse=True)
        if len(total) * len(found) <= CELLS:
            counts = np.bincount(row * len(found) + gram, minlength=len(total) * len(found)).reshape(len(total), -1).astype(np.float32)
            for i in range(0, len(found), BLOCK):
                total += counts[:, i : i + BLOCK] @ self._bound(found[i : i + BLOCK], size).astype(np.float32)
        else:
            order = np.argsort(row, kind="stable")
            row, gram = row[order], gram[order]
            for i in range(0, len(gram), BLOCK):
                r = row[i : i + BLOCK]
                starts = np.flatnonzero(np.diff(r, prepend=-1))
                total[r[starts]] += np.add.reduceat(self._bound(found[gram[i : i + BLOCK]], size), starts, axis=0, dtype=np.int32)

    def _long(self, total: np.ndarray, row: int, text: str) -> None:
        """A long text, slice by slice; the last symbols of a slice go before the next."""
        carry, after, at = np.array([32]), False, 0
        while at < len(text) or after:
            end = min(len(text), at + SLICE)
            while end < len(text) and end > at + SLICE // 2 and "Σ" in text[end - 1 : end + 1]:
                end -= 1  # its lower case depends on its neighbours
            codes = np.concatenate([_codes(text[at:end]), [32] if end == len(text) else []]).astype(np.int64)
            letter = self.is_letter[codes]
            keep = letter | np.concatenate([[after], letter[:-1]])
            found = np.concatenate([carry, np.where(letter, codes, 32)[keep]])
            self._add(total, np.full(len(found), row), self._symbols(found))
            carry, after, at = found[1 - ORDER :], bool(letter[-1]), end

    def bundle(self, texts: list[str], group: np.ndarray, groups: int) -> np.ndarray:
        """The sum of the texts' n-gram vectors, by group. A text begins and ends with a blank."""
        total = np.zeros((groups, self.dimensions))
        for i, j in _chunks(texts):
            if len(texts[i]) > SLICE:
                self._long(total, int(group[i]), texts[i])
                continue
            parts = [_codes(f" {t} ") for t in texts[i:j]]
            sizes = [len(p) for p in parts]
            codes, doc = np.concatenate(parts).astype(np.int64), np.repeat(np.arange(j - i), sizes)
            letter = self.is_letter[codes]
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            keep[np.cumsum(sizes) - sizes] = True
            doc = doc[keep]
            # Rows that take part are numbered, so that the sums have a text a row at most.
            rows, place = np.unique(group[i:j], return_inverse=True)
            part = np.zeros((len(rows), self.dimensions))
            self._add(part, place[doc], self._symbols(np.where(letter, codes, 32)[keep]), doc)
            total[rows] += part
        return total


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are read together; a long text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > SLICE or i - start >= TEXTS):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=2)
def _profiles(dimensions: int) -> Profiles:
    """The worker's letter vectors, which outlive a task."""
    return Profiles(dimensions)


def _partial(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = _profiles(dimensions), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            for name, row in zip(names, profiles.bundle(texts, np.array([number[x] for x in langs], np.int64), len(names))):
                sums[name] = sums.get(name, 0) + row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array([s.tolist() for s in sums.values()])], ["lang", "vector"])

    return run


def _predict(names: list[str], prototypes: np.ndarray, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = _profiles(dimensions)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, scores = [], []
            for i, j in _chunks(texts):
                vectors = profiles.bundle(texts[i:j], np.arange(j - i), j - i)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ prototypes.T) / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(axis=1) if len(names) else np.zeros(j - i, int)
                for k, b in enumerate(best):
                    if not len(names) or not norms[k]:
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        langs.append(names[b])
                        scores.append(float(1 / np.exp(SHARPNESS * (cosines[k].astype(np.float64) - cosines[k, b])).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Centred unit prototypes from ``training`` (lang, text), languages by name.

    What reaches the driver is one vector per language.
    """
    rows = (
        training.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("lang", "text")
        .mapInArrow(_partial(dimensions), "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("place", "x"))
        .groupBy("lang", "place")
        .agg(F.sum(F.round("x")).alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
        .collect()
    )
    rows.sort(key=lambda r: r.lang)
    made = np.array([[p.x for p in r.v] for r in rows]).reshape(len(rows), dimensions)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    made = unit(made)
    if len(made) > 1:
        made = unit(made - made.mean(axis=0))
    return [r.lang for r in rows], made.astype(np.float32)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, training: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` (doc_id, held_out, text) with lang_pred and score."""
    names, made = prototypes(training, dimensions)
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _predict(names, made, dimensions), "doc_id long, held_out boolean, lang_pred string, score double"
    )
