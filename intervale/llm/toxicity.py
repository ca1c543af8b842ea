"""Operator 8: toxicity by maximum-scoring segments.

Training counts, per word, how many toxic and clean labelled texts have it. A word's
score is its log odds under a Dirichlet prior whose mean is the share of its
five-letter prefix, which in turn leans on the four- and three-letter prefixes and
the base rate; so a rare or new word borrows from words that begin alike. A drift is
subtracted, which makes ordinary text score below zero. A linear-time scan finds
every maximal-scoring segment of a text. Segment scores are calibrated by the
extreme-value law: on clean training texts the best segment of n words is Gumbel
with location a + b ln n, and a segment's evidence is how far it lies above that
location, in scales. The sum of the segments' evidence over SIGNIFICANT becomes a
probability by a logistic curve fitted on the training texts.

The model is fitted on at most ``max_per_class`` labelled rows of each label, the least
by hash of doc_id, which bounds what reaches the driver and the tasks: of all words and
prefixes of these texts those that tell the labels apart, and two numbers a text. Words
are counted in three of four texts, and the law and the curve are fitted on the fourth,
whose words the scores do not know; sets with fewer than FEW texts of a label on either
side are used whole for both. Scoring reads whole texts. ``passages`` returns the toxic
passages themselves.

Defined cases: a null or empty text has no segment and gets the score of no evidence;
repeated rows keep a row each; without toxic or without clean training rows every
score is the base rate (0 without any rows); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows of each label that bound the model.
MAX_PER_CLASS = 20_000
#: One of PARTS texts calibrates, if it and the others have FEW texts of each label.
PARTS, FEW = 4, 50
#: Weight of a parent in a child's prior, in texts; drift; limit of a word's score.
PRIOR_TEXTS, DRIFT, LIMIT = 4.0, 1.0, 9.0
PREFIXES = (5, 4, 3)
#: Scales above the expected best segment of clean text from which a segment counts.
SIGNIFICANT = 2.0
THRESHOLD = 0.7
_MEMO = 1_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    base: float = 0.0
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    location: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)


class Scores(dict):
    """A word's score less the drift, looked up once."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _MEMO:
            self.clear()
        found = self.model.words.get(word)
        for k in PREFIXES:
            if found is None and len(word) >= k:
                found = self.model.prefixes.get(word[:k])
        self[word] = made = (found or 0.0) - DRIFT
        return made


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment as (start, end, score), in linear time.

    Candidates are kept with the running sums at their ends; a new positive score
    extends the last candidate that starts lower, if its own end is not higher.
    """
    up = np.flatnonzero(scores > 0)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    below: list[int] = []  # for each candidate, the nearest earlier one with a lower sum before, or -1
    for i in up.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = below[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                below.append(j)
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:], below[j:]
    return [(s, e, float(r - lo)) for s, e, lo, r in kept]


def segments(text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and the maximal segments (word places and score)."""
    words = words_of(text)
    return len(words), maximal_segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)))


def significance(n: int, found: list[tuple[int, int, float]], model: Model) -> list[float]:
    """Segments' heights above the clean law's location, in scales, over SIGNIFICANT."""
    place = model.location[0] + model.location[1] * np.log(max(n, 1))
    return [(s - place) / model.scale - SIGNIFICANT for _, _, s in found]


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """The sum over the segments that count."""
    return float(sum(max(0.0, x) for x in significance(n, found, model)))


def probability(x: float, model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * np.log1p(x), -40, 40))))


def _share(counts: tuple[float, float], parent: float) -> float:
    return (counts[0] + PRIOR_TEXTS * parent) / (sum(counts) + PRIOR_TEXTS)


def _odds(share: float, base: float) -> float:
    return float(np.clip(np.log(share / (1 - share)) - np.log(base / (1 - base)), -LIMIT, LIMIT))


def log_odds(word_counts: dict[str, tuple[int, int]], prefix_counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> Model:
    """Scores of words and prefixes from their counts in toxic and clean texts."""
    base = toxic / (toxic + clean)
    shares: dict[str, float] = {}
    for k in reversed(PREFIXES):
        for p, c in prefix_counts.items():
            if len(p) == k:
                parent = next((shares[p[:m]] for m in PREFIXES if m < k and p[:m] in shares), base)
                shares[p] = _share(c, parent)
    words = {}
    for w, c in word_counts.items():
        parent = next((shares[w[:m]] for m in PREFIXES if w[:m] in shares), base)
        words[w] = _odds(_share(c, parent), base)
    return Model(base, words, {p: _odds(s, base) for p, s in shares.items()})


def _gumbel(n: np.ndarray, best: np.ndarray) -> tuple[tuple[float, float], float]:
    """Location a + b ln n (b not negative) and scale, by least squares and moments."""
    x = np.log(np.maximum(n, 1))
    spread = x.var()
    slope = max(0.0, float(np.cov(x, best, bias=True)[0, 1] / spread)) if spread > 0 else 0.0
    rest = best - slope * x
    scale = max(0.25, float(rest.std() * np.sqrt(6) / np.pi))
    return (float(rest.mean() - 0.5772156649 * scale), slope), scale


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.array([1e-6, 1e-2])
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), design.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _best_segments(model):
    """Words and the best segment of each text, with its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.value)
        for batch in batches:
            found = [segments(t.as_py(), scores) for t in batch.column(0)]
            columns = [pa.array([float(n) for n, _ in found]), pa.array([max((s for _, _, s in f), default=0.0) for _, f in found]), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["n", "best", "toxic"])

    return run


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.value)
        for batch in batches:
            columns = [pa.array([evidence(*segments(t.as_py(), scores), model.value) for t in batch.column(0)], pa.float64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["x", "toxic"])

    return run


def calibrate(model: Model, texts: DataFrame) -> Model:
    """Fit the extreme-value law on clean ``texts`` (text, toxic), and the curve on all; two numbers a text reach the driver."""
    context = texts.sparkSession.sparkContext
    rows = texts.mapInArrow(_best_segments(context.broadcast(model)), "n double, best double, toxic int").where("toxic = 0").toArrow().to_pandas()
    model.location, model.scale = _gumbel(rows.n.to_numpy(), rows.best.to_numpy())
    rows = texts.mapInArrow(_evidence(context.broadcast(model)), "x double, toxic int").toArrow().to_pandas()
    model.curve = _logistic(np.log1p(rows.x.to_numpy()), rows.toxic.to_numpy(float))
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each word and prefix, per task, by label."""
    counts: dict[tuple[str, int], Counter] = {}

    def flush():
        for (kind, label), c in counts.items():
            keys = list(c)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                columns = [pa.array([kind] * len(part)), pa.array(part), pa.array([label] * len(part), pa.int32()), pa.array([c[k] for k in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "token", "toxic", "n"])
        counts.clear()

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            found = set(words_of(text.as_py()))
            counts.setdefault(("w", label), Counter()).update(found)
            counts.setdefault(("p", label), Counter()).update({w[:k] for k in PREFIXES for w in found if len(w) >= k})
        if sum(map(len, counts.values())) > 500_000:
            yield from flush()
    yield from flush()


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    rows = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    own = (F.pmod(F.xxhash64("text", F.lit(PARTS)), F.lit(PARTS)) == 0).alias("own")
    training = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", own), "toxic")
    sizes = {(r.toxic, r.own): r["count"] for r in training.groupBy("toxic", "own").count().collect()}
    toxic, clean = (sizes.get((x, True), 0) + sizes.get((x, False), 0) for x in (1, 0))
    if not toxic or not clean:
        base = 0.0 if not toxic else 1.0
        return Model(base, curve=(-40.0 if not toxic else 40.0, 0.0))
    counted, fitted = training, training
    if min(sizes.get((x, y), 0) for x in (0, 1) for y in (True, False)) >= FEW:
        counted, fitted = training.where("NOT own"), training.where("own")
        toxic, clean = sizes[1, False], sizes[0, False]
    counts = counted.select("text", "toxic").mapInArrow(_count, "kind string, token string, toxic int, n long").groupBy("kind", "token")
    counts = counts.agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("c"))
    # Tokens that tell the labels apart; the others get their prefix's score or none.
    rate = toxic / (toxic + clean)
    z = F.abs(F.col("t") - rate * (F.col("t") + F.col("c"))) / F.sqrt((F.col("t") + F.col("c")) * rate * (1 - rate))
    told = counts.where("t + c >= 2").where(z > 1.5).toArrow().to_pandas()
    part = {k: told[told.kind == k] for k in "wp"}
    model = log_odds(*({w: (t, c) for w, t, c in zip(p.token, p.t.tolist(), p.c.tolist())} for p in (part["w"], part["p"])), toxic, clean)
    return calibrate(model, fitted.select("text", "toxic"))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scores = Scores(m)
        for batch in batches:
            out = [probability(evidence(*segments(t.as_py(), scores), m), m) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, held_out, score, predicted)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_score(held), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score at or over the threshold; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scores = Scores(m)
        for batch in batches:
            clean = [probability(evidence(*segments(t.as_py(), scores), m), m) < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_PASSAGES = "doc_id long, start long, end long, score double, evidence double, passage string"


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage of ``docs`` (doc_id, text): doc_id, start, end, score, evidence, passage.

    Places are in code points of the lower-cased text. A text's score is the curve at
    the sum of its passages' evidence.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scores = Scores(m)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = segments(text.as_py(), scores)
                heights = significance(n, found, m)
                if any(x > 0 for x in heights):
                    low = text.as_py().lower()
                    places = [w.span() for w in _WORD.finditer(low)]
                    for (i, j, s), x in zip(found, heights):
                        if x > 0:
                            start, end = places[i][0], places[j - 1][1]
                            out.append((doc_id, start, end, s, x, low[start:end]))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _PASSAGES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _PASSAGES)
