"""Operator 11: whitening of embeddings by the Gramian of exactly centred rows.

Entries become whole numbers, floor(256 c). The covariance is fitted on each distinct
vector once: the sums S and the count n of that list are exact, so a row is centred in
whole numbers as n x - S, and only then divided by n. Spark MLlib's RowMatrix sums the
outer products of the centred rows (computeGramianMatrix); divided by n that is the
covariance. The driver finds its eigenvectors, dims x dims numbers however many rows
there are, and the tasks project all rows on the leading ones.

The fit is checked on itself: a second Gramian, of the whitened fit list, is compared
with the identity.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are
left out; vectors of each length are whitened on their own; a component whose variance is
nothing (below 1e-12 of the whole, as of equal vectors) has no direction and is left out,
so fewer than ``components`` rows come back; repeated rows and vec_ids each keep their
rows; a null vec_id stays null; an empty table gives no rows. A sum of squares beyond 64
bits is null. Entries beyond 2^53 / 256 keep the nearest whole number that a double has,
within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SCALE, COMPONENTS = 256, 4
#: Variances below this share of the whole count as none.
_NONE = 1e-12


def scaled(vectors: DataFrame, name: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and the vector in whole numbers, of the rows that take part."""
    v = F.transform(name, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    # A double floors to a long by its limits; adding 0 turns a negative zero into zero.
    return rows.select("vec_id", F.transform("v", lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-(2**62))), F.lit(2**62)) + F.lit(0)).alias("x"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each place over a batch, in whole numbers of any size."""
    for batch in batches:
        if len(batch):
            rows = np.stack(batch.x.to_numpy())
            small = int(np.abs(rows).max()) <= 2**62 // len(rows)
            totals = rows.sum(axis=0) if small else rows.astype(object).sum(axis=0)
            yield pd.DataFrame({"at": np.arange(len(totals), dtype=np.int32), "total": [Decimal(int(t)) for t in totals]})


@dataclass(frozen=True)
class Whitening:
    """The fit of one length of vectors."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers."""
        top = self.n * int(np.abs(rows).max()) + max(map(abs, self.sums)) if len(rows) else 0
        if top >= 2**62:
            return rows.astype(object) * self.n - np.array(self.sums, object)
        return rows * self.n - np.array(self.sums, np.int64)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if not centred.size:
            return []
        if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 2**63:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(int(d) * int(d) for d in row) for row in centred.tolist()]
        return [d if d < 2**63 else None for d in exact]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def _gramian(rows: DataFrame) -> np.ndarray:
    """Sum of the outer products of ``rows`` (v array<double>), by Spark MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (x array<bigint>), all of one length; None without rows."""
    listed = materialize(rows.select("x").distinct(), "listed")
    totals = listed.mapInPandas(_sums, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()  # one row a dimension
    if not totals:
        return None
    n, sums = listed.count(), [int(r.total) for r in sorted(totals)]
    centring = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    covariance = _gramian(_mapped(listed, centring, lambda w, d: d.astype(float) / w.n)) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > _NONE * max(values.sum(), 0.0)]
    made = Whitening(n, sums, axes[:, order], values[order], float(np.trace(covariance)))
    if not order:
        return made
    own = _gramian(_mapped(listed, made, lambda w, d: w.project(d))) / n
    return Whitening(n, sums, made.axes, made.values, made.trace, float(np.abs(own - np.eye(len(order))).max()))


def _mapped(listed: DataFrame, fitted: Whitening, f) -> DataFrame:
    """Each vector of the list, centred and put through ``f``, as v array<double>."""
    held = listed.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": list(f(held.value, held.value.centred(np.stack(batch.x.to_numpy()))))})

    return listed.mapInPandas(run, "v array<double>")


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """``rows`` (vec_id, x) on the leading components, a row for each."""
    held = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = held.value
        k = len(w.values)
        for batch in batches:
            if len(batch) and k:
                centred = w.centred(np.stack(batch.x.to_numpy()))
                out = {"vec_id": batch.vec_id.astype("Int64").repeat(k).to_numpy(object), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))}
                out |= {"n": w.n, "deviation": pd.array([d for d in w.deviations(centred) for _ in range(k)], "Int64"), "whitened": w.project(centred).ravel()}
                out |= {"explained": np.tile(w.values / w.trace, len(batch)), "identity_error": w.error}
                made = pd.DataFrame(out)
                made["vec_id"] = pd.array([None if pd.isna(v) else int(v) for v in out["vec_id"]], "Int64")
                yield made

    return rows.select("vec_id", "x").mapInPandas(run, _OUT)


def whitened(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, name: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` (vec_id, embedding) as (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = scaled(vectors, name, scale)
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())  # one row a vector length
    made = []
    for length in lengths:
        own = rows.where(F.size("x") == length)
        if fitted := fit(own, components):
            made.append(whiten(own, fitted))
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], _OUT)
