"""Numeric functions as Column expressions, and the few that Spark lacks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_NAT = 1.0 / math.log(2.0)
#: Smallest positive normal double; takes the place of probabilities outside [0, 1].
TINY = 2.2250738585072014e-308


@lru_cache(maxsize=None)
def watterson(alleles: int) -> float:
    """Sum of 1/k for k below the number of alleles."""
    return sum(1.0 / k for k in range(1, alleles))


def log_near_one(v: Column) -> Column:
    """ln v, by log1p above one half."""
    return F.when(v > 0.5, F.log1p(v - 1.0)).otherwise(F.log(v))


def entropy_term(p: Column) -> Column:
    """-p ln p, and 0 where p is not within (0, 1)."""
    return F.when((p > 0) & (p < 1), -p * F.log(p)).otherwise(0.0)


def binary_entropy(p: Column) -> Column:
    """Entropy of a yes-no variable, in nats."""
    return entropy_term(p) + entropy_term(1.0 - p)


def to_bits(nats: Column) -> Column:
    return nats * BITS_PER_NAT


def ratio_to_fraction(r: Column) -> Column:
    return r / (1.0 + r)


def fraction_to_ratio(f: Column) -> Column:
    return f / (1.0 - f)


def clamp_probability(p: Column) -> Column:
    """p, or the smallest normal double where p lies outside [0, 1]."""
    return F.when((p < 0) | (p > 1), F.lit(TINY)).otherwise(p)


def bell(x: Column, sigma: Column) -> Column:
    """exp(-(x / sigma)^2)."""
    return F.exp(-F.pow(x / sigma, 2))


#: Terms of erfc's series below 3, and steps of its continued fraction above.
ERFC_TERMS, ERFC_STEPS = 80, 60


def erfc(x: Column) -> Column:
    """Complementary error function, to some 1e-15."""
    a = F.abs(x)
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(ERFC_TERMS), F.lit(1.0), lambda s, n: 1.0 + s * (2.0 * a * a) / (2 * n + 1))
    far = F.greatest(a, F.lit(3.0))
    fraction = F.aggregate(down(ERFC_STEPS), far, lambda s, n: far + n / 2.0 / s)
    bell = F.exp(-a * a) / math.sqrt(math.pi)
    right = F.when(a < 3.0, 1.0 - 2.0 * a * bell * series).otherwise(bell / fraction)
    return F.when(x < 0, 2.0 - right).otherwise(right)


def ordering_error(higher: Column, lower: Column, err_higher: Column, err_lower: Column) -> Column:
    """Chance that two estimates stand in the wrong order: erfc(difference / sigma) / 2."""
    return erfc(F.try_divide(higher - lower, F.sqrt(err_higher * err_higher + err_lower * err_lower))) / 2.0


def log_sum_exp(df: DataFrame, value: str, keys: list[str] = [], out: str = "lse") -> DataFrame:  # noqa: B006
    """ln of the sum of exp(value) by key, shifted by the key's maximum."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    both = df.crossJoin(F.broadcast(top)) if not keys else df.join(top, keys)
    summed = both.groupBy(*keys).agg(F.first("_top").alias("_top"), F.sum(F.exp(F.col(value) - F.col("_top"))).alias("_sum"))
    return summed.select(*keys, (F.col("_top") + F.log("_sum")).alias(out))


def log_normalise(df: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``value`` less the log-sum-exp of its key."""
    total = log_sum_exp(df, value, keys, "_lse")
    both = df.crossJoin(F.broadcast(total)) if not keys else df.join(total, keys)
    return both.withColumn(value, F.col(value) - F.col("_lse")).drop("_lse")


def central_difference(f, x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Numeric gradient of a scalar function."""
    return np.array([(f(x + d) - f(x - d)) / (2 * step) for d in np.eye(len(x)) * step])


def adjugate3(m: np.ndarray) -> np.ndarray:
    """Adjugate of a 3 x 3 matrix: its inverse times its determinant, singular or not."""
    return np.stack([np.cross(m[1], m[2]), np.cross(m[2], m[0]), np.cross(m[0], m[1])], axis=1)


def inverse3(m: np.ndarray) -> np.ndarray | None:
    """Inverse of a small matrix made symmetric, or None where it is singular."""
    s = (m + m.T) / 2
    try:
        return np.linalg.inv(s)
    except np.linalg.LinAlgError:
        return None
