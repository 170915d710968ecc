"""Run statistics: count, sum, extremes and the first four moments, as mergeable states.

A state is a struct (n, mean, m2, m3, m4, lo, hi) with central power sums. ``collect``
builds one per group with built-in aggregates, ``merge`` combines stored states and
``report`` turns a state into the eight published figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("count", "accumulate", "minimum", "maximum", "mean", "stddev", "skewness", "kurtosis")
#: Below this second moment skewness and kurtosis are 0.
FLAT = 1e-7


def aggregates(x: str | Column, prefix: str = "") -> list[Column]:
    """The eight figures as aggregate expressions; a group of one has deviation 0."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    m2 = F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)
    shape = lambda f: F.when(F.abs(m2) < FLAT, F.lit(0.0)).otherwise(F.coalesce(f(x), F.lit(0.0)))
    values = (F.count(x), F.sum(x), F.min(x), F.max(x), F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0)), shape(F.skewness), shape(F.kurtosis))
    return [v.alias(prefix + n) for n, v in zip(FIELDS, values, strict=True)]


def collect(df: DataFrame, keys: list[str], x: str, name: str = "state") -> DataFrame:
    """One state per group, from built-in partial aggregates."""
    c = F.col(x).cast("double")
    n, var = F.count(c), F.coalesce(F.var_pop(c), F.lit(0.0))
    m3 = F.coalesce(F.skewness(c), F.lit(0.0)) * F.pow(var, F.lit(1.5)) * n
    m4 = (F.coalesce(F.kurtosis(c), F.lit(-3.0)) + 3) * var * var * n
    state = F.struct(n.alias("n"), F.avg(c).alias("mean"), (var * n).alias("m2"), m3.alias("m3"), m4.alias("m4"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return df.where(c.isNotNull()).groupBy(*keys).agg(state.alias(name))


def merge(states: DataFrame, keys: list[str], name: str = "state") -> DataFrame:
    """Combines the states of each group: moments are moved to the common mean, then added."""
    s = states.select(*keys, f"{name}.*")
    n = F.sum("n")
    raw = s.groupBy(*keys).agg(n.alias("__n"), (F.sum(F.col("n") * F.col("mean")) / n).alias("__mean"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = s.alias("s").join(raw.alias("r"), on, "inner") if keys else s.alias("s").crossJoin(F.broadcast(raw).alias("r"))
    d = F.col("mean") - F.col("__mean")
    both = both.select(
        *[F.col(f"s.{k}").alias(k) for k in keys], "__n", "__mean", "__lo", "__hi",
        (F.col("m2") + F.col("n") * d * d).alias("m2"),
        (F.col("m3") + 3 * d * F.col("m2") + F.col("n") * d * d * d).alias("m3"),
        (F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + F.col("n") * d * d * d * d).alias("m4"),
    )
    state = F.struct(F.first("__n").alias("n"), F.first("__mean").alias("mean"), F.sum("m2").alias("m2"), F.sum("m3").alias("m3"), F.sum("m4").alias("m4"), F.first("__lo").alias("lo"), F.first("__hi").alias("hi"))
    return both.groupBy(*keys).agg(state.alias(name))


def report(state: str = "state", ddof: int = 1) -> list[Column]:
    """The eight figures of a stored state."""
    f = lambda n: F.col(f"{state}.{n}")
    flat = F.abs(f("m2")) < FLAT
    values = (
        f("n"), f("n") * f("mean"), f("lo"), f("hi"), f("mean"),
        F.when(f("n") > ddof, F.sqrt(F.abs(f("m2") / F.nullif(f("n") - ddof, F.lit(0))))).otherwise(0.0),
        F.when(flat, 0.0).otherwise(F.sqrt(f("n")) * f("m3") / F.pow(f("m2"), F.lit(1.5))),
        F.when(flat, 0.0).otherwise(f("n") * f("m4") / (f("m2") * f("m2")) - 3),
    )
    return [v.alias(n) for n, v in zip(FIELDS, values, strict=True)]


def static_mean(x: str, ddof: float = 0) -> Column:
    """The sum over the count less ``ddof``; 0 without values."""
    return F.coalesce(F.sum(x) / F.nullif(F.count(x) - F.lit(float(ddof)), F.lit(0.0)), F.lit(0.0))


def static_std(df: DataFrame, keys: list[str], x: str, ddof: float = 0) -> DataFrame:
    """keys, mean, std: deviations from :func:`static_mean`, over the same denominator; 0 where that isn't positive.

    Sums around the true mean c give those around m: sum (x - m)**2 = sum (x - c)**2 + n (c - m)**2.
    """
    d, m = F.col("n") - F.lit(float(ddof)), F.col("mean")
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("__c"), F.var_pop(x).alias("__v"), static_mean(x, ddof).alias("mean"))
    square = F.col("n") * (F.col("__v") + (F.col("__c") - m) * (F.col("__c") - m))
    return out.select(*keys, "mean", F.when((F.col("n") > 0) & (d > 0), F.sqrt(F.abs(square / d))).otherwise(0.0).alias("std"))


#: Relative tolerances of :func:`alike`, for extremes and sums, and for shape.
CLOSE, SHAPE_CLOSE = 1e-6, 1e-3


def alike(a: str, b: str, tolerance: float | None = CLOSE) -> Column:
    """Whether two structs of figures are equal: exactly without a tolerance, else relative to the greater, skewness and kurtosis more loosely."""
    out = F.col(f"{a}.count") == F.col(f"{b}.count")
    for n in FIELDS[1:]:
        x, y = F.col(f"{a}.{n}"), F.col(f"{b}.{n}")
        near = tolerance if tolerance is None or n not in ("skewness", "kurtosis") else max(tolerance, SHAPE_CLOSE)
        out &= x.eqNullSafe(y) if near is None else x.eqNullSafe(y) | (F.abs(x - y) <= near * F.greatest(F.abs(x), F.abs(y)))
    return out
