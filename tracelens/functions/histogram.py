"""Histograms with (lower, upper] bins: creation in SQL expressions, algebra on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of what lies outside.
LEFT, RIGHT = -1, -2
#: Merges that would need more bins use the wider input's width instead.
MAX_BINS = 50_000
#: The first edge lies this share of a bin below the least value.
SHIFT = 1e-6


def width_fixed(width: float):
    return lambda data, weights=None: width


def width_scott(data, weights=None) -> float:
    """3.5 standard deviations over the cube root of the count."""
    data = np.asarray(data, float)
    w = np.ones(len(data)) if weights is None else np.asarray(weights, float)
    n = w.sum()
    mean = (w * data).sum() / n
    return float(3.5 * np.sqrt(max(0.0, (w * (data - mean) ** 2).sum() / n)) / np.cbrt(n))


def width_count(bins: int):
    return lambda data, weights=None: float(np.max(data) - np.min(data)) / (bins - 1e-6 - 0.001)


def width_capped(rule, bins: int):
    """``rule``, or the width that gives ``bins`` bins where it gives none or too many."""

    def width(data, weights=None):
        w, span = rule(data, weights), float(np.max(data) - np.min(data))
        return w if w > 0 and span / w <= bins else width_count(bins)(data, weights)

    return width


@dataclass
class Histogram:
    counts: np.ndarray
    start: float
    width: float
    lo: float
    hi: float

    @classmethod
    def of(cls, data, rule, weights=None) -> Histogram:
        data = np.asarray(data, float)
        weights = np.ones(len(data), np.int64) if weights is None else np.asarray(weights, np.int64)
        lo, hi = float(data.min()), float(data.max())
        if lo == hi:
            w = 1e-12 * abs(lo) if lo else 1e-12
            return cls(np.array([weights.sum()]), lo - w, w, lo, hi)
        w = rule(data, weights)
        start = lo - SHIFT * w
        bins = max(1, int(np.ceil((hi - start) / w)))
        w = (hi - start) / bins
        at = np.clip(np.searchsorted(start + w * np.arange(1, bins), data, "left"), 0, bins - 1)
        return cls(np.bincount(at, weights, bins).astype(np.int64), start, w, lo, hi)

    @classmethod
    def edges(cls, counts, start: float, width: float, lo: float, hi: float) -> Histogram:
        """From given parts; they must agree with each other."""
        counts = np.asarray(counts, np.int64)
        if not start < lo <= hi or abs(start + len(counts) * width - hi) > 1e-6 * width or lo > start + width * (1 + 1e-9):
            raise ValueError("the edges don't agree with the extremes")
        return cls(counts, start, width, lo, hi)

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def lower(self, i):
        return self.start + np.asarray(i) * self.width

    def upper(self, i):
        i = np.asarray(i)
        return np.where(i == len(self.counts) - 1, self.hi, self.start + (i + 1) * self.width)

    def middles(self) -> np.ndarray:
        return self.start + (np.arange(len(self.counts)) + 0.5) * self.width

    def bin(self, v: float, tolerance: float = 0.05) -> int:
        """The bin of v; values just outside the ends count as in the end bins."""
        if v <= self.start:
            return 0 if v > self.start - tolerance * self.width else LEFT
        if v > self.hi:
            return len(self.counts) - 1 if v <= self.hi + tolerance * self.width else RIGHT
        at = int(np.ceil((v - self.start) / self.width)) - 1
        if v <= self.start + at * self.width:
            at -= 1
        return min(max(at, 0), len(self.counts) - 1)

    def unpack(self) -> np.ndarray:
        return np.repeat(self.middles(), self.counts)

    def uniform_count(self, low: float, high: float) -> float:
        """Count in (low, high] if values are spread evenly in their bins."""
        if self.lo == self.hi:
            return float(self.total) if low < self.hi <= high else 0.0
        edge = self.all_edges()
        share = np.clip(np.minimum(high, edge[1:]) - np.maximum(low, edge[:-1]), 0, None) / (edge[1:] - edge[:-1])
        return float((share * self.counts).sum())

    def cdf(self, v: float) -> float:
        return self.uniform_count(-np.inf, v) / self.total

    def negated(self) -> Histogram:
        return Histogram(self.counts[::-1].copy(), -self.hi - SHIFT * self.width, self.width, -self.hi, -self.lo)

    def skewness(self) -> float:
        n, x = self.total, self.middles()
        mean = (self.counts * x).sum() / n
        var = (self.counts * (x - mean) ** 2).sum() / n
        return 0.0 if n < 2 or var <= 0 else float((self.counts * (x - mean) ** 3).sum() / (n - 1) / var**1.5)

    def all_edges(self) -> np.ndarray:
        return np.append(self.lower(np.arange(len(self.counts))), self.hi)

    def rebinned(self, start: float, width: float, bins: int) -> np.ndarray:
        """Whole counts on another grid that covers this one; a bin that an edge divides is split by :func:`shared_out`."""
        edge = start + width * np.arange(bins + 1)
        if self.lo == self.hi:  # all data are one value, whatever the bin's edges
            at = min(max(int(np.searchsorted(edge, self.hi, "left")) - 1, 0), bins - 1)
            return np.bincount([at], [self.total], bins).astype(np.int64)
        own = self.all_edges()
        return shared_out(own[:-1], own[1:], self.counts, edge)

    def merged(self, other: Histogram, rule) -> Histogram:
        """Both on one grid over both ranges; the rule sees the middles with their counts."""
        lo, hi = min(self.lo, other.lo), max(self.hi, other.hi)
        if lo == hi:
            return Histogram(np.array([self.total + other.total]), self.start, self.width, lo, hi)
        x = np.concatenate([self.middles(), other.middles(), [lo, hi]])
        w = rule(x, np.concatenate([self.counts, other.counts, [0, 0]]))
        if not w > 0 or (hi - lo) / w > MAX_BINS:
            w = max(min(h.width for h in (self, other)), (hi - lo) / MAX_BINS * (1 + 1e-9))
            if (hi - lo) / w > MAX_BINS - 1:
                w = (hi - lo) / (MAX_BINS - 1)
        start = min(lo - SHIFT * w, np.nextafter(lo, -np.inf))
        bins = max(1, int(np.ceil((hi - start) / w)))
        w = (hi - start) / bins
        return Histogram(self.rebinned(start, w, bins) + other.rebinned(start, w, bins), start, w, lo, hi)

    def with_data(self, data, rule) -> Histogram:
        """Histogram and raw values: the bins' middles stand for what they hold."""
        x = np.concatenate([self.middles(), np.asarray(data, float)])
        keep = np.concatenate([self.counts, np.ones(len(data), np.int64)])
        return Histogram.of(x[keep > 0], rule, keep[keep > 0])

    def extracted(self, low: float, high: float) -> tuple[int, VariableHistogram]:
        """The whole count in (low, high], and the histogram without it."""
        rest = VariableHistogram.of(self)
        return int(rest.extract([(low, high)])[0]), rest

    def to_json(self) -> dict:
        """The keys are fixed values of the stored format."""
        return {"Bin Counts": self.counts.tolist(), "First edge": self.start, "Bin width": self.width, "Min": self.lo, "Max": self.hi}

    @classmethod
    def from_json(cls, d: dict) -> Histogram:
        return cls(np.array(d["Bin Counts"], np.int64), d["First edge"], d["Bin width"], d["Min"], d["Max"])


def shared_out(low: np.ndarray, high: np.ndarray, counts: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whole counts of bins (low, high] on the bins between ``edge``.

    Where an edge divides a bin, both sides get their share of its count rounded half up; what that leaves
    over or takes too much goes to the larger side, the left one of equal sides. All bins take their next edge at once.
    """
    low, high, left = (np.array(x, float) for x in (low, high, counts))
    bins = len(edge) - 1
    out = np.zeros(bins, np.int64)
    at = np.clip(np.searchsorted(edge, low, "right") - 1, 0, bins - 1)
    while len(at):
        to = edge[at + 1]
        inside = (to < high) & (at < bins - 1)
        np.add.at(out, at[~inside], left[~inside].astype(np.int64))
        low, high, left, at, to = (x[inside] for x in (low, high, left, at, to))
        share = np.where(to > low, (to - low) / (high - low), 0.0)
        own, rest = np.floor(share * left + 0.5), np.floor((1.0 - share) * left + 0.5)
        debt = left - own - rest
        larger = (1.0 - share) > share
        own, rest = own + np.where(larger, 0, debt), rest + np.where(larger, debt, 0)
        np.add.at(out, at, own.astype(np.int64))
        low, left, at = to, rest, at + 1
    return out


@dataclass
class VariableHistogram:
    """Bins of any widths: ``edge`` has one more entry than ``counts``."""

    edge: np.ndarray
    counts: np.ndarray
    lo: float
    hi: float

    @classmethod
    def of(cls, h: Histogram) -> VariableHistogram:
        return cls(h.all_edges(), h.counts.astype(np.int64).copy(), h.lo, h.hi)

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def bin(self, v: float) -> int:
        """The bin (lower, upper] of v, LEFT or RIGHT."""
        if v <= self.edge[0]:
            return LEFT
        return RIGHT if v > self.edge[-1] else int(np.searchsorted(self.edge, v, "left")) - 1

    def split(self, at: float) -> int:
        """Makes ``at`` an edge; the bin to its left."""
        k = self.bin(at)
        if k < 0:
            raise ValueError(f"{at} isn't inside a bin")
        if at != self.edge[k + 1]:
            both = shared_out(self.edge[k : k + 1], self.edge[k + 1 : k + 2], self.counts[k : k + 1], np.array([self.edge[k], at, self.edge[k + 1]]))
            self.edge = np.insert(self.edge, k + 1, at)
            self.counts = np.concatenate([self.counts[:k], both, self.counts[k + 1 :]])
        return k

    def extract(self, ranges: list[tuple[float, float]]) -> np.ndarray:
        """Takes the counts out of ordered ranges (low, high]."""
        out = np.zeros(len(ranges), np.int64)
        before = -np.inf
        for i, (low, high) in enumerate(ranges):
            if high <= low or low < before:
                raise ValueError("ranges must be ordered and not empty")
            before = high
            if self.lo == self.hi:
                if low < self.hi <= high:
                    out[i], self.counts = self.total, np.zeros_like(self.counts)
                continue
            if low >= self.edge[-1] or high <= self.edge[0]:
                continue
            first = self.split(low) + 1 if low > self.edge[0] else 0
            last = self.split(high) if high <= self.edge[-1] else len(self.counts) - 1
            out[i] = self.counts[first : last + 1].sum()
            self.counts[first : last + 1] = 0
        return out

    def rebinned(self, edge) -> np.ndarray:
        return shared_out(self.edge[:-1], self.edge[1:], self.counts, np.asarray(edge, float))


def difference(a: Histogram, b: Histogram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin edges, a - b, and that over the mean count of both, on the grid of the least low, greatest high and least width."""
    w, lo, hi = min(a.width, b.width), min(a.start, b.start), max(a.hi, b.hi)
    bins = max(1, int(np.ceil((hi - lo) / w)))
    w = (hi - lo) / bins
    x, y = a.rebinned(lo, w, bins), b.rebinned(lo, w, bins)
    mean = (x + y) / 2
    return lo + w * np.arange(bins + 1), x - y, np.divide(x - y, mean, out=np.zeros(bins), where=mean > 0)


def scott_rule(x):
    """Scott's width as an aggregate expression."""
    return 3.5 * F.stddev_pop(x) / F.cbrt(F.count(x))


def grids(df: DataFrame, keys: list[str], x: str, bins: int = 200, scott: bool = False) -> DataFrame:
    """The grid of each group: keys, lo, hi, nbin, start, width; with ``scott`` bins by Scott's rule, if it gives a width and not over MAX_BINS bins."""
    c = F.col(x).cast("double")
    span = df.where(c.isNotNull()).groupBy(*keys).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), scott_rule(c).alias("__rule"))
    width = F.col("hi") - F.col("lo")
    raw = width / F.lit((MAX_BINS if scott else bins) - 1e-6 - 0.001)
    if scott:
        rule = F.col("__rule")
        raw = F.when((rule > 0) & (width / rule <= MAX_BINS), rule).otherwise(raw)
    one = F.col("hi") == F.col("lo")
    tiny = F.when(F.col("lo") != 0, 1e-12 * F.abs("lo")).otherwise(1e-12)
    grid = span.withColumn("start", F.when(one, F.col("lo") - tiny).otherwise(F.col("lo") - SHIFT * raw))
    grid = grid.withColumn("nbin", F.when(one, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("start")) / raw).cast("int"))))
    return grid.withColumn("width", F.when(one, tiny).otherwise((F.col("hi") - F.col("start")) / F.col("nbin"))).drop("__rule")


def place(x):
    """The bin of x on the grid (start, width, nbin) beside it."""
    at = F.ceil((x - F.col("start")) / F.col("width")).cast("int") - 1
    at = F.when(x <= F.col("start") + at * F.col("width"), at - 1).otherwise(at)
    return F.least(F.greatest(at, F.lit(0)), F.col("nbin") - 1)


def per_group(df: DataFrame, keys: list[str], x: str, bins: int = 200, scott: bool = False) -> DataFrame:
    """Non-empty bins of one histogram for each group: keys, bin, n, start, width, lo, hi, nbin."""
    both = df.join(grids(df, keys, x, bins, scott), keys).withColumn("bin", place(F.col(x).cast("double")))
    return both.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("start", "width", "lo", "hi", "nbin")))


MODEL = "start double, width double, lo double, hi double, counts array<long>"


def packed(bins: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of :func:`per_group`: start, width, lo, hi, bin, n (arrays of the bins that aren't empty)."""
    each = F.sort_array(F.collect_list(F.struct("bin", "n")))
    out = bins.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("start", "width", "lo", "hi", "nbin")), each.alias("b"))
    return out.select(*keys, "start", "width", "lo", "hi", "nbin", F.col("b.bin").alias("bin"), F.col("b.n").alias("n"))


def unpacked(row) -> Histogram:
    """A histogram from a row of :func:`packed`."""
    counts = np.zeros(int(row["nbin"]), np.int64)
    counts[np.asarray(row["bin"], np.int64)] = np.asarray(row["n"], np.int64)
    return Histogram(counts, float(row["start"]), float(row["width"]), float(row["lo"]), float(row["hi"]))
