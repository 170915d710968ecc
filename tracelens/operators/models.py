"""Outlier models: standard deviation, histogram and copula scores, in batch and step by step."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens import session
from tracelens.functions import histogram as H

#: Fixed value. Added to probabilities before the logarithm; bounds scores by about 100.
ALPHA = 78.88e-32
#: Fixed values of labels; 0 is not labelled yet.
NORMAL, OUTLIER = 1, -1


@dataclass
class Params:
    algorithm: str = "sstd"
    sstd_sigma: float = 6.0
    hbos_thres: float = 0.99
    glob_thres: bool = True
    hbos_max_bins: int = 200


def first_calls_ignored(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``first``: the first execution of its key by the order in which they end; it is normal and not learnt from."""
    return df.withColumn("first", F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1)


def data_set(df: DataFrame, ignored: list[str] | None = None, func: str = "func") -> DataFrame:
    """What a model sees: executions without a label yet, without first calls (``first``, where there is such a column) and functions to ignore.

    The others keep the label they have, or are normal.
    """
    skip = F.lit(False)
    if "label" in df.columns:
        skip |= F.col("label") != 0
    if "first" in df.columns:
        skip |= F.col("first")
    if ignored:
        skip |= F.col(func).isin(*ignored)
    return df.withColumn("learn", ~skip)


def labelled(df: DataFrame, keys: list[str], x: str, sigma: float = 6.0, ignored: list[str] | None = None) -> DataFrame:
    """Labels of the standard-deviation model that leave out what :func:`data_set` does: those rows are normal, or what they were, and score 0."""
    known = data_set(df, ignored, keys[0])
    old = F.when(F.col("label") != 0, F.col("label")).otherwise(NORMAL) if "label" in df.columns else F.lit(NORMAL)
    model = sstd_model(known.where("learn"), keys, x)
    scored = sstd_label(known.withColumn("__old", old).drop("label", "score").join(model, keys, "left"), x, sigma)
    return scored.withColumn("label", F.when(F.col("learn"), F.coalesce("label", F.lit(0))).otherwise(F.col("__old"))).withColumn("score", F.when(F.col("learn"), F.col("score")).otherwise(0.0)).drop("__old")


def sstd_model(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """n, mean, sd of each key."""
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"))


def sstd_steps(df: DataFrame, keys: list[str], step: str, x: str) -> DataFrame:
    """Model of each key after each step: sums move to a common centre first, then run over the steps."""
    centre = df.groupBy(*keys).agg(F.avg(x).alias("__c"))
    d = F.col(x) - F.col("__c")
    sums = df.join(centre, keys).groupBy(*keys, step).agg(F.count(x).alias("k"), F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.first("__c").alias("__c"))
    w = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    run = sums.select(*keys, step, "__c", F.sum("k").over(w).alias("n"), F.sum("s1").over(w).alias("s1"), F.sum("s2").over(w).alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return run.select(*keys, step, "n", (F.col("__c") + F.col("s1") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(0.0))).alias("sd"))


def sstd_label(df: DataFrame, x: str, sigma: float = 6.0) -> DataFrame:
    """score and label from n, mean, sd; under two samples the label is 0 and the score -1."""
    off = F.abs(F.col(x) - F.col("mean"))
    known = F.col("n") >= 2
    score = F.when(known, off / F.when(F.col("sd") == 0, 1e-10).otherwise(F.col("sd"))).otherwise(-1.0)
    return df.withColumn("score", score).withColumn("label", F.when(~known, 0).when(off > sigma * F.col("sd"), OUTLIER).otherwise(NORMAL))


def hbos_label(df: DataFrame, keys: list[str], x: str, bins: int = 200, threshold: float = 0.99) -> DataFrame:
    """score and label by one histogram per key: -log2 of the bin's share; an outlier reaches the threshold between least and greatest.

    Rows are binned once; their bin's count and the key's total are sums of that table of bins.
    """
    placed = df.join(H.grids(df, keys, x, bins), keys).withColumn("bin", H.place(F.col(x).cast("double"))).drop("start", "width", "nbin", "lo", "hi")
    total = W.partitionBy(*keys)
    s = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n")).withColumn("score", -F.log2(F.col("n") / F.sum("n").over(total) + ALPHA))
    s = s.withColumn("limit", F.min("score").over(total) + threshold * (F.max("score").over(total) - F.min("score").over(total)))
    s = s.withColumn("limit", F.greatest("limit", F.lit(float(np.log2(1.00001)))))
    out = placed.join(s, [*keys, "bin"])
    return out.withColumn("label", F.when(F.col("score") >= F.col("limit"), OUTLIER).otherwise(NORMAL))


def threshold_label(df: DataFrame, keys: list[str], x: str, share: float = 0.05, bins: int = 200) -> DataFrame:
    """Outliers are in bins that hold under ``share`` of what the key's fullest bin holds."""
    out = hbos_label(df, keys, x, bins).drop("label")
    top = out.groupBy(*keys).agg(F.max("n").alias("__top"))
    return out.join(top, keys).withColumn("label", F.when(F.col("n") < share * F.col("__top"), OUTLIER).otherwise(NORMAL)).drop("__top")


def hbos_scores(h: H.Histogram, values: np.ndarray, tolerance: float = 0.05) -> np.ndarray:
    """Scores of values by a stored histogram; outside it the greatest score there is."""
    bins = np.array([h.bin(float(v), tolerance) for v in values])
    p = np.where(bins >= 0, h.counts[np.maximum(bins, 0)] / h.total, 0.0)
    return -np.log2(p + ALPHA)


def hbos_limit(h: H.Histogram, threshold: float = 0.99) -> float:
    s = -np.log2(h.counts[h.counts > 0] / h.total + ALPHA)
    return float(s.min() + threshold * (s.max() - s.min()))


def copod_scores(h: H.Histogram, values: np.ndarray) -> np.ndarray:
    """Greatest of the mean two-sided tail score and the one that the skewness points to."""
    n, skew, neg = h.total, h.skewness(), h.negated()
    left, right = np.array([h.cdf(float(v)) for v in values]), np.array([neg.cdf(float(-v)) for v in values])
    left = np.minimum(1.0, np.where(values >= h.lo, left + 1 / n, left))
    right = np.minimum(1.0, np.where(-values >= neg.lo, right + 1 / n, right))
    low, high = -np.log2(left + ALPHA), -np.log2(right + ALPHA)
    return np.maximum((low + high) / 2, -np.sign(skew - 1) * low + np.sign(skew + 1) * high)


def copod_limit(h: H.Histogram, threshold: float = 0.99) -> float:
    s = copod_scores(h, h.middles()[h.counts > 0])
    return float(s.max() - (1 - threshold) * abs(s.max() - s.min())) if s.max() < 0 else float(s.min() + threshold * (s.max() - s.min()))


def _rule(params: Params):
    return H.width_scott if params.algorithm == "copod" else H.width_count(params.hbos_max_bins)


def step_models(df: DataFrame, key: str, step: str, x: str, params: Params, start: DataFrame | None = None) -> DataFrame:
    """Model of each key after each step: key, step, start, width, lo, hi, nbin, counts, limit, skew.

    Rows become one histogram for each key and step in built-in aggregates; only these, a row of at most
    ``hbos_max_bins`` (COPOD: MAX_BINS) counts a step, are folded key by key. ``start`` has models (key, start, width,
    lo, hi, nbin, counts, limit) to begin with.
    """
    copod = params.algorithm == "copod"
    rule, limit = _rule(params), copod_limit if copod else hbos_limit
    each = H.packed(H.per_group(df, [key, step], x, params.hbos_max_bins, scott=copod), [key, step])
    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {step} {types[step]}, start double, width double, lo double, hi double, nbin int, counts array<long>, limit double, skew double"

    def fold(g: pd.DataFrame, old: pd.DataFrame | None = None) -> pd.DataFrame:
        model, floor, out = None, float(np.log2(1.00001)), []
        if old is not None and len(old):
            o = old.iloc[0]
            model, floor = H.Histogram(np.asarray(o["counts"], np.int64), o["start"], o["width"], o["lo"], o["hi"]), max(floor, float(o["limit"]))
        for _, r in g.sort_values(step).iterrows():
            own = H.unpacked(r)
            model = own if model is None else model.merged(own, rule)
            least = max(limit(model, params.hbos_thres), floor)
            if params.glob_thres or copod:
                floor = max(floor, least)
            out.append((r[key], r[step], model.start, model.width, model.lo, model.hi, len(model.counts), model.counts.tolist(), least, model.skewness()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    if start is None:
        return each.groupBy(key).applyInPandas(lambda g: fold(g), schema)
    return each.groupBy(key).cogroup(start.groupBy(key)).applyInPandas(lambda g, old: fold(g, old), schema)


def scored(df: DataFrame, on: list[str], x: str, models: DataFrame, copod: bool = False) -> DataFrame:
    """score and label of rows by the models beside them (keys ``on``): bins are looked up by equal keys, in built-in functions."""
    models = session.materialize(models, "models")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    grid = models.select(*on, "start", "width", "lo", "hi", "nbin", "limit", "skew", total.alias("total"))
    bins = models.select(*on, F.posexplode("counts").alias("bin", "n")).withColumn("upto", F.sum("n").over(W.partitionBy(*on).orderBy("bin")))
    v = F.col(x).cast("double")
    known = v.between(F.col("lo"), F.col("hi"))
    out = df.join(grid, on, "left").withColumn("bin", F.when(known, H.place(v)))
    out = out.join(bins, [*on, "bin"], "left")
    if not copod:
        score = -F.log2(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)) + ALPHA)
    else:
        low = F.col("start") + F.col("bin") * F.col("width")
        high = F.when(F.col("bin") == F.col("nbin") - 1, F.col("hi")).otherwise(low + F.col("width"))
        one = F.col("lo") == F.col("hi")
        below = F.when(v < F.col("lo"), 0.0).when((v > F.col("hi")) | one, 1.0).otherwise((F.col("upto") - F.col("n") + F.col("n") * (v - low) / (high - low)) / F.col("total"))
        out = out.withColumn("__left", F.least(F.lit(1.0), below + F.when(v >= F.col("lo"), 1 / F.col("total")).otherwise(0.0)))
        # the same from above: bins of the mirrored histogram begin a little over the greatest value
        far = (-v + F.col("hi") + H.SHIFT * F.col("width")) / F.col("width")
        i = F.least(F.greatest(F.ceil(far).cast("int") - 1, F.lit(0)), F.col("nbin") - 1)
        out = out.withColumn("__far", far - i).withColumn("__bin", F.when(known, F.col("nbin") - 1 - i)).drop("n", "upto")
        out = out.join(bins.select(*on, F.col("bin").alias("__bin"), F.col("n"), "upto"), [*on, "__bin"], "left")
        above = F.when(v > F.col("hi"), 0.0).when((v < F.col("lo")) | one, 1.0).otherwise((F.col("total") - F.col("upto") + F.col("n") * F.col("__far")) / F.col("total"))
        right = F.least(F.lit(1.0), above + F.when(v <= F.col("hi"), 1 / F.col("total")).otherwise(0.0))
        a, b = -F.log2(F.col("__left") + ALPHA), -F.log2(right + ALPHA)
        score = F.greatest((a + b) / 2, -F.signum(F.col("skew") - 1) * a + F.signum(F.col("skew") + 1) * b)
    out = out.withColumn("score", F.when(F.col("total").isNotNull(), score).otherwise(-1.0))
    out = out.withColumn("label", F.when(F.col("total").isNull(), 0).when(F.col("score") >= F.col("limit"), OUTLIER).otherwise(NORMAL))
    return out.select(*df.columns, "score", "label")


def folded(df: DataFrame, key: str, step: str, x: str, id_: str, params: Params) -> DataFrame:
    """HBOS or COPOD step by step: each step's histogram joins the model, which then scores the step; (id, score, label)."""
    models = step_models(df, key, step, x, params)
    return scored(df.select(id_, key, step, x), [key, step], x, models, params.algorithm == "copod").select(id_, "score", "label")


def confusion(df: DataFrame, label: str, truth: str, keys: list[str] = ()) -> DataFrame:
    """Rows by outlier label and truth."""
    found = F.col(label) == OUTLIER
    kind = F.when(found & F.col(truth), "TP").when(found, "FP").when(F.col(truth), "FN").otherwise("TN")
    return df.groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("n"))


def model_table(df: DataFrame, key: str, x: str, params: Params) -> DataFrame:
    """One serialised model per key, as JSON text with the keys of the stored format, from built-in aggregates alone."""
    bins = H.packed(H.per_group(df, [key], x, params.hbos_max_bins, scott=params.algorithm == "copod"), [key])
    counts = F.expr("transform(sequence(0, nbin - 1), i -> coalesce(element_at(map_from_arrays(bin, n), i), 0L))")
    text = F.to_json(F.struct(counts.alias("Bin Counts"), F.col("start").alias("First edge"), F.col("width").alias("Bin width"), F.col("lo").alias("Min"), F.col("hi").alias("Max"), F.lit(params.algorithm).alias("algorithm")))
    return bins.select(key, text.alias("model"))


def model_of(models: DataFrame, key: str, value) -> H.Histogram:
    """The stored model of one key; that there is none is an error."""
    found = models.where(F.col(key) == value).take(1)
    if not found:
        raise LookupError(f"no model for {value!r}")
    return H.Histogram.from_json(json.loads(found[0]["model"]))


def synced(step: int, rank: int, frequency: int) -> bool:
    """Whether a rank exchanges its model in this step: always in its first, then in turns; 0 keeps the model frozen."""
    return step == 0 or (frequency > 0 and (step + rank) % frequency == 0)


def rescored(records: DataFrame, model: DataFrame, keys: list[str], x: str, sigma: float = 6.0) -> DataFrame:
    """Stored anomalies under a frozen model: those that are normal now go, the others get the new score."""
    return sstd_label(records.drop("score", "label", "n", "mean", "sd").join(model, keys), x, sigma).where(F.col("label") == OUTLIER)


def pruned(anomalies: DataFrame, normals: DataFrame, model: DataFrame, keys: list[str], x: str, sigma: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """(anomalies, normal examples) that a frozen model leaves: each keeps what it labels the same, with its score and parameters (n, mean, sd).

    Records of keys that the model doesn't know, or knows too little of, stay as they are.
    """
    out = []
    for records, label in ((anomalies, OUTLIER), (normals, NORMAL)):
        old = records.withColumnRenamed("score", "__score").drop("label", "n", "mean", "sd")
        new = sstd_label(old.join(model, keys, "left"), x, sigma)
        unknown = F.col("n").isNull() | (F.col("label") == 0)
        kept = new.where(unknown | (F.col("label") == label)).withColumn("score", F.when(unknown, F.col("__score")).otherwise(F.col("score"))).withColumn("label", F.lit(label))
        out.append(kept.drop("__score"))
    return out[0], out[1]


def evaluated(df: DataFrame, keys: list[str], x: str, truth: str, batch: str, params: Params) -> DataFrame:
    """Rows by outlier label and truth for each batch, the model growing batch by batch."""
    if params.algorithm == "sstd":
        found = sstd_label(df.join(sstd_steps(df, keys, batch, x), [*keys, batch]), x, params.sstd_sigma)
    else:
        models = step_models(df, keys[0], batch, x, params)
        found = scored(df, [keys[0], batch], x, models, params.algorithm == "copod")
    return confusion(found, "label", truth, [batch])
