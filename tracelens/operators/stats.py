"""Profiles and anomaly statistics, from single contributions up to programs.

Expected columns: pid, rid, tid, step, func, entry, exit, runtime, exclusive, label, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.functions import runstats as R


def _stats(x: str, name: str):
    return F.struct(*R.aggregates(x)).alias(name)


def function_profile(execs: DataFrame, keys=("pid", "func", "step")) -> DataFrame:
    """Inclusive and exclusive times, anomalies and time span of each function."""
    return execs.groupBy(*keys).agg(_stats("runtime", "inclusive"), _stats("exclusive", "exclusive"), F.sum((F.col("label") == -1).cast("long")).alias("n_anomaly"), F.min("entry").alias("first"), F.max("exit").alias("last"))


def anomaly_data(execs: DataFrame, keys=("pid", "rid", "step")) -> DataFrame:
    """Anomalies, their scores and the time span of each rank and step; steps without any count 0."""
    score = F.when(F.col("label") == -1, F.col("score"))
    return execs.groupBy(*keys).agg(F.count(score).alias("n_anomalies"), F.min("entry").alias("min_ts"), F.max("exit").alias("max_ts"), _stats(score, "scores"))


def counter_stats(counters: DataFrame, keys=("pid", "counter", "step")) -> DataFrame:
    return counters.groupBy(*keys).agg(_stats("value", "stats"))


def anomaly_metrics(execs: DataFrame, keys=("pid", "rid", "func", "step")) -> DataFrame:
    """Count, scores and severities (exclusive time) of the functions that have outliers."""
    return execs.where("label = -1").groupBy(*keys).agg(F.count("*").alias("n"), _stats("score", "score"), _stats("exclusive", "severity"), F.min("entry").alias("min_ts"), F.max("exit").alias("max_ts"))


def rolled_metrics(execs: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics over steps: statistics of the count per contribution (rank and step), of scores and severities."""
    found = execs.where("label = -1")
    counts = found.groupBy(*keys, *[k for k in ("rid", "step") if k not in keys]).agg(F.count("*").alias("n"))
    counts = counts.groupBy(*keys).agg(_stats("n", "count"))
    rest = found.groupBy(*keys).agg(_stats("score", "score"), _stats("exclusive", "severity"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.min("entry").alias("min_ts"), F.max("exit").alias("max_ts"))
    return counts.join(rest, keys)


def aggregate_profile(execs: DataFrame, keys: list[str]) -> DataFrame:
    """Times over all ranks and steps, and statistics of the anomalies per contribution."""
    each = execs.groupBy(*keys, "rid", "step").agg(F.sum((F.col("label") == -1).cast("long")).alias("n")).groupBy(*keys).agg(_stats("n", "anomaly_count"))
    times = execs.groupBy(*keys).agg(_stats("runtime", "inclusive"), _stats("exclusive", "exclusive"))
    return times.join(each, keys)


def function_stats(profile: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Profile and metrics side by side; what one side lacks is null."""
    return profile.join(metrics, keys, "full_outer")


def time_shares(profile: DataFrame, func: str = "func") -> DataFrame:
    """Exclusive seconds of each function and their share of the whole, by one window over a row for each function."""
    each = profile.groupBy(func).agg((F.sum(F.col("exclusive.count") * F.col("exclusive.mean")) / 1e6).alias("seconds"))
    whole = F.sum("seconds").over(W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return each.select(func, "seconds", (F.col("seconds") / whole).alias("share"))


def since(packets: DataFrame, last_step: int) -> DataFrame:
    """What has come after the last emission."""
    return packets.where(F.col("step") > last_step)


def rank_anomalies(execs: DataFrame, last_step: int = -1, keys=("pid", "rid")) -> DataFrame:
    """Statistics of the anomalies per step for each rank, and ``packets``: the steps' own figures after ``last_step``."""
    each = anomaly_data(execs, [*keys, "step"])
    packet = F.when(F.col("step") > last_step, F.struct("step", "n_anomalies", "min_ts", "max_ts"))
    return each.groupBy(*keys).agg(_stats("n_anomalies", "anomaly_count"), F.sort_array(F.collect_list(packet)).alias("packets"))


def global_anomalies(execs: DataFrame, last_step: int = -1) -> tuple[DataFrame, DataFrame]:
    """(per rank, per function): :func:`rank_anomalies` and :func:`aggregate_profile` of all that was sent."""
    return rank_anomalies(execs, last_step), aggregate_profile(execs, ["pid", "func"])


def global_counters(states: DataFrame) -> DataFrame:
    """Counters' statistics over ranks and steps, merged from what each sent (pid, counter, state)."""
    return R.merge(states, ["pid", "counter"]).select("pid", "counter", F.struct(*R.report()).alias("stats"))


def counter_subset(counters: DataFrame, names: list[str] | None) -> DataFrame:
    """The counters whose statistics are wanted; all without names."""
    return counters if names is None else counters.where(F.col("counter").isin(*names))


def recent_metrics(execs: DataFrame, last_step: int, keys=("pid", "rid", "func")) -> DataFrame:
    """Metrics of what is new since ``last_step`` beside the full ones; every new row has a full one."""
    k = list(keys)
    new, full = rolled_metrics(since(execs, last_step), k), rolled_metrics(execs, k)
    pack = lambda df, name: df.select(*k, F.struct(*[c for c in df.columns if c not in k]).alias(name))
    return pack(new, "new_data").join(pack(full, "all_data"), k)


def profile_documents(profile: DataFrame, metrics: DataFrame, names: DataFrame) -> DataFrame:
    """A document for each function: pid, fid, name, runtime_profile, anomaly_metrics (null without any)."""
    k = ["pid", "func"]
    run = profile.select(*k, F.struct(*[c for c in profile.columns if c not in k]).alias("runtime_profile"))
    bad = metrics.select(*k, F.struct(*[c for c in metrics.columns if c not in k]).alias("anomaly_metrics"))
    return run.join(bad, k, "left").join(names.select(F.col("name").alias("func"), "fid"), "func").select("pid", "fid", F.col("func").alias("name"), "runtime_profile", "anomaly_metrics")


def data_sets(execs: DataFrame, keys=("func", "step")) -> tuple[DataFrame, DataFrame]:
    """(records, counts): of each data set all outliers and the normal execution of least score, first of equal ones; and how many were labelled."""
    k = list(keys)
    labelled = execs.where(F.col("label") != 0)
    best = labelled.where("label = 1").groupBy(*k).agg(F.min_by("id", F.struct("score", "id")).alias("id"))
    normal = labelled.join(best, [*k, "id"], "left_semi")
    count = labelled.groupBy(*k).agg(F.sum((F.col("label") == 1).cast("long")).alias("n_normal"), F.sum((F.col("label") == -1).cast("long")).alias("n_outlier"))
    recorded = count.withColumn("n_recorded", F.col("n_outlier") + F.when(F.col("n_normal") > 0, 1).otherwise(0))
    return labelled.where("label = -1").unionByName(normal), recorded


def combined_packets(funcs: DataFrame, counters: DataFrame, metrics: DataFrame, keys=("pid", "rid", "step")) -> DataFrame:
    """What a rank sends for a step: function profiles, counter statistics and anomaly metrics, each a list; sides that lack a step are empty."""
    k = list(keys)
    out = None
    for name, df in (("func", funcs), ("counter", counters), ("metrics", metrics)):
        own = [c for c in df.columns if c not in k]
        side = df.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name))
        out = side if out is None else out.join(side, k, "full_outer")
    return out


def run_report(ranks: DataFrame) -> DataFrame:
    """Sums over ranks of what each reports: time, outliers, steps."""
    return ranks.agg(F.sum("seconds").alias("seconds"), F.sum("n_outliers").alias("n_outliers"), F.sum("n_steps").alias("n_steps"), F.count("*").alias("n_ranks"))


def rank_report(execs: DataFrame) -> DataFrame:
    """What each rank reports at its end."""
    span = (F.max("exit") - F.min("entry")) / 1e6
    return execs.groupBy("pid", "rid").agg(span.alias("seconds"), F.sum((F.col("label") == -1).cast("long")).alias("n_outliers"), F.countDistinct("step").alias("n_steps"))
