"""Context of outliers: stacks, windows, counters, accelerator parents, normal examples, node state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.operators import calltree as C

VERSION = 2


KEYS = ("pid", "rid", "tid", "func")


def exemplar_rows(execs: DataFrame, keys=KEYS, minimum: float = 0) -> DataFrame:
    """What a step says of a key: ``normal``, its normal execution of least score, and ``asked``, whether an outlier asks for one.

    A step asks once for each function of a rank: for the outlier of at least ``minimum`` that starts first, on whatever thread.
    """
    keys = list(keys)
    normal = execs.where("label = 1").groupBy(*keys, "step").agg(F.min_by("id", F.struct("score", "id")).alias("normal"))
    rest = [k for k in keys if k != "tid"]
    asks = execs.where((F.col("label") == -1) & (F.col("exclusive") >= minimum)).groupBy(*rest, "step").agg(F.min_by("tid", F.struct("entry", "id")).alias("tid")).withColumn("asked", F.lit(True))
    both = normal.join(asks, [*keys, "step"], "full_outer")
    return both.select(*keys, "step", "normal", F.coalesce("asked", F.lit(False)).alias("asked"))


def _next(cache, waiting, normal, asked):
    """(example given, cache, waiting) after a step."""
    own = F.coalesce(normal, cache)
    gives = own.isNotNull() & (waiting | asked)
    given, left = F.when(gives, own), F.when(~gives, own)
    return given, left, F.when(own.isNull(), waiting | asked).otherwise(waiting & asked)


def normal_examples(execs: DataFrame, keys=KEYS, minimum: float = 0) -> DataFrame:
    """Normal executions that go with outliers: keys, step, example.

    The last normal execution of a key is kept from step to step. An outlier takes it, and it is used up; without one the
    request waits for the next normal execution. One row of state passes over a key's steps, in a built-in fold.
    """
    keys = list(keys)
    rows = exemplar_rows(execs, keys, minimum)
    kind = dict(rows.dtypes)
    each = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "normal", "asked"))).alias("steps"))
    out = f"array<struct<step:{kind['step']},example:{kind['normal']}>>"
    start = F.struct(F.lit(None).cast(kind["normal"]).alias("cache"), F.lit(False).alias("waiting"), F.array().cast(out).alias("out"))

    def fold(s, x):
        given, cache, waiting = _next(s["cache"], s["waiting"], x["normal"], x["asked"])
        found = F.array(F.struct(x["step"].alias("step"), given.alias("example"))).cast(out)
        return F.struct(cache.alias("cache"), waiting.alias("waiting"), F.when(given.isNotNull(), F.concat(s["out"], found)).otherwise(s["out"]).alias("out"))

    return each.select(*keys, F.explode(F.aggregate("steps", start, fold, lambda s: s["out"])).alias("e")).select(*keys, "e.step", "e.example")


def next_examples(state: DataFrame, execs: DataFrame, keys=KEYS, minimum: float = 0) -> DataFrame:
    """One step of :func:`normal_examples` on a stored state (keys, cache, waiting): keys, example (null: none), cache, waiting."""
    keys = list(keys)
    both = exemplar_rows(execs, keys, minimum).drop("step").join(state, keys, "full_outer")
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    given, cache, waiting = _next(F.col("cache"), off("waiting"), F.col("normal"), off("asked"))
    return both.select(*keys, given.alias("example"), cache.alias("cache"), waiting.alias("waiting"))


def node_state(counters: DataFrame, watch: DataFrame, keys=("pid", "rid")) -> DataFrame:
    """Latest value of each watched counter (watch: counter, field)."""
    return counters.join(F.broadcast(watch), "counter").groupBy(*keys, "field").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def watched_by_prefix(names: DataFrame, prefix: str = "monitoring: ") -> DataFrame:
    return names.where(F.col("name").startswith(prefix)).select(F.col("name").alias("counter"), F.substring("name", len(prefix) + 1, 1 << 20).alias("field"))


def gpu_threads(metadata: DataFrame) -> DataFrame:
    """Threads that metadata binds to a device, context and stream; the descriptions are fixed values."""
    kinds = {"CUDA Device": "device", "CUDA Context": "context", "CUDA Stream": "stream"}
    return metadata.where(F.col("descr").isin(*kinds)).groupBy("pid", "rid", "tid").agg(*(F.max(F.when(F.col("descr") == k, F.col("value").cast("long"))).alias(v) for k, v in kinds.items()))


def gpu_properties(metadata: DataFrame) -> DataFrame:
    """(device, key, value) of metadata called GPU[n] key."""
    form = r"^GPU\[(\d+)\]\s+(.*)$"
    return metadata.where(F.col("descr").rlike(form)).select("pid", "rid", F.regexp_extract("descr", form, 1).cast("long").alias("device"), F.regexp_extract("descr", form, 2).alias("key"), "value")


def hostnames(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("pid", "rid").agg(F.coalesce(F.max(F.when(F.col("descr") == "Hostname", F.col("value"))), F.lit("Unknown")).alias("hostname"))


#: Why an accelerator call has no host call.
NO_ID, SEVERAL, GONE = "Correlation ID of host parent event was not recorded", "Multiple host parent event correlation IDs found", "Host parent event could not be reached"


def host_parents(execs: DataFrame, partners: DataFrame, threads: DataFrame, stacks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Accelerator calls with the host call that launched them and its stack, or why there is none.

    ``partners`` are pairs as :func:`calltree.correlated` gives them (pid, rid, a, b: each tid and seq), ``threads`` the
    accelerator's threads, ``stacks`` the stack of each call (``execs`` itself if it has them), ``keep`` more columns of the
    accelerator's calls. All joins are on whole call ids.
    """
    own = ["pid", "rid", "tid", "seq"]
    both = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("p")
    sides = partners.select("pid", "rid", both).select("pid", "rid", "p.own.tid", "p.own.seq", F.col("p.other").alias("other"))
    gpu = execs.join(C.few(threads), ["pid", "rid", "tid"]).select(*own, "fid", *keep, *[c for c in threads.columns if c not in own])
    n = sides.groupBy(*own).agg(F.count("*").alias("n_partners"), F.min("other").alias("other"))
    one = gpu.join(n, own, "left").withColumn("host_tid", F.when(F.col("n_partners") == 1, F.col("other.tid"))).withColumn("host_seq", F.when(F.col("n_partners") == 1, F.col("other.seq")))
    whole = execs if stacks is execs else execs.drop("stack").join(stacks.select(*own, "stack"), own)
    host = whole.select("pid", "rid", F.col("tid").alias("host_tid"), F.col("seq").alias("host_seq"), F.col("fid").alias("host_fid"), F.col("stack").alias("host_stack"))
    out = one.join(host, ["pid", "rid", "host_tid", "host_seq"], "left").drop("other")
    why = F.when(F.col("n_partners").isNull(), NO_ID).when(F.col("n_partners") > 1, SEVERAL).when(F.col("host_fid").isNull(), GONE)
    return out.withColumn("error", why)


RECORD_ID = ["pid", "rid", "tid", "seq"]


def members(execs: DataFrame, size: int = 10) -> DataFrame:
    """Calls up to ``size`` before and after outliers, and these: (thread, seq, entry, exit). What happens in others is in no record."""
    w = W.partitionBy("pid", "rid", "tid").orderBy("seq").rowsBetween(-size, size)
    near = execs.select(*RECORD_ID, "entry", "exit", "label").withColumn("__near", F.min((F.col("label") != -1).cast("int")).over(w))
    return near.where("__near = 0").select(*RECORD_ID, "entry", "exit")


def windows(execs: DataFrame, messages: DataFrame, size: int = 10) -> DataFrame:
    """For outliers: ``exec_window``, the calls of their thread up to ``size`` before and after them, and ``comm_window``, what these sent and received."""
    own = F.struct("seq", "fid", "entry", "exit", "parent", (F.col("label") == -1).alias("is_anomaly"))
    w = W.partitionBy("pid", "rid", "tid").orderBy("seq").rowsBetween(-size, size)
    # without the calls that are in nobody's window, those of a window are still neighbours
    wide = execs.select(*RECORD_ID, "fid", "entry", "exit", "parent", "label").withColumn("__near", F.min((F.col("label") != -1).cast("int")).over(w)).where("__near = 0")
    wide = wide.withColumn("exec_window", F.collect_list(own).over(w)).where("label = -1").select(*RECORD_ID, "exec_window")
    sent = messages.where("call_seq IS NOT NULL").select("pid", "rid", "tid", F.col("call_seq").alias("__member"), F.struct("ts", "kind", "partner", "tag", "bytes").alias("m"))
    member = wide.select(*RECORD_ID, F.explode("exec_window.seq").alias("__member"))
    comm = member.join(sent, ["pid", "rid", "tid", "__member"]).groupBy(*RECORD_ID).agg(F.sort_array(F.collect_list("m")).alias("comm_window"))
    return wide.join(comm, RECORD_ID, "left").withColumn("comm_window", F.coalesce("comm_window", F.array().cast(dict(comm.dtypes)["comm_window"])))


def records(
    execs: DataFrame, counters: DataFrame, messages: DataFrame, minimum: float = 0, window: int = 10, stacks: DataFrame | None = None, host: DataFrame | None = None, hostname: DataFrame | None = None,
    state: DataFrame | None = None, params: DataFrame | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """Anomaly records of outliers of at least ``minimum`` exclusive time.

    They hold the call stack, the window of calls and messages around the call, its counters and, where given: its host call if
    it ran on an accelerator (:func:`host_parents`), the rank's host name and node state, the parameters of the algorithm for its
    function, and the function's name. ``stacks`` may be ``execs`` itself if it has them. Small tables join by rank or function; Spark sizes those joins.
    """
    bad = execs.where((F.col("label") == -1) & (F.col("exclusive") >= minimum))
    c = counters.where("call_seq IS NOT NULL").groupBy("pid", "rid", "tid", F.col("call_seq").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("ts", "counter_id", "value"))).alias("counter_events"))
    out = bad.join(windows(execs, messages, window), RECORD_ID)
    if stacks is not execs:
        out = out.drop("stack").join((C.stacks(execs) if stacks is None else stacks).select(*RECORD_ID, "stack"), RECORD_ID, "left")
    out = out.join(c, RECORD_ID, "left")
    if host is not None:
        info = F.struct(*[x for x in host.columns if x not in (*RECORD_ID, "fid")]).alias("gpu")
        out = out.join(host.select(*RECORD_ID, info), RECORD_ID, "left").withColumn("is_gpu_event", F.col("gpu").isNotNull())
    if hostname is not None:
        out = out.join(hostname.select("pid", "rid", "hostname"), ["pid", "rid"], "left")
    if state is not None:
        fields = state.groupBy("pid", "rid").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("node_state"))
        out = out.join(fields, ["pid", "rid"], "left")
    if params is not None:
        out = out.join(params.select("fid", F.struct(*[x for x in params.columns if x != "fid"]).alias("algo_params")), "fid", "left")
    if names is not None:
        out = out.join(names.select("fid", F.col("name").alias("func_name")), "fid", "left")
    return out.withColumn("version", F.lit(VERSION)).withColumn("outlier_severity", F.col("exclusive"))


def in_steps(rows: DataFrame, start: int = -1, stop: int = -1) -> DataFrame:
    """Records from ``start`` to ``stop``; -1 leaves an end open."""
    keep = F.lit(True)
    if start >= 0:
        keep &= F.col("step") >= start
    if stop >= 0:
        keep &= F.col("step") <= stop
    return rows.where(keep)
