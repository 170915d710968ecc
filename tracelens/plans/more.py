"""Queries over nested calls, messages and counters, and over what runs exchange and store, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens import session
from tracelens.functions import histogram as H
from tracelens.functions import runstats as R
from tracelens.functions import scalars as X
from tracelens.operators import calltree as C
from tracelens.operators import collections as D
from tracelens.operators import dictionary as N
from tracelens.operators import models as M
from tracelens.operators import provenance as P
from tracelens.operators import stats as S
from tracelens.plans.frames import CT, EX, NESTED, NESTED_POINTS, counters, execs, nested, nested_calls, nested_points, table
from tracelens.plans.queries import _HIST, _LAB, _labelled, _r, query
from tracelens.sources import sinks, trace

OWN = ["pid", "rid", "tid", "seq"]

# -- call trees

_MERGE = f"""{NESTED}, {NESTED_POINTS},
ev AS (SELECT tid, rid, pid, 'ENTRY' AS kind, entry AS ts, k * 200 + i0 AS idx FROM sp UNION ALL SELECT tid, rid, pid, 'EXIT', exit, k * 200 + i1 FROM sp),
fn AS (SELECT *, CASE WHEN max((kind = 'EXIT')::INT) OVER (PARTITION BY pid, rid, tid, ts ORDER BY idx) = 0 THEN 0 ELSE 3 END AS prio FROM ev),
al AS (SELECT pid, rid, tid, kind, ts, idx, prio FROM fn UNION ALL SELECT pid, rid, tid, 'SEND', ts, idx, 1 FROM ms UNION ALL SELECT pid, rid, tid, 'COUNT', ts, idx, 2 FROM cn)"""


@query(f"WITH {_MERGE} SELECT rid, tid, kind, ts, idx, row_number() OVER (PARTITION BY pid, rid, tid ORDER BY ts, prio, idx) AS seq FROM al")
def event_merge(spark, sf_dir):
    sent, counted = nested_points(spark, sf_dir)
    return C.merged(nested(spark, sf_dir), sent, counted).select("rid", "tid", "kind", "ts", "idx", F.col("seq").cast("long").alias("seq"))


@query(
    f"""WITH {NESTED}, sm AS (SELECT *, fid IN ('first', 'second', 'third') AS side FROM sp),
inn AS (SELECT s.k, s.i0, sum(c.exit - c.entry)::BIGINT AS inside, count(*) AS n FROM sm s JOIN sm c ON c.k = s.k AND c.depth = s.depth + 1 AND (s.depth = 1 OR NOT (c.side OR s.side)) GROUP BY ALL)
SELECT rid, tid, fid, entry, exit, depth::BIGINT AS depth, exit - entry AS runtime, exit - entry - coalesce(inside, 0) AS exclusive, coalesce(inn.n, 0) AS n_children FROM sm LEFT JOIN inn USING (k, i0)"""
)
def nested_executions(spark, sf_dir):
    """All nested calls, leaves as well, with the time that is their own."""
    return nested_calls(spark, sf_dir).select("rid", "tid", "fid", "entry", "exit", "depth", "runtime", "exclusive", "n_children")


@query(f"WITH {NESTED} SELECT rid, tid, entry, exit, stack FROM sp")
def nested_stacks(spark, sf_dir):
    """Stacks of any depth, carried in the pass that pairs events."""
    return nested_calls(spark, sf_dir, stack=True).select("rid", "tid", "entry", "exit", F.array_join("stack", "<").alias("stack"))


@query(f"WITH {NESTED} SELECT rid, tid, entry, exit, stack FROM sp")
def stored_stacks(spark, sf_dir):
    """The same from calls that are stored without their stacks."""
    return C.stacks(nested_calls(spark, sf_dir), ("entry", "exit")).select("rid", "tid", "entry", "exit", F.array_join("stack", "<").alias("stack"))


@query(
    f"""WITH {NESTED}, {NESTED_POINTS}, p AS (SELECT pid, rid, tid, k, ts, idx, 'SEND' AS kind FROM ms UNION ALL SELECT pid, rid, tid, k, ts, idx, 'COUNT' FROM cn)
SELECT p.rid, p.tid, p.ts, p.kind, arg_min(sp.fid, sp.i1) AS fid FROM p JOIN sp ON sp.k = p.k AND p.ts BETWEEN sp.entry AND sp.exit GROUP BY ALL"""
)
def nested_attach(spark, sf_dir):
    """Messages and counters with the call that they belong to; at equal times the one that exits first."""
    c = nested_calls(spark, sf_dir)
    sent, counted = nested_points(spark, sf_dir)
    p = sent.select("pid", "rid", "tid", "ts", "kind").unionByName(counted.select("pid", "rid", "tid", "ts", F.lit("COUNT").alias("kind")))
    return C.attached(p, c, carry=("fid",)).where("call_seq IS NOT NULL").select("rid", "tid", "ts", "kind", "fid")


@query(f"WITH {NESTED}, {NESTED_POINTS}, w AS (SELECT pid, rid, tid, k, t AS t0, t + 700 AS t1 FROM od UNION ALL SELECT pid, rid, tid, k, t + 650, t + 900 FROM od) SELECT w.rid, w.tid, t0, t1, count(*) AS n, sum(counter_id)::BIGINT AS total FROM w JOIN cn ON cn.k = w.k AND cn.ts BETWEEN t0 AND t1 GROUP BY ALL")
def overlapping_windows(spark, sf_dir):
    """Counters in windows that overlap, both ends included."""
    o = table(spark, sf_dir, "orders")
    own = [F.lit(0).cast("long").alias("pid"), (F.col("o_custkey") % 4).alias("rid"), (F.col("o_custkey") % 509).alias("tid")]
    begin = F.col("o_orderkey") * 1000
    spans = F.explode(F.array(F.struct(begin.alias("t0"), (begin + 700).alias("t1")), F.struct((begin + 650).alias("t0"), (begin + 900).alias("t1")))).alias("w")
    windows = o.select(*own, spans).select("pid", "rid", "tid", "w.*")
    hit = C.in_window(nested_points(spark, sf_dir)[1], windows)
    return hit.groupBy("rid", "tid", "t0", "t1").agg(F.count("*").alias("n"), F.sum("counter_id").alias("total"))


#: Of orders: the accelerator's call has no id if the key is divisible by 7, else two if it is by 5, else one.
_GPU = """gp AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 5 = 0 THEN 2 ELSE 1 END AS ids FROM od)"""


def _gpu(spark, sf_dir, stack: bool = True):
    """(calls of hosts and accelerators, with stacks if they are wanted, correlation ids of calls, accelerator threads)."""
    host = nested_calls(spark, sf_dir, stack).select(*OWN, "fid", "entry", *(["stack"] if stack else []), (F.floor(F.col("entry") / 1000)).alias("k"))
    o = table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("pid"), (F.col("o_custkey") % 4).alias("rid"), (F.col("o_custkey") % 509 + 1000).alias("tid"), F.col("o_orderkey").alias("k"))
    kernel = o.withColumn("seq", F.row_number().over(W.partitionBy("pid", "rid", "tid").orderBy("k"))).withColumn("fid", F.lit("kernel")).withColumn("entry", F.col("k") * 1000 + 950)
    calls = host.unionByName(kernel.withColumn("stack", F.array("fid")) if stack else kernel)
    ids = F.when(F.col("k") % 7 == 0, F.array().cast("array<bigint>")).when(F.col("k") % 5 == 0, F.array(F.col("k"), F.col("k") + 10**9)).otherwise(F.array(F.col("k")))
    order = F.col("entry").alias("order")
    own = kernel.select(*OWN, "k", order, F.explode(ids).alias("value"))
    launched = F.when(F.col("fid") == "first", F.col("k")).when((F.col("fid") == "second") & (F.col("k") % 5 == 0), F.col("k") + 10**9)
    launch = host.where("fid IN ('first', 'second') AND k % 7 <> 0").select(*OWN, "k", order, launched.alias("value")).where("value IS NOT NULL")
    return calls, own.unionByName(launch), kernel.select("pid", "rid", "tid").distinct().withColumn("device", F.col("tid") - 1000)


@query(
    f"""WITH {NESTED}, {_GPU} SELECT rid, tid + 1000 AS tid, k * 1000 + 950 AS entry, tid AS device, CASE WHEN ids = 1 THEN 'first' END AS host_fid, CASE WHEN ids = 1 THEN 'first<' || name END AS host_stack,
CASE ids WHEN 0 THEN 'Correlation ID of host parent event was not recorded' WHEN 2 THEN 'Multiple host parent event correlation IDs found' END AS error FROM gp"""
)
def gpu_host_stack(spark, sf_dir):
    """Accelerator calls with the stack of the host call that launched them, or why there is none; threads number their calls each for itself."""
    calls, ids, threads = _gpu(spark, sf_dir)
    pairs = C.correlated(ids, order="order")
    out = P.host_parents(calls, pairs, threads, calls, ("entry",))
    return out.select("rid", "tid", "entry", "device", "host_fid", F.array_join("host_stack", "<").alias("host_stack"), "error")


@query(f"WITH {NESTED}, {_GPU} SELECT rid, tid + 1000 AS tid, 2::BIGINT AS n, count(*) AS calls FROM gp WHERE ids = 2 GROUP BY ALL")
def gpu_several_ids(spark, sf_dir):
    """Accelerator calls with more than one correlation id."""
    _, ids, threads = _gpu(spark, sf_dir, stack=False)
    return C.several_ids(ids, threads).groupBy("rid", "tid", "n").agg(F.count("*").alias("calls"))


@query("SELECT (props::JSON->>'k')::BIGINT AS value, user_id % 4 AS rid, count(*) // 2 AS pairs, count(*) % 2 AS open FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def correlation_ignored(spark, sf_dir):
    """Correlation ids of a rank, without those of a function on the ignore list: pairs, and what is left open."""
    c = counters(spark, sf_dir)
    calls = c.select("pid", "rid", "tid", F.col("id").alias("seq"), F.col("counter").alias("fid"), F.col("id").alias("exit_seq"))
    points = c.select("pid", "rid", "tid", F.col("id").alias("call_seq"), F.lit(7).cast("long").alias("counter_id"), "value")
    names = spark.createDataFrame([(7, "Correlation ID"), (8, "Other")], "id long, name string")
    ids = C.correlation_ids(calls, points, names, spark.createDataFrame([("error",)], "name string"))
    pairs = C.correlated(ids).groupBy("rid", "value").agg(F.count("*").alias("pairs"))
    left = C.unmatched(ids).select("rid", "value", F.lit(1).cast("long").alias("open"))
    return pairs.join(left, ["rid", "value"], "full_outer").fillna(0, ["pairs", "open"]).select("value", "rid", "pairs", "open")


@query(
    f"""WITH {NESTED}, c AS (SELECT *, CASE WHEN k % 3 = 0 AND fid = 'second' THEN 0 ELSE 1 END AS label, row_number() OVER (PARTITION BY pid, rid, tid ORDER BY k DESC, i0 DESC) AS r FROM sp),
w AS (SELECT *, r <= 4 AS win, depth = 1 AND k % 3 = 0 AS held FROM c)
SELECT count(*) FILTER (NOT win AND label <> 0 AND NOT held)::BIGINT AS n_purged, count(*) FILTER (NOT win AND label <> 0 AND held)::BIGINT AS n_kept_protected, 0::BIGINT AS n_kept_incomplete,
count(*) FILTER (win)::BIGINT AS n_kept_window, count(*) FILTER (NOT win AND label = 0)::BIGINT AS n_kept_unlabelled FROM w"""
)
def retention_counts(spark, sf_dir):
    """Which calls go when state is cleared: calls without a label hold the calls around them."""
    c = nested_calls(spark, sf_dir)
    c = c.withColumn("label", F.when((F.floor(F.col("entry") / 1000) % 3 == 0) & (F.col("fid") == "second"), 0).otherwise(1))
    return C.retention_report(C.retention(c, 4))


@query(f"WITH {NESTED} SELECT rid, tid, count(*) AS calls, 0::BIGINT AS open FROM sp GROUP BY ALL")
def call_list_sizes(spark, sf_dir):
    return C.list_sizes(nested_calls(spark, sf_dir)).select("rid", "tid", "calls", "open")


@query(
    f"""WITH {NESTED}, {NESTED_POINTS}, b AS (SELECT * FROM sp WHERE fid = 'second' AND k % 50 = 0),
m AS (SELECT ms.k, arg_min(sp.i0, sp.i1) AS i0, ms.ts FROM ms JOIN sp ON sp.k = ms.k AND ms.ts BETWEEN sp.entry AND sp.exit GROUP BY ms.k, ms.ts, ms.idx),
r AS (SELECT sp.*, row_number() OVER (PARTITION BY pid, rid, tid ORDER BY k, i0) AS seq FROM sp)
SELECT b.rid, b.tid, b.entry, b.stack, count(DISTINCT r.seq) AS calls, count(m.ts) AS messages, 'node' || b.rid AS hostname FROM r x JOIN b ON b.k = x.k AND b.i0 = x.i0
JOIN r ON r.pid = x.pid AND r.rid = x.rid AND r.tid = x.tid AND r.seq BETWEEN x.seq - 2 AND x.seq + 2 LEFT JOIN m ON m.k = r.k AND m.i0 = r.i0 GROUP BY ALL"""
)
def anomaly_records(spark, sf_dir):
    """Whole records: stack, calls and messages around the call, counters, host name, node state, parameters."""
    c = nested_calls(spark, sf_dir, stack=True)
    k = F.floor(F.col("entry") / 1000)
    c = c.withColumn("label", F.when((F.col("fid") == "second") & (k % 50 == 0), -1).otherwise(1)).withColumn("score", F.lit(1.0))
    sent, counted = nested_points(spark, sf_dir)
    ranks = c.select("pid", "rid").distinct()
    held = session.materialize(P.members(c, 2), "members")
    host = P.hostnames(ranks.withColumn("tid", F.lit(0)).withColumn("descr", F.lit("Hostname")).withColumn("value", F.concat(F.lit("node"), "rid")))
    state = ranks.withColumn("field", F.lit("memory")).withColumn("value", F.lit(1))
    params = spark.createDataFrame([("second", 6.0)], "fid string, sigma double")
    rec = P.records(c, C.attached(counted, c, wanted=held), C.attached(sent, c, wanted=held), window=2, stacks=c, hostname=host, state=state, params=params)
    return rec.select("rid", "tid", "entry", F.array_join("stack", "<").alias("stack"), F.size("exec_window").cast("long").alias("calls"), F.size("comm_window").cast("long").alias("messages"), "hostname")


# -- sources and filters


@query("SELECT CASE WHEN user_id % 7 > 4 THEN 'pid' WHEN user_id % 11 = 0 THEN 'tid' WHEN event_id % 13 = 0 THEN 'ts' WHEN user_id % 7 <> 1 THEN 'program' ELSE 'rank' END AS reason, count(*) AS n FROM events WHERE user_id % 7 > 4 OR user_id % 11 = 0 OR event_id % 13 = 0 OR user_id % 7 <> 1 OR user_id % 4 <> 2 GROUP BY 1")
def reject_reasons(spark, sf_dir):
    e = execs(spark, sf_dir).withColumn("pid", F.when(F.col("tid") % 7 > 4, 5_000_000).otherwise(F.col("tid") % 7)).withColumn("ts", F.when(F.col("id") % 13 == 0, -1).otherwise(F.col("entry")))
    e = e.withColumn("tid", F.when(F.col("tid") % 11 == 0, 2_000_000).otherwise(F.col("tid")))
    return trace.rejects(e, pid=1, rid=2)


@query("SELECT CASE WHEN event_id % 4 = 3 THEN 'UnknownEvent' WHEN user_id % 6 > 2 THEN 'UnknownFunc' ELSE 'OK' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def event_outcomes(spark, sf_dir):
    """Events by whether their type and function are known; none is dropped."""
    e = execs(spark, sf_dir).select((F.col("id") % 4).alias("eid"), (F.col("tid") % 6).alias("fid"))
    kinds = spark.createDataFrame([(0, "ENTRY"), (1, "EXIT"), (2, "ENTRY"), (3, "OTHER")], "id long, name string")
    names = spark.createDataFrame([(0, "f"), (1, "g"), (2, "h")], "id long, name string")
    return trace.typed(e, kinds, names).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {CT} SELECT counter, count(*) AS n FROM ct WHERE counter NOT IN ('click', 'view') GROUP BY 1")
def unwatched_counters(spark, sf_dir):
    """Counters that give the node state don't belong to calls."""
    watch = spark.createDataFrame([("click", "click"), ("view", "view")], "counter string, field string")
    return trace.unwatched(counters(spark, sf_dir), watch).groupBy("counter").agg(F.count("*").alias("n"))


@query(f"WITH {CT} SELECT counter, step, count(*) AS n, round(avg(value), 6) AS mean FROM ct WHERE counter IN ('click', 'error') GROUP BY ALL")
def counter_subset(spark, sf_dir):
    s = S.counter_stats(S.counter_subset(counters(spark, sf_dir), ["click", "error"]), ["counter", "step"])
    return s.select("counter", "step", F.col("stats.count").alias("n"), _r("stats.mean", "mean"))


@query(f"WITH {EX} SELECT (step // 7)::BIGINT AS batch, func, count(*) AS n, round(avg(exclusive), 6) AS mean FROM ex GROUP BY ALL")
def gated_batches(spark, sf_dir):
    """Steps that are analysed seven at a time."""
    return trace.analysis_batches(execs(spark, sf_dir), 7).groupBy("batch", "func").agg(F.count("*").alias("n"), _r(F.avg("exclusive"), "mean"))


@query(f"WITH {EX}, f AS (SELECT min(step) AS lo FROM ex) SELECT step, count(*) AS n FROM ex, f WHERE step < lo + 5 GROUP BY step")
def first_frames(spark, sf_dir):
    """The first five steps of a trace, a feature of the reader."""
    e = execs(spark, sf_dir)
    numbered = e.join(F.broadcast(e.agg(F.min("step").alias("lo")))).withColumn("day", F.col("step")).withColumn("step", F.col("step") - F.col("lo"))
    return trace.frames(numbered, 5).groupBy(F.col("day").alias("step")).agg(F.count("*").alias("n"))


@query("SELECT 'event_id' AS name, count(event_id) AS n, min(event_id::VARCHAR) AS low, max(event_id::VARCHAR) AS high FROM events UNION ALL SELECT 'event_type', count(event_type), min(event_type), max(event_type) FROM events")
def source_variables(spark, sf_dir):
    return trace.described(table(spark, sf_dir, "events").select("event_id", "event_type")).select("name", "n", "low", "high")


@query(f"WITH {EX} SELECT func, round(exclusive, 4) AS exclusive, count(*) AS n FROM ex GROUP BY ALL")
def runtime_dump(spark, sf_dir):
    d = trace.runtimes(execs(spark, sf_dir))
    return d.groupBy("func", F.round("exclusive", 4).alias("exclusive")).agg(F.count("*").alias("n"))


@query(f"WITH {CT} SELECT counter, count(*) AS n FROM ct GROUP BY 1")
def named_counters(spark, sf_dir):
    """Counters by the names of their ids; an unknown id would be an error."""
    kinds = counters(spark, sf_dir).select(F.col("counter").alias("name")).distinct()
    dim = kinds.withColumn("id", F.xxhash64("name"))
    e = counters(spark, sf_dir).withColumn("counter_id", F.xxhash64("counter")).drop("counter")
    return trace.named_counters(e, dim).groupBy("counter").agg(F.count("*").alias("n"))


@query(f"WITH {EX} SELECT rid, step, count(*) AS n FROM ex WHERE (step + rid) % 4 = 0 OR step = (SELECT max(step) FROM ex) GROUP BY ALL")
def flush_policy(spark, sf_dir):
    """What ranks send that take turns; all send in the last step."""
    e = execs(spark, sf_dir)
    last = e.agg(F.max("step")).first()[0]
    return sinks.sent(e, 4, last).groupBy("rid", "step").agg(F.count("*").alias("n"))


# -- statistics


@query(f"WITH {EX}, m AS (SELECT func, count(*) AS n, sum(exclusive) / (count(*) - 1) AS mean FROM ex GROUP BY func) SELECT func, round(any_value(mean), 6) AS mean, round(sqrt(sum(pow(exclusive - mean, 2)) / (any_value(n) - 1)), 6) AS std FROM ex JOIN m USING (func) GROUP BY func")
def static_moments(spark, sf_dir):
    return R.static_std(execs(spark, sf_dir), ["func"], "exclusive", 1).select("func", _r("mean", "mean"), _r("std", "std"))


@query(f"WITH {EX} SELECT func, true AS same, true AS exact FROM ex GROUP BY func")
def runstats_equality(spark, sf_dir):
    """Statistics of merged steps equal those of the whole within tolerances, and themselves exactly."""
    e = execs(spark, sf_dir)
    whole = e.groupBy("func").agg(F.struct(*R.aggregates("exclusive")).alias("a"))
    parts = R.merge(R.collect(e, ["func", "step"], "exclusive"), ["func"]).select("func", F.struct(*R.report()).alias("b"))
    return whole.join(parts, "func").select("func", R.alike("a", "b").alias("same"), R.alike("a", "a", None).alias("exact"))


@query(f"WITH {_LAB}, s AS (SELECT rid, step, count(*) FILTER (label = -1) AS n FROM lab GROUP BY ALL), c AS (SELECT (min(step) + max(step)) // 2 AS c FROM s) SELECT rid, count(*) AS steps, round(avg(n), 6) AS mean, max(n)::DOUBLE AS most, count(*) FILTER (step > c) AS packets, coalesce(sum(n) FILTER (step > c), 0)::BIGINT AS new FROM s, c GROUP BY rid")
def rank_anomaly_packets(spark, sf_dir):
    """Anomalies per step of each rank, and the packets that weren't sent yet."""
    e = _labelled(spark, sf_dir)
    last = execs(spark, sf_dir).agg(F.floor((F.min("step") + F.max("step")) / 2)).first()[0]
    a = S.global_anomalies(e, last)[0]
    return a.select("rid", F.col("anomaly_count.count").alias("steps"), _r("anomaly_count.mean", "mean"), F.col("anomaly_count.maximum").alias("most"), F.size("packets").cast("long").alias("packets"), F.aggregate("packets", F.lit(0).cast("long"), lambda x, p: x + p["n_anomalies"]).alias("new"))


@query(f"WITH {CT} SELECT counter, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM ct GROUP BY counter")
def global_counter_stats(spark, sf_dir):
    """Counters' statistics merged over ranks and steps."""
    sent = R.collect(counters(spark, sf_dir), ["pid", "rid", "counter", "step"], "value")
    g = S.global_counters(sent)
    return g.select("counter", F.col("stats.count").alias("n"), _r("stats.mean", "mean"), _r("stats.stddev", "sd"), F.col("stats.minimum").alias("lo"), F.col("stats.maximum").alias("hi"))


@query(f"WITH {_LAB}, b AS (SELECT * FROM lab WHERE label = -1), c AS (SELECT (min(step) + max(step)) // 2 AS c FROM ex) SELECT rid, func, count(*) FILTER (step > c) AS new, count(*) AS known, round(sum(exclusive) FILTER (step > c), 6) AS new_severity, round(sum(exclusive), 6) AS severity FROM b, c GROUP BY rid, func HAVING count(*) FILTER (step > c) > 0")
def recent_metrics(spark, sf_dir):
    """What is new since the last emission beside all that there is."""
    last = execs(spark, sf_dir).agg(F.floor((F.min("step") + F.max("step")) / 2)).first()[0]
    m = S.recent_metrics(_labelled(spark, sf_dir), last)
    n = lambda c: F.col(f"{c}.score.count")
    return m.select("rid", "func", n("new_data").alias("new"), n("all_data").alias("known"), _r("new_data.severity.accumulate", "new_severity"), _r("all_data.severity.accumulate", "severity"))


@query(f"WITH {_LAB}, d AS (SELECT event_type AS func, min(event_id) AS first FROM events GROUP BY 1), i AS (SELECT func, row_number() OVER (ORDER BY first) - 1 AS fid FROM d) SELECT fid, func AS name, count(*) AS calls, round(avg(exclusive), 6) AS mean, nullif(count(*) FILTER (label = -1), 0) AS n FROM lab JOIN i USING (func) GROUP BY ALL")
def profile_documents(spark, sf_dir):
    """A document for each function, with the index that its name was given."""
    e = _labelled(spark, sf_dir)
    seen = e.groupBy("pid", F.col("func").alias("name")).agg(F.min("id").alias("first"))
    names = N.assign(spark.createDataFrame([], "pid long, name string, fid long"), seen)
    d = S.profile_documents(S.function_profile(e, ["pid", "func"]), S.anomaly_metrics(e, ["pid", "func"]), names)
    return d.select("fid", "name", F.col("runtime_profile.exclusive.count").alias("calls"), _r("runtime_profile.exclusive.mean", "mean"), F.col("anomaly_metrics.n").alias("n"))


@query(f"WITH {_LAB}, n AS (SELECT func, step, arg_min(id, (score, id)) AS id FROM lab WHERE label = 1 GROUP BY ALL) SELECT id, func, step, label FROM lab WHERE label = -1 UNION ALL SELECT id, func, step, 1 FROM n")
def recorded_events(spark, sf_dir):
    """All outliers of a data set, and its normal execution of least score."""
    return S.data_sets(_labelled(spark, sf_dir))[0].select("id", "func", "step", "label")


@query(f"WITH {_LAB} SELECT func, step, count(*) FILTER (label = 1) AS n_normal, count(*) FILTER (label = -1) AS n_outlier, count(*) FILTER (label = -1) + (count(*) FILTER (label = 1) > 0)::INT AS n_recorded FROM lab GROUP BY ALL")
def event_counts(spark, sf_dir):
    return S.data_sets(_labelled(spark, sf_dir))[1].select("func", "step", "n_normal", "n_outlier", "n_recorded")


@query(f"WITH {_LAB}, f AS (SELECT rid, step, count(DISTINCT func) AS funcs, count(DISTINCT func) FILTER (label = -1) AS bad FROM lab GROUP BY ALL), {CT}, c AS (SELECT rid, step, count(DISTINCT counter) AS counters FROM ct WHERE value > 50 GROUP BY ALL) SELECT rid, step, funcs, coalesce(counters, 0) AS counters, bad FROM f FULL JOIN c USING (rid, step)")
def combined_packets(spark, sf_dir):
    """What a rank sends for a step, in one row."""
    e, k = _labelled(spark, sf_dir), ["pid", "rid", "step"]
    f = e.groupBy(*k, "func").agg(F.count("*").alias("n"))
    c = counters(spark, sf_dir).where("value > 50").groupBy(*k, "counter").agg(F.count("*").alias("n"))
    m = S.anomaly_metrics(e, [*k, "func"]).select(*k, "func", "n")
    size = lambda x: F.coalesce(F.size(F.col(x)), F.lit(0)).cast("long").alias({"func": "funcs", "counter": "counters", "metrics": "bad"}[x])
    return S.combined_packets(f, c, m).select("rid", "step", *(F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long").alias(n) for x, n in (("func", "funcs"), ("counter", "counters"), ("metrics", "bad"))))


@query(f"WITH {_LAB}, r AS (SELECT rid, (max(exit) - min(entry)) / 1e6 AS s, count(*) FILTER (label = -1) AS n, count(DISTINCT step) AS k FROM lab GROUP BY rid) SELECT round(sum(s), 6) AS seconds, sum(n)::BIGINT AS n_outliers, sum(k)::BIGINT AS n_steps, count(*) AS n_ranks FROM r")
def run_report(spark, sf_dir):
    return S.run_report(S.rank_report(_labelled(spark, sf_dir))).select(_r("seconds", "seconds"), "n_outliers", "n_steps", "n_ranks")


@query(
    f"""WITH {_LAB}, c AS (SELECT func, rid, step, count(*) AS n FROM lab WHERE label = -1 GROUP BY ALL), m AS (SELECT func, sum(n) AS n FROM c GROUP BY func)
SELECT func AS name, m.n::BIGINT AS anom_count, round(sum(exclusive) FILTER (label = -1), 4) AS accum_sev, count(*) AS exec_count, round(any_value(m.n) / count(*), 6) AS anom_freq, round(sum(exclusive) / 1e6, 6) AS tot_runtime_excl, round(avg(runtime) / 1e3, 6) AS avg_runtime_incl
FROM lab JOIN m USING (func) GROUP BY func, m.n"""
)
def function_ranking(spark, sf_dir):
    """The columns of the ranking of functions."""
    e = _labelled(spark, sf_dir)
    p = S.aggregate_profile(e, ["pid", "func"]).join(S.rolled_metrics(e, ["pid", "func"]).select("pid", "func", "count", "severity"), ["pid", "func"])
    r = D.function_ranking(p.withColumn("fid", F.lit(0)).withColumnRenamed("func", "name"))
    r = D.ranking(r, "accum_sev", -1)
    return r.select("name", "anom_count", F.round("accum_sev", 4).alias("accum_sev"), "exec_count", _r("anom_freq", "anom_freq"), _r("tot_runtime_excl", "tot_runtime_excl"), _r("avg_runtime_incl", "avg_runtime_incl"))


@query(f"WITH {CT} SELECT counter, count(*) AS count, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, round(avg(value), 6) AS avg FROM ct GROUP BY counter")
def counter_ranking(spark, sf_dir):
    g = S.global_counters(R.collect(counters(spark, sf_dir), ["pid", "rid", "counter", "step"], "value"))
    return D.ranking(D.counter_ranking(g), "avg", -1).select("counter", "count", "min", "max", _r("avg", "avg"))


_RUNS = f"""{EX}, run AS (SELECT func, tid, id % 2 AS run, count(*) AS calls, sum(exclusive) AS total, count(*) FILTER (exclusive > 100) AS n, coalesce(sum(exclusive) FILTER (exclusive > 100), 0) AS severity FROM ex GROUP BY ALL)"""


@query(
    f"""WITH {_RUNS}, a AS (SELECT * FROM run WHERE run = 0), b AS (SELECT * FROM run WHERE run = 1)
SELECT func, tid, round(a.severity, 4) AS severity_a, round(b.severity, 4) AS severity_b, a.n AS count_a, b.n AS count_b, round(100 * a.n / a.calls, 4) AS frequency_a, round(100 * b.n / b.calls, 4) AS frequency_b, round(a.severity / a.total, 4) AS relative_a, round(b.severity / b.total, 4) AS relative_b
FROM a FULL JOIN b USING (func, tid) ORDER BY greatest(a.severity, b.severity) DESC NULLS LAST, func, tid LIMIT 10"""
)
def between_runs_shared(spark, sf_dir):
    """Two runs that share functions: severities, counts, frequencies and times of the ten that differ most."""
    bad = F.when(F.col("exclusive") > 100, F.col("exclusive"))
    s = execs(spark, sf_dir).withColumn("run", F.col("id") % 2).groupBy("func", "tid", "run").agg(F.count("*").alias("calls"), F.sum("exclusive").alias("total"), F.count(bad).alias("count"), F.coalesce(F.round(F.sum(bad), 9), F.lit(0.0)).alias("severity"))  # equal sums tie, in whatever order they were added up
    d = D.between_runs(s.where("run = 0").drop("run"), s.where("run = 1").drop("run"), ["func", "tid"], "severity")
    r = lambda c: F.round(c, 4).alias(c)
    return d.select("func", "tid", r("severity_a"), r("severity_b"), "count_a", "count_b", r("frequency_a"), r("frequency_b"), r("relative_a"), r("relative_b"))


# -- models


@query(f"WITH {EX}, k AS (SELECT *, row_number() OVER (PARTITION BY pid, rid, tid, func ORDER BY exit, id) = 1 OR func = 'view' AS skip FROM ex), m AS (SELECT func, count(*) AS n, avg(exclusive) AS mean, stddev_samp(exclusive) AS sd FROM k WHERE NOT skip GROUP BY func) SELECT id, CASE WHEN skip THEN 1 WHEN n < 2 THEN 0 WHEN abs(exclusive - mean) > 3 * sd THEN -1 ELSE 1 END AS label FROM k LEFT JOIN m USING (func)")
def labels_without_first_calls(spark, sf_dir):
    """First calls, by the order in which they end, and ignored functions are normal and not learnt from."""
    e = execs(spark, sf_dir).withColumn("o", F.struct("exit", "id"))
    return M.labelled(M.first_calls_ignored(e, ["pid", "rid", "tid", "func"], "o"), ["func"], "exclusive", 3.0, ["view"]).select("id", "label")


@query(f"WITH {_LAB}, m AS (SELECT func, count(*) AS n, avg(exclusive) AS mean, stddev_samp(exclusive) AS sd FROM ex WHERE rid = 1 GROUP BY func), s AS (SELECT lab.id, func, label, abs(exclusive - m.mean) / m.sd AS z FROM lab JOIN m USING (func)) SELECT id, 'anomalies' AS stored, round(z, 6) AS score FROM s WHERE label = -1 AND z > 4 UNION ALL SELECT id, 'normalexecs', round(z, 6) FROM s WHERE label = 1 AND id % 10 = 0 AND z <= 4")
def prune_both(spark, sf_dir):
    """Anomalies that a final model finds normal go, and normal examples that it finds anomalous."""
    e = _labelled(spark, sf_dir).drop("n", "mean", "sd")
    bad, good = M.pruned(e.where("label = -1"), e.where("label = 1 AND id % 10 = 0"), M.sstd_model(execs(spark, sf_dir).where("rid = 1"), ["func"], "exclusive"), ["func"], "exclusive", 4.0)
    pick = lambda df, name: df.select("id", F.lit(name).alias("stored"), _r("score", "score"))
    return pick(bad, "anomalies").unionByName(pick(good, "normalexecs"))


@query(f"WITH {_LAB}, b AS (SELECT * FROM lab WHERE label = -1 AND exclusive > 200), c AS (SELECT func, avg(n) AS mean, max(n)::DOUBLE AS most FROM (SELECT func, rid, step, count(*) AS n FROM b GROUP BY ALL) GROUP BY func), a AS (SELECT func, min(step) AS first_step, max(step) AS last_step, round(avg(score), 6) AS score, round(sum(exclusive), 6) AS severity FROM b GROUP BY func) SELECT func, calls, first_step, last_step, score, severity, round(mean, 6) AS mean, most FROM (SELECT func, count(*) AS calls FROM ex GROUP BY func) LEFT JOIN a USING (func) LEFT JOIN c USING (func)")
def prune_statistics(spark, sf_dir):
    """Function statistics with the metrics of the records that a prune leaves."""
    e = _labelled(spark, sf_dir)
    s = D.with_pruned_stats(execs(spark, sf_dir).groupBy("func").agg(F.count("*").alias("calls")), e.where("label = -1 AND exclusive > 200"))
    m = "anomaly_metrics"
    return s.select("func", "calls", f"{m}.first_step", f"{m}.last_step", _r(f"{m}.score.mean", "score"), _r(f"{m}.severity.accumulate", "severity"), _r(f"{m}.count.mean", "mean"), F.col(f"{m}.count.maximum").alias("most"))


@query(
    f"""WITH RECURSIVE {_LAB}, n AS (SELECT tid, rid, func, step, arg_min(id, (score, id)) AS normal FROM lab WHERE label = 1 GROUP BY ALL),
a AS (SELECT rid, func, step, arg_min(tid, (entry, id)) AS tid, true AS asked FROM lab WHERE label = -1 GROUP BY ALL),
r AS (SELECT tid, rid, func, step, normal, coalesce(asked, false) AS asked, row_number() OVER (PARTITION BY tid, rid, func ORDER BY step) AS i FROM n FULL JOIN a USING (tid, rid, func, step)),
w AS (SELECT tid, rid, func, step, i, CASE WHEN asked THEN normal END AS given, CASE WHEN NOT asked THEN normal END AS cache, normal IS NULL AND asked AS waiting FROM r WHERE i = 1
  UNION ALL SELECT r.tid, r.rid, r.func, r.step, r.i, CASE WHEN w.waiting OR r.asked THEN coalesce(r.normal, w.cache) END, CASE WHEN NOT (w.waiting OR r.asked) THEN coalesce(r.normal, w.cache) END,
    CASE WHEN coalesce(r.normal, w.cache) IS NULL THEN w.waiting OR r.asked ELSE w.waiting AND r.asked END FROM r JOIN w ON r.tid = w.tid AND r.rid = w.rid AND r.func = w.func AND r.i = w.i + 1)
SELECT tid, func, step, given AS example FROM w WHERE given IS NOT NULL"""
)
def normal_examples(spark, sf_dir):
    """Outliers' normal executions: kept from step to step, used up, or waited for."""
    return P.normal_examples(_labelled(spark, sf_dir)).select("tid", "func", "step", "example")


@query(f"WITH {_LAB} SELECT step, CASE WHEN label = -1 THEN CASE WHEN exclusive > 150 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN exclusive > 150 THEN 'FN' ELSE 'TN' END END AS kind, count(*) AS n FROM (SELECT ex.*, CASE WHEN n < 2 THEN 0 WHEN abs(exclusive - mean) > 4 * sd THEN -1 ELSE 1 END AS label FROM ex JOIN (SELECT func, step, n, s1 / n AS mean, sqrt(greatest(0, (s2 - s1 * s1 / n) / nullif(n - 1, 0))) AS sd FROM (SELECT func, step, sum(k) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM (SELECT func, step, count(*) AS k, sum(exclusive) AS s1, sum(exclusive * exclusive) AS s2 FROM ex GROUP BY func, step) WINDOW w AS (PARTITION BY func ORDER BY step ROWS UNBOUNDED PRECEDING))) m USING (func, step)) GROUP BY ALL")
def batch_evaluation(spark, sf_dir):
    """Labels against truth, batch by batch."""
    e = execs(spark, sf_dir).withColumn("truth", F.col("exclusive") > 150)
    return M.evaluated(e, ["func"], "exclusive", "truth", "step", M.Params("sstd", sstd_sigma=4.0))


#: SQL that shares out whole counts of source bins (func, side, l, u, c) on a grid (func, start, width, nbin).
_SHARE = """put AS (
  SELECT func, side, u, l, c, start, width, nbin, least(greatest(floor((l - start) / width)::INT - 1, 0), nbin - 1) AS k, 0::DOUBLE AS given, false AS used FROM src JOIN tgt USING (func)
  UNION ALL
  SELECT func, side, u, CASE WHEN e <= l THEN l ELSE e END, CASE WHEN e <= l THEN c WHEN last THEN 0 ELSE rest END, start, width, nbin, k + 1, CASE WHEN e <= l AND NOT last THEN 0 WHEN last THEN c ELSE own END, last FROM (
    SELECT *, CASE WHEN 1 - f > f THEN floor(f * c + 0.5) ELSE c - floor((1 - f) * c + 0.5) END AS own, CASE WHEN 1 - f > f THEN c - floor(f * c + 0.5) ELSE floor((1 - f) * c + 0.5) END AS rest FROM (
      SELECT *, start + (k + 1) * width AS e, k = nbin - 1 OR start + (k + 1) * width >= u AS last, (start + (k + 1) * width - l) / (u - l) AS f FROM put WHERE NOT used))),
parts AS (SELECT func, side, k - 1 AS bin, sum(given)::BIGINT AS n FROM put WHERE given > 0 GROUP BY ALL)"""

_TWO = f"""{EX}, one AS (SELECT *, rid // 2 AS side FROM ex), span AS (SELECT func, side, min(exclusive) AS lo, max(exclusive) AS hi, (max(exclusive) - min(exclusive)) / (200 - 1e-6 - 0.001) AS raw FROM one GROUP BY ALL),
grid AS (SELECT *, lo - 1e-6 * raw AS start, ceil((hi - (lo - 1e-6 * raw)) / raw)::INT AS nbin FROM span), grd AS (SELECT *, (hi - start) / nbin AS width FROM grid),
b0 AS (SELECT one.*, start, width, nbin, lo, hi, ceil((exclusive - start) / width)::INT - 1 AS b FROM one JOIN grd USING (func, side)),
bn AS (SELECT *, least(greatest(CASE WHEN exclusive <= start + b * width THEN b - 1 ELSE b END, 0), nbin - 1) AS bin FROM b0),
src AS (SELECT func, side, any_value(start) + bin * any_value(width) AS l, CASE WHEN bin = any_value(nbin) - 1 THEN any_value(hi) ELSE any_value(start) + (bin + 1) * any_value(width) END AS u, count(*)::DOUBLE AS c FROM bn GROUP BY func, side, bin)"""


def _two(spark, sf_dir):
    """The histograms of two runs, by function: a row each."""
    e = execs(spark, sf_dir).withColumn("side", F.floor(F.col("rid") / 2))
    return H.packed(H.per_group(e, ["func", "side"], "exclusive"), ["func", "side"])


@query(
    f"""WITH RECURSIVE {_TWO}, rng AS (SELECT func, min(lo) AS lo, max(hi) AS hi, (max(hi) - min(lo)) / (200 - 1e-6 - 0.001) AS raw FROM grd GROUP BY func),
t0 AS (SELECT *, lo - 1e-6 * raw AS start FROM rng), tgt AS (SELECT func, start, ceil((hi - start) / raw)::INT AS nbin, (hi - start) / ceil((hi - start) / raw)::INT AS width FROM t0), {_SHARE}
SELECT func, bin::BIGINT AS bin, sum(n)::BIGINT AS n FROM parts GROUP BY ALL"""
)
def histogram_merge(spark, sf_dir):
    """Two runs' histograms on one grid, bin by bin; counts stay whole."""
    import pandas as pd

    def fold(g):
        a, b = (H.unpacked(r) for _, r in g.sort_values("side").iterrows())
        m = a.merged(b, H.width_count(200))
        k = m.counts.nonzero()[0]
        return pd.DataFrame({"func": g["func"].iloc[0], "bin": k, "n": m.counts[k]})

    return _two(spark, sf_dir).groupBy("func").applyInPandas(fold, "func string, bin long, n long")


@query(
    f"""WITH RECURSIVE {_TWO}, g AS (SELECT func, min(start) AS start, max(hi) AS hi, min(width) AS raw FROM grd GROUP BY func), tgt AS (SELECT func, start, ceil((hi - start) / raw)::INT AS nbin, (hi - start) / ceil((hi - start) / raw)::INT AS width FROM g), {_SHARE}
SELECT func, bin::BIGINT AS bin, (coalesce(sum(n) FILTER (side = 0), 0) - coalesce(sum(n) FILTER (side = 1), 0))::BIGINT AS change FROM parts GROUP BY ALL HAVING change <> 0"""
)
def histogram_diff(spark, sf_dir):
    """The first run's histogram less the second's, bin by bin on a common grid."""
    import pandas as pd

    def diff(g):
        a, b = (H.unpacked(r) for _, r in g.sort_values("side").iterrows())
        change = H.difference(a, b)[1]
        k = change.nonzero()[0]
        return pd.DataFrame({"func": g["func"].iloc[0], "bin": k, "change": change[k]})

    return _two(spark, sf_dir).groupBy("func").applyInPandas(diff, "func string, bin long, change long")


@query(f"WITH {_HIST}, a AS (SELECT func, nbin, list(n ORDER BY bin) AS n FROM hist GROUP BY ALL) SELECT func, sum(n)::BIGINT AS total, max(n) AS fullest, any_value(nbin)::BIGINT AS bins FROM hist GROUP BY func")
def stored_models(spark, sf_dir):
    """Models as JSON text, read back."""
    m = M.model_table(execs(spark, sf_dir), "func", "exclusive", M.Params("hbos"))
    c = F.from_json(F.get_json_object("model", "$['Bin Counts']"), "array<bigint>")
    return m.select("func", F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(c).alias("fullest"), F.size(c).cast("long").alias("bins"))


# -- scalars


@query("SELECT event_id, (user_id % 4)::VARCHAR || ':' || (event_id % 10)::VARCHAR || ':' || event_id::VARCHAR AS id, (5000 + user_id % 3)::INT AS port, strftime(ts, '%Y/%m/%d %H:%M:%S') AS date, (props::JSON->>'k') AS k, NULL::VARCHAR AS missing, event_id AS part FROM events")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("rank", F.col("user_id") % 4).withColumn("step", F.col("event_id") % 10)
    e = e.withColumn("id", X.event_id("rank", "step", "event_id")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", "id", X.port_of("user_id", 3, 5000).alias("port"), X.date_time("us").alias("date"), X.json_at("props", "k").alias("k"), X.json_at("props", "none", "x").alias("missing"), X.id_parts("id")[2].alias("part"))


@query("SELECT user_id % 4 AS rid, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def map_sums(spark, sf_dir):
    """Counts in maps, added up key by key over two halves."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rid"), (F.col("event_id") % 2).alias("half"), "event_type")
    each = e.groupBy("rid", "half", "event_type").agg(F.count("*").alias("n")).groupBy("rid", "half").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    a, b = (each.where(F.col("half") == h).select("rid", F.col("m").alias(n)) for h, n in ((0, "a"), (1, "b")))
    both = a.join(b, "rid", "full_outer").select("rid", X.plus(F.coalesce("a", F.create_map().cast("map<string,bigint>")), F.coalesce("b", F.create_map().cast("map<string,bigint>"))).alias("m"))
    return both.select("rid", *(F.coalesce(X.lookup(F.col("m"), k), F.lit(0)).alias(k) for k in ("click", "view")))


@query(f"WITH {EX} SELECT rid, count(*) AS n, (rid * 2 + 1)::BIGINT AS shard FROM ex GROUP BY rid")
def shard_assignment(spark, sf_dir):
    """Documents by a file that assigns ranks to shards."""
    shards = spark.createDataFrame([(r, r * 2 + 1) for r in range(4)], "rank long, shard long")
    return D.assigned(execs(spark, sf_dir), shards).groupBy("rid", "shard").agg(F.count("*").alias("n")).select("rid", "n", "shard")
