"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.functions import histogram as H
from tracelens.functions import runstats as R
from tracelens.operators import calltree as C
from tracelens.operators import collections as D
from tracelens.operators import dictionary as N
from tracelens.operators import models as M
from tracelens.operators import provenance as P
from tracelens.operators import stats as S
from tracelens.plans.frames import CT, EX, POINTS, SPANS, calls, counters, execs, points, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _figures(struct: str, prefix: str = ""):
    return [(F.col(f"{struct}.{n}") if n == "count" else _r(f"{struct}.{n}") + 0.0).alias(prefix + n) for n in R.FIELDS]  # + 0.0: no negative zeros


def _moments(source: str, keys: str, x: str, prefix: str = "") -> str:
    """SQL of the eight figures, by sums around the group's mean."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"m.{c} = s.{c}" for c in k)
    p = prefix
    return f"""SELECT {", ".join(f"m.{c}" for c in k)}, n AS "{p}count", round(total, 6) AS {p}accumulate, round(lo, 6) AS {p}minimum, round(hi, 6) AS {p}maximum, round(mu, 6) AS {p}mean,
  round(CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) ELSE 0 END, 6) AS {p}stddev,
  round(CASE WHEN m2 < 1e-7 THEN 0 ELSE sqrt(n) * m3 / pow(m2, 1.5) END, 6) + 0.0 AS {p}skewness,
  round(CASE WHEN m2 < 1e-7 THEN 0 ELSE n * m4 / (m2 * m2) - 3 END, 6) + 0.0 AS {p}kurtosis
FROM (SELECT {", ".join(f"s.{c}" for c in k)}, any_value(n) AS n, any_value(total) AS total, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mu) AS mu,
    sum(pow({x} - mu, 2)) AS m2, sum(pow({x} - mu, 3)) AS m3, sum(pow({x} - mu, 4)) AS m4
  FROM {source} s JOIN (SELECT {keys}, count({x}) AS n, sum({x})::DOUBLE AS total, min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, avg({x}) AS mu FROM {source} GROUP BY {keys}) m ON {on}
  GROUP BY {", ".join(f"s.{c}" for c in k)}) m"""


# -- run statistics and profiles


@query(f"WITH {EX} {_moments('ex', 'func', 'exclusive')}")
def runstats_by_function(spark, sf_dir):
    return execs(spark, sf_dir).groupBy("func").agg(F.struct(*R.aggregates("exclusive")).alias("s")).select("func", *_figures("s"))


@query(f"WITH {EX} {_moments('ex', 'func, step', 'exclusive')}")
def runstats_by_function_step(spark, sf_dir):
    return execs(spark, sf_dir).groupBy("func", "step").agg(F.struct(*R.aggregates("exclusive")).alias("s")).select("func", "step", *_figures("s"))


@query(f"WITH {EX} {_moments('ex', 'func', 'exclusive')}")
def runstats_merged(spark, sf_dir):
    """States per step, stored and merged per function."""
    states = R.collect(execs(spark, sf_dir), ["func", "step"], "exclusive")
    return R.merge(states, ["func"]).select("func", F.struct(*R.report()).alias("s")).select("func", *_figures("s"))


@query(
    f"""WITH {EX} SELECT func, step, n_anomaly, inc."count" AS inclusive_count, inclusive_mean, exclusive_mean, exclusive_stddev, first, last FROM
(SELECT func, step, count(*) AS "count", count(*) FILTER (exclusive > 150) AS n_anomaly, round(avg(runtime), 6) AS inclusive_mean, round(avg(exclusive), 6) AS exclusive_mean,
  round(coalesce(stddev_samp(exclusive), 0), 6) AS exclusive_stddev, min(entry) AS first, max(exit) AS last FROM ex GROUP BY func, step) inc"""
)
def func_profile(spark, sf_dir):
    e = execs(spark, sf_dir).withColumn("label", F.when(F.col("exclusive") > 150, -1).otherwise(1))
    p = S.function_profile(e, ["func", "step"])
    return p.select("func", "step", "n_anomaly", F.col("inclusive.count").alias("inclusive_count"), _r("inclusive.mean", "inclusive_mean"), _r("exclusive.mean", "exclusive_mean"), _r("exclusive.stddev", "exclusive_stddev"), "first", "last")


@query(f"WITH {EX} SELECT func, round(sum(exclusive) / 1e6, 9) AS seconds, round(sum(exclusive) / (SELECT sum(exclusive) FROM ex), 6) AS share FROM ex GROUP BY func")
def func_profile_share(spark, sf_dir):
    p = execs(spark, sf_dir).groupBy("func").agg(F.struct(*R.aggregates("exclusive")).alias("exclusive"))
    return S.time_shares(p).select("func", F.round("seconds", 9).alias("seconds"), _r("share", "share"))


@query(f"WITH {CT} {_moments('ct', 'counter, step', 'value')}")
def counter_stats(spark, sf_dir):
    return S.counter_stats(counters(spark, sf_dir), ["counter", "step"]).select("counter", "step", *_figures("stats"))


def _labelled(spark, sf_dir, sigma=3.0):
    e = execs(spark, sf_dir)
    return M.sstd_label(e.join(M.sstd_model(e, ["func"], "exclusive"), "func"), "exclusive", sigma)


_LAB = f"""{EX}, lab AS (SELECT *, abs(exclusive - mean) / sd AS score, CASE WHEN abs(exclusive - mean) > 3.0 * sd THEN -1 ELSE 1 END AS label FROM
  (SELECT *, avg(exclusive) OVER (PARTITION BY func) AS mean, stddev_samp(exclusive) OVER (PARTITION BY func) AS sd FROM ex))"""


@query(f"WITH {_LAB} SELECT id, func, label, round(score, 6) AS score FROM lab")
def sstd_score(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "func", "label", _r("score", "score"))


@query(f"WITH {_LAB} SELECT id, func, tid, step, exclusive, round(abs(exclusive - mean) / sd, 6) AS score FROM lab WHERE abs(exclusive - mean) > 6.0 * sd")
def sstd_outliers(spark, sf_dir):
    return _labelled(spark, sf_dir, 6.0).where("label = -1").select("id", "func", "tid", "step", "exclusive", _r("score", "score"))


@query(
    f"""WITH {EX}, s AS (SELECT func, step, count(*) AS k, sum(exclusive) AS s1, sum(exclusive * exclusive) AS s2 FROM ex GROUP BY func, step),
r AS (SELECT func, step, sum(k) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY func ORDER BY step ROWS UNBOUNDED PRECEDING))
SELECT func, step, n::BIGINT AS n, round(s1 / n, 5) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(0, (s2 - s1 * s1 / n) / (n - 1))) ELSE 0 END, 5) AS sd FROM r"""
)
def cumulative_sstd_model(spark, sf_dir):
    m = M.sstd_steps(execs(spark, sf_dir), ["func"], "step", "exclusive")
    return m.select("func", "step", F.col("n").cast("long").alias("n"), F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query(
    f"""WITH {EX}, s AS (SELECT func, step, count(*) AS k, sum(exclusive) AS s1, sum(exclusive * exclusive) AS s2 FROM ex GROUP BY func, step),
r AS (SELECT func, step, sum(k) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY func ORDER BY step ROWS UNBOUNDED PRECEDING)),
m AS (SELECT func, step, n, s1 / n AS mean, sqrt(greatest(0, (s2 - s1 * s1 / n) / nullif(n - 1, 0))) AS sd FROM r)
SELECT id, func, ex.step, label, count(*) OVER (PARTITION BY func, ex.step)::BIGINT AS outliers FROM ex JOIN m USING (func, step),
  LATERAL (SELECT CASE WHEN n < 2 THEN 0 WHEN abs(exclusive - mean) > 4.0 * sd THEN -1 ELSE 1 END AS label) WHERE label = -1"""
)
def sstd_step_outliers(spark, sf_dir):
    """Every step is scored by the model that includes it."""
    e = execs(spark, sf_dir)
    out = M.sstd_label(e.join(M.sstd_steps(e, ["func"], "step", "exclusive"), ["func", "step"]), "exclusive", 4.0).where("label = -1")
    return out.select("id", "func", "step", "label", F.count("*").over(W.partitionBy("func", "step")).alias("outliers"))


@query(f"WITH {EX} SELECT id, tid, func, (row_number() OVER (PARTITION BY pid, rid, tid, func ORDER BY entry, id) = 1)::INT AS first FROM ex")
def ignore_first_call(spark, sf_dir):
    e = execs(spark, sf_dir).withColumn("o", F.struct("entry", "id"))
    return M.first_calls_ignored(e, ["pid", "rid", "tid", "func"], "o").select("id", "tid", "func", F.col("first").cast("int").alias("first"))


@query(
    f"""WITH {_LAB} SELECT rid, step, count(*) FILTER (label = -1) AS n_anomalies, min(entry) AS min_ts, max(exit) AS max_ts,
round(coalesce(avg(score) FILTER (label = -1), -1), 6) AS score_mean, round(coalesce(max(score) FILTER (label = -1), -1), 6) AS score_max FROM lab GROUP BY rid, step"""
)
def anomaly_data_per_step(spark, sf_dir):
    a = S.anomaly_data(_labelled(spark, sf_dir), ["rid", "step"])
    return a.select("rid", "step", "n_anomalies", "min_ts", "max_ts", _r(F.coalesce("scores.mean", F.lit(-1.0)), "score_mean"), _r(F.coalesce("scores.maximum", F.lit(-1.0)), "score_max"))


@query(f"WITH {_LAB} SELECT rid, func, step, count(*) AS n, round(avg(score), 6) AS score_mean, round(sum(exclusive), 6) AS severity_sum, round(max(exclusive), 6) AS severity_max FROM lab WHERE label = -1 GROUP BY rid, func, step")
def anomaly_metrics_rank(spark, sf_dir):
    a = S.anomaly_metrics(_labelled(spark, sf_dir), ["rid", "func", "step"])
    return a.select("rid", "func", "step", "n", _r("score.mean", "score_mean"), _r("severity.accumulate", "severity_sum"), _r("severity.maximum", "severity_max"))


@query(
    f"""WITH {_LAB}, c AS (SELECT func, rid, step, count(*) AS n FROM lab WHERE label = -1 GROUP BY ALL)
SELECT func, contributions, n_mean, n_max, score_mean, severity_sum, first_step, last_step FROM
(SELECT func, count(*) AS contributions, round(avg(n), 6) AS n_mean, max(n)::DOUBLE AS n_max FROM c GROUP BY func) JOIN
(SELECT func, round(avg(score), 6) AS score_mean, round(sum(exclusive), 6) AS severity_sum, min(step) AS first_step, max(step) AS last_step FROM lab WHERE label = -1 GROUP BY func) USING (func)"""
)
def anomaly_metrics_allranks(spark, sf_dir):
    a = S.rolled_metrics(_labelled(spark, sf_dir), ["func"])
    return a.select("func", F.col("count.count").alias("contributions"), _r("count.mean", "n_mean"), F.col("count.maximum").cast("double").alias("n_max"), _r("score.mean", "score_mean"), _r("severity.accumulate", "severity_sum"), "first_step", "last_step")


@query(
    f"""WITH {_LAB}, p AS (SELECT func, tid, count(*) AS calls, round(avg(exclusive), 6) AS mean FROM ex GROUP BY ALL),
a AS (SELECT func, tid, count(*) AS n, round(avg(score), 6) AS score FROM lab WHERE label = -1 GROUP BY ALL)
SELECT func, tid, calls, mean, n, score FROM p FULL JOIN a USING (func, tid)"""
)
def func_stats_full_outer(spark, sf_dir):
    p = execs(spark, sf_dir).groupBy("func", "tid").agg(F.count("*").alias("calls"), _r(F.avg("exclusive"), "mean"))
    a = S.anomaly_metrics(_labelled(spark, sf_dir), ["func", "tid"]).select("func", "tid", "n", _r("score.mean", "score"))
    return S.function_stats(p, a, ["func", "tid"])


@query(
    f"""WITH {_LAB}, p AS (SELECT func, rid, step, count(*) FILTER (label = -1) AS k FROM lab GROUP BY ALL)
SELECT func, round(avg(k), 6) AS per_contribution, max(k)::DOUBLE AS most, any_value(calls) AS calls FROM p JOIN (SELECT func, count(*) AS calls FROM ex GROUP BY func) USING (func) GROUP BY func"""
)
def aggregate_func_stats(spark, sf_dir):
    p = S.aggregate_profile(_labelled(spark, sf_dir), ["func"])
    return p.select("func", _r("anomaly_count.mean", "per_contribution"), F.col("anomaly_count.maximum").cast("double").alias("most"), F.col("exclusive.count").alias("calls"))


# -- histograms

_HIST = f"""{EX}, span AS (SELECT func, min(exclusive) AS lo, max(exclusive) AS hi, (max(exclusive) - min(exclusive)) / (200 - 1e-6 - 0.001) AS raw FROM ex GROUP BY func),
grid AS (SELECT func, lo, hi, lo - 1e-6 * raw AS start, ceil((hi - (lo - 1e-6 * raw)) / raw)::INT AS nbin FROM span),
grd AS (SELECT *, (hi - start) / nbin AS width FROM grid),
b0 AS (SELECT ex.*, grd.start, grd.width, grd.nbin, ceil((exclusive - grd.start) / grd.width)::INT - 1 AS b FROM ex JOIN grd USING (func)),
binned AS (SELECT *, least(greatest(CASE WHEN exclusive <= start + b * width THEN b - 1 ELSE b END, 0), nbin - 1) AS bin FROM b0),
hist AS (SELECT func, bin, count(*) AS n, any_value(start) AS start, any_value(width) AS width, any_value(nbin) AS nbin FROM binned GROUP BY func, bin),
scored AS (SELECT *, -log2(n / sum(n) OVER (PARTITION BY func) + 78.88e-32) AS score FROM hist),
lim AS (SELECT *, greatest(min(score) OVER w + 0.99 * (max(score) OVER w - min(score) OVER w), log2(1.00001)) AS lim FROM scored WINDOW w AS (PARTITION BY func))"""


@query(f"WITH {_HIST} SELECT func, bin, n, nbin, round(start, 6) AS start, round(width, 6) AS width FROM hist")
def hbos_histogram(spark, sf_dir):
    return H.per_group(execs(spark, sf_dir), ["func"], "exclusive").select("func", "bin", "n", "nbin", _r("start", "start"), _r("width", "width"))


@query(f"WITH {_HIST} SELECT func, bin, round(score, 6) AS score FROM scored")
def hbos_bin_scores(spark, sf_dir):
    h = H.per_group(execs(spark, sf_dir), ["func"], "exclusive")
    return h.select("func", "bin", _r(-F.log2(F.col("n") / F.sum("n").over(W.partitionBy("func")) + M.ALPHA), "score"))


@query(f"WITH {_HIST} SELECT id, func, bin, round(score, 6) AS score FROM binned JOIN lim USING (func, bin) WHERE score >= lim")
def hbos_outliers(spark, sf_dir):
    return M.hbos_label(execs(spark, sf_dir), ["func"], "exclusive").where("label = -1").select("id", "func", "bin", _r("score", "score"))


@query(f"WITH {EX} SELECT func, round(3.5 * stddev_pop(exclusive) / cbrt(count(*)), 6) AS width FROM ex GROUP BY func")
def scott_width(spark, sf_dir):
    e = execs(spark, sf_dir).groupBy("func").agg(H.scott_rule("exclusive").alias("width"))
    return e.select("func", _r("width", "width"))


@query(f"WITH {_HIST} SELECT func, bin, round(sum(n) OVER (PARTITION BY func ORDER BY bin) / sum(n) OVER (PARTITION BY func), 6) AS cdf FROM hist")
def ecdf_copod_input(spark, sf_dir):
    h = H.per_group(execs(spark, sf_dir), ["func"], "exclusive")
    return h.select("func", "bin", _r(F.sum("n").over(W.partitionBy("func").orderBy("bin")) / F.sum("n").over(W.partitionBy("func")), "cdf"))


@query(
    f"""WITH {_HIST}, top AS (SELECT func, max(n) AS top, sum(n) AS total FROM hist GROUP BY func)
SELECT id, func, CASE WHEN n / total < 0.05 * top / total THEN -1 ELSE 1 END AS label FROM binned JOIN hist USING (func, bin) JOIN top USING (func)"""
)
def threshold_prob_label(spark, sf_dir):
    """Rare bins, against the fullest, are outliers."""
    return M.threshold_label(execs(spark, sf_dir), ["func"], "exclusive").select("id", "func", "label")


@query()
def hbos_multistep_fold(spark, sf_dir):
    out = M.folded(execs(spark, sf_dir), "func", "step", "exclusive", "id", M.Params("hbos"))
    return out.select("id", "label", _r("score", "score"))


@query()
def copod_scores(spark, sf_dir):
    out = M.folded(execs(spark, sf_dir).withColumn("step", F.lit(0)), "func", "step", "exclusive", "id", M.Params("copod"))
    return out.select("id", "label", _r("score", "score"))


# -- call trees


@query(f"WITH {SPANS} SELECT rid, tid, fid, entry, exit, exit - entry AS runtime FROM o UNION ALL SELECT rid, tid, fid, entry, exit, exit - entry FROM li")
def call_pairing(spark, sf_dir):
    return C.executions(calls(spark, sf_dir)).select("rid", "tid", "fid", "entry", "exit", "runtime")


@query(f"WITH {SPANS} SELECT o.tid, o.entry, o.exit - o.entry - coalesce(sum(li.exit - li.entry), 0)::BIGINT AS exclusive, count(li.k) AS n_children FROM o LEFT JOIN li ON li.k = o.k GROUP BY o.tid, o.entry, o.exit UNION ALL SELECT tid, entry, exit - entry, 0 FROM li")
def exclusive_time(spark, sf_dir):
    return C.executions(calls(spark, sf_dir)).select("tid", "entry", "exclusive", F.col("n_children").cast("long").alias("n_children"))


@query(f"WITH {SPANS} SELECT li.tid, li.entry, o.entry AS parent_entry FROM li JOIN o USING (k)")
def parent_link(spark, sf_dir):
    c = C.executions(calls(spark, sf_dir))
    up = c.select("rid", "tid", F.col("seq").alias("parent"), F.col("entry").alias("parent_entry"))
    return c.join(up, ["rid", "tid", "parent"]).select("tid", "entry", "parent_entry")


@query(f"WITH {SPANS} SELECT tid, entry, fid AS stack FROM o UNION ALL SELECT tid, entry, fid || '<' || up FROM li")
def call_stack_walk(spark, sf_dir):
    return C.executions(calls(spark, sf_dir), stack=True).select("tid", "entry", F.array_join("stack", "<").alias("stack"))


@query(f"WITH {SPANS}, {POINTS} SELECT tid, ts, fid FROM pt")
def comm_interval_attach(spark, sf_dir):
    c = C.executions(calls(spark, sf_dir))
    p = C.attached(points(spark, sf_dir).select("pid", "rid", "tid", "ts"), c, 1_000_000, ("fid",))
    return p.where("call_seq IS NOT NULL").select("tid", "ts", "fid")


@query(f"WITH {SPANS}, a AS (SELECT tid, entry FROM o UNION ALL SELECT tid, entry FROM li) SELECT tid, entry, count(*) OVER w AS size, min(entry) OVER w AS first, max(entry) OVER w AS last FROM a WINDOW w AS (PARTITION BY tid ORDER BY entry ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def exec_window(spark, sf_dir):
    c = C.neighbours(C.executions(calls(spark, sf_dir)), 5)
    e = F.transform("window", lambda x: x["entry"])
    return c.select("tid", "entry", F.size("window").cast("long").alias("size"), F.array_min(e).alias("first"), F.array_max(e).alias("last"))


@query(f"WITH {SPANS} SELECT tid, entry, exit FROM o QUALIFY row_number() OVER (PARTITION BY tid ORDER BY entry DESC) <= 3")
def retained_calls(spark, sf_dir):
    return C.retained(C.executions(calls(spark, sf_dir)).where("depth = 1"), 3).select("tid", "entry", "exit")


@query(f"WITH {SPANS} SELECT true AS nested, count(DISTINCT (rid, tid)) AS threads FROM o")
def nesting_check(spark, sf_dir):
    return C.nests(calls(spark, sf_dir)).groupBy("nested").agg(F.count("*").alias("threads"))


@query(f"WITH {SPANS} SELECT rid, tid, fid, entry, exit, exit - entry AS runtime FROM o UNION ALL SELECT rid, tid, fid, entry, exit, exit - entry FROM li")
def call_pairing_strict(spark, sf_dir):
    """The sequential path gives the same on events that nest."""
    return C.executions_strict(calls(spark, sf_dir)).where("error IS NULL").select("rid", "tid", "fid", "entry", "exit", "runtime")


_CORR = """k AS (SELECT event_id, (props::JSON->>'k')::BIGINT AS value, row_number() OVER (PARTITION BY (props::JSON->>'k')::BIGINT ORDER BY event_id) AS k FROM events)"""


@query(f"WITH {_CORR} SELECT x.value, x.event_id AS a, y.event_id AS b FROM k x JOIN k y ON x.value = y.value AND y.k = x.k + 1 AND x.k % 2 = 1")
def correlation_pairs(spark, sf_dir):
    return C.correlated(counters(spark, sf_dir).select("value", F.col("id").alias("seq"))).select("value", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


@query("SELECT (props::JSON->>'k')::BIGINT AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) % 2 = 1")
def unmatched_correlation(spark, sf_dir):
    return C.unmatched(counters(spark, sf_dir).select("value", F.col("id").alias("seq")))


@query("SELECT event_id AS id, user_id AS tid FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value < before")
def order_violations(spark, sf_dir):
    e = execs(spark, sf_dir).select("id", "pid", "rid", "tid", F.col("id").alias("idx"), F.col("exclusive").alias("ts"))
    return C.order_violations(e).select("id", "tid")


@query("SELECT user_id % 7 AS pid, count(*) AS rejected FROM events WHERE user_id % 7 > 3 GROUP BY 1")
def invalid_event_reject(spark, sf_dir):
    from tracelens.sources import trace

    e = execs(spark, sf_dir).withColumn("real", F.col("tid") % 7).withColumn("pid", F.when(F.col("real") > 3, F.lit(99_999_999)).otherwise(F.col("real"))).withColumn("ts", F.col("entry"))
    return trace.validated(e)[1].groupBy(F.col("real").alias("pid")).agg(F.count("*").alias("rejected"))


@query("SELECT event_type AS name, row_number() OVER (ORDER BY first) - 1 AS fid FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)")
def function_index_assign(spark, sf_dir):
    """Global indexes by first appearance; the dictionary is as small as the program's functions."""
    seen = execs(spark, sf_dir).groupBy("pid", F.col("func").alias("name")).agg(F.min("id").alias("first"))
    return N.assign(spark.createDataFrame([], "pid long, name string, fid long"), seen).select("name", "fid")


# -- provenance and collections


@query(f"WITH {CT} SELECT rid, counter AS field, arg_max(value, (ts, value)) AS value, max(ts) AS ts FROM ct WHERE counter IN ('click', 'view') GROUP BY rid, counter")
def node_state_last(spark, sf_dir):
    watch = spark.createDataFrame([("click", "click"), ("view", "view")], "counter string, field string")
    return P.node_state(counters(spark, sf_dir), watch, ["rid"]).select("rid", "field", "value", "ts")


@query("SELECT c_custkey % 16 AS tid, max(c_custkey) FILTER (c_custkey % 3 = 0) AS device, max(c_custkey) FILTER (c_custkey % 3 = 1) AS context, max(c_custkey) FILTER (c_custkey % 3 = 2) AS stream FROM customer GROUP BY 1")
def metadata_pivot(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("CUDA Device"), F.lit("CUDA Context"), F.lit("CUDA Stream")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.lit(0).alias("pid"), F.lit(0).alias("rid"), (F.col("c_custkey") % 16).alias("tid"), kind.alias("descr"), F.col("c_custkey").cast("string").alias("value"))
    return P.gpu_threads(rows).select("tid", "device", "context", "stream")


@query("SELECT event_id AS id, event_type AS func FROM events WHERE contains(event_type, 'ic')")
def filter_contains(spark, sf_dir):
    return D.select(execs(spark, sf_dir), [("func", "contains", "ic")]).select("id", "func")


@query("SELECT event_id AS id FROM events WHERE (value > 50 AND user_id % 4 = 1) OR NOT (value >= 1 AND event_type <> 'view')")
def filter_chain(spark, sf_dir):
    chain = ["(", ("exclusive", ">", 50), "and", ("rid", "==", 1), ")", "or", "not", "(", ("exclusive", ">=", 1), "and", ("func", "!=", "view"), ")"]
    return D.select(execs(spark, sf_dir), chain).select("id")


@query(f"WITH {EX} SELECT func, count(*) AS n, min(entry) AS first, max(entry) AS last FROM ex GROUP BY func")
def inverted_index_counts(spark, sf_dir):
    return D.index(execs(spark, sf_dir), "func").groupBy(F.col("value").alias("func")).agg(F.count("*").alias("n"), F.min("entry").alias("first"), F.max("entry").alias("last"))


@query(f"WITH {EX} SELECT func, tid, round(sum(exclusive), 4) AS severity FROM ex GROUP BY func, tid ORDER BY round(sum(exclusive), 4) DESC, func, tid LIMIT 10")
def topk_functions(spark, sf_dir):
    s = execs(spark, sf_dir).groupBy("func", "tid").agg(F.round(F.sum("exclusive"), 4).alias("severity"))
    return s.orderBy(F.desc("severity"), "func", "tid").limit(10)


@query(
    f"""WITH {EX}, a AS (SELECT func, tid, round(sum(exclusive), 4) AS severity FROM ex WHERE rid < 2 GROUP BY ALL), b AS (SELECT func, tid, round(sum(exclusive), 4) AS severity FROM ex WHERE rid >= 2 GROUP BY ALL)
SELECT func, tid, a.severity AS severity_a, b.severity AS severity_b, greatest(a.severity, b.severity) AS greatest FROM a FULL JOIN b USING (func, tid) ORDER BY greatest DESC NULLS LAST, func, tid LIMIT 10"""
)
def between_run_diff(spark, sf_dir):
    """The ten functions and threads of greatest severity; the first two ranks are one run, the others another."""
    s = execs(spark, sf_dir).groupBy("func", "tid", "rid").agg(F.round(F.sum("exclusive"), 4).alias("severity"))
    a, b = (s.where(c).select("func", "tid", "severity") for c in ("rid < 2", "rid >= 2"))
    return D.between_runs(a, b, ["func", "tid"], "severity")


@query(f"WITH {_LAB} SELECT rid, func, step, count(*) AS reported, count(*) FILTER (exclusive >= 260) AS stored FROM lab WHERE label = -1 GROUP BY ALL HAVING count(*) <> count(*) FILTER (exclusive >= 260)")
def viz_validate(spark, sf_dir):
    """Reported anomalies against stored records, which leave out those under a minimum time."""
    found = _labelled(spark, sf_dir).where("label = -1")
    reported = found.groupBy("rid", "func", "step").agg(F.count("*").alias("reported"))
    return D.validated(found.where("exclusive >= 260"), reported, ["rid", "func", "step"]).select("rid", "func", "step", "reported", "stored")


@query(
    f"""WITH {_LAB}, old AS (SELECT id, func, exclusive FROM lab WHERE label = -1), m AS (SELECT func, avg(exclusive) AS mean, stddev_samp(exclusive) AS sd FROM ex WHERE rid = 0 GROUP BY func)
SELECT id, func, round(abs(exclusive - mean) / sd, 6) AS score FROM old JOIN m USING (func) WHERE abs(exclusive - mean) > 5.0 * sd"""
)
def prune(spark, sf_dir):
    """Stored anomalies under a frozen model of one rank."""
    old = _labelled(spark, sf_dir).where("label = -1").select("id", "func", "exclusive")
    frozen = M.sstd_model(execs(spark, sf_dir).where("rid = 0"), ["func"], "exclusive")
    return M.rescored(old, frozen, ["func"], "exclusive", 5.0).select("id", "func", _r("score", "score"))


@query(f"WITH {_LAB} SELECT CASE WHEN label = -1 THEN CASE WHEN exclusive > 100 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN exclusive > 100 THEN 'FN' ELSE 'TN' END END AS kind, count(*) AS n FROM lab GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_labelled(spark, sf_dir).withColumn("truth", F.col("exclusive") > 100), "label", "truth")


@query(f"WITH {EX} SELECT pid, rid, func, count(*) AS n, round(sum(exclusive), 4) AS total FROM ex GROUP BY ROLLUP (pid, rid, func)")
def rollup_program_rank_function(spark, sf_dir):
    return execs(spark, sf_dir).rollup("pid", "rid", "func").agg(F.count("*").alias("n"), F.round(F.sum("exclusive"), 4).alias("total"))


@query(f"WITH {EX} SELECT id, entry + r * 1000000 AS ts, r AS replay FROM ex, (SELECT unnest([0, 1, 2]) AS r)")
def stream_replay(spark, sf_dir):
    from tracelens.sources import trace

    e = execs(spark, sf_dir).select("id", F.col("entry").alias("ts"))
    return trace.replayed(e, 3, 1_000_000)


from tracelens.plans import more  # noqa: E402, F401  (registers its queries here)
