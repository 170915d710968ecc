import json
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelens.functions import histogram as H
from tracelens.functions import runstats as R
from tracelens.functions import scalars as X
from tracelens.operators import calltree as C
from tracelens.operators import collections as D
from tracelens.operators import models as M
from tracelens.operators import provenance as P
from tracelens.operators import stats as S
from tracelens.sources import sinks
from tracelens.sources import trace as T
from tracelens.streaming import engine

# -- run statistics


def moments(x):
    x = np.array(x, float)
    n, d = len(x), x - x.mean()
    m2 = (d**2).sum()
    return (n, x.sum(), x.min(), x.max(), x.mean(), math.sqrt(m2 / (n - 1)), math.sqrt(n) * (d**3).sum() / m2**1.5, n * (d**4).sum() / m2**2 - 3)


def test_run_stats_of_parts_merge_to_the_whole(spark):
    r = np.random.default_rng(17)
    vectors = [r.normal(5, 2, 31), r.integers(-9, 9, 8), r.lognormal(1, 1, 200), r.uniform(-1e-3, 1e-3, 12), r.choice([4, -4], 20)]
    rows = [(k, int(r.integers(0, 3)), float(x)) for k, v in enumerate(vectors) for x in v]
    df = spark.createDataFrame(rows, "k int, part int, x double")
    whole = {r["k"]: tuple(r["s"]) for r in df.groupBy("k").agg(F.struct(*R.aggregates("x")).alias("s")).collect()}
    merged = R.merge(R.collect(df, ["k", "part"], "x"), ["k"])
    parts = {r["k"]: tuple(r["s"]) for r in merged.select("k", F.struct(*R.report()).alias("s")).collect()}
    for k, v in enumerate(vectors):
        want = moments(v)
        want = want if abs(np.var(v) * len(v)) >= R.FLAT else (*want[:6], 0.0, 0.0)
        assert whole[k] == pytest.approx(want, rel=1e-8, abs=1e-9)
        assert parts[k] == pytest.approx(want, rel=1e-8, abs=1e-9)


def test_run_stats_of_one_value(spark):
    r = spark.createDataFrame([(-2.5,)], "x double").agg(*R.aggregates("x")).first()
    assert (r["count"], r["mean"], r["stddev"], r["skewness"], r["kurtosis"]) == (1, -2.5, 0.0, 0.0, 0.0)


def test_static_moments_and_equality(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 7.0), ("b", 3.0)], "k string, x double")
    got = {r["k"]: (r["mean"], r["std"]) for r in R.static_std(df, ["k"], "x", 1).collect()}
    assert got["a"] == (6.0, pytest.approx(math.sqrt((25 + 4 + 1) / 2))) and got["b"] == (0.0, 0.0)
    s = df.groupBy("k").agg(F.struct(*R.aggregates("x")).alias("a")).withColumn("b", F.col("a").withField("mean", F.col("a.mean") * (1 + 1e-9)))
    assert all(r["near"] and not r["exact"] for r in s.select(R.alike("a", "b").alias("near"), R.alike("a", "b", None).alias("exact")).collect())


# -- histograms


def test_histogram_bins():
    h = H.Histogram.edges([5, 0, 3], 2.0, 0.5, 2.1, 3.5)
    for v, want in ((2.2, 0), (3.2, 2), (1.0, H.LEFT), (1.99, 0), (4.0, H.RIGHT), (3.51, 2), (2.5, 0), (2.51, 1), (3.5, 2)):
        assert h.bin(v) == want, v
    assert h.bin(2.0, 0) == H.LEFT
    for bad in ((2.0, 0.5, 2.1, 9.0), (2.0, 0.5, 1.9, 3.5)):
        with pytest.raises(ValueError):
            H.Histogram.edges([5, 0, 3], *bad)


def slow_share(bins, edge):
    """Bins (low, high, count) split at one edge after the other."""
    out = [0] * (len(edge) - 1)
    for low, high, c in bins:
        for k in range(len(out)):
            e = edge[k + 1]
            if k == len(out) - 1 or e >= high:
                out[k] += c
                break
            if e <= low:
                continue
            f = (e - low) / (high - low)
            a, b = math.floor(f * c + 0.5), math.floor((1 - f) * c + 0.5)
            if 1 - f > f:
                b += c - a - b
            else:
                a += c - a - b
            out[k] += a
            low, c = e, b
    return out


def test_counts_are_shared_out_whole():
    r = np.random.default_rng(4)
    for _ in range(60):
        own = np.sort(r.uniform(0, 10, int(r.integers(2, 12))))
        c = r.integers(0, 30, len(own) - 1)
        edge = np.sort(np.append(r.uniform(-1, 11, int(r.integers(1, 25))), [-1.5, 11.5]))
        got = H.shared_out(own[:-1], own[1:], c, edge)
        assert got.tolist() == slow_share(list(zip(own[:-1], own[1:], c.tolist(), strict=True)), edge) and got.sum() == c.sum()


def test_histogram_merge_cdf_and_ranges():
    r = np.random.default_rng(6)
    x, y = r.gamma(2, 3, 700), r.gamma(3, 2, 400) + 4
    for rule in (H.width_count(40), H.width_scott, H.width_fixed(1e-19)):
        a, b = H.Histogram.of(x, H.width_count(40)), H.Histogram.of(y, H.width_count(30))
        m = a.merged(b, rule)
        assert m.total == 1100 and m.lo == min(x.min(), y.min()) and m.hi == max(x.max(), y.max()) and len(m.counts) <= H.MAX_BINS
    h = H.Histogram.of(x, H.width_count(40))
    assert h.cdf(h.start) == 0 and h.cdf(h.hi) == 1 and h.cdf(float(h.upper(7))) == pytest.approx(h.counts[:8].sum() / h.total)
    n = h.negated()
    assert n.total == h.total and n.cdf(-float(h.upper(7))) == pytest.approx(1 - h.cdf(float(h.upper(7))))
    u = h.unpack()
    assert h.skewness() == pytest.approx(((u - u.mean()) ** 3).sum() / (len(u) - 1) / u.var() ** 1.5)
    low, high = float(h.upper(3)), float(h.upper(9))
    count, rest = h.extracted(low, high)
    assert count == h.counts[4:10].sum() and rest.total + count == h.total
    assert H.Histogram.from_json(json.loads(json.dumps(h.to_json()))).to_json() == h.to_json()
    more = h.with_data(y, H.width_count(25))
    assert more.total == 1100
    edge, change, relative = H.difference(h, H.Histogram.of(y, H.width_count(30)))
    assert change.sum() == 700 - 400 and len(edge) == len(change) + 1 and abs(relative).max() <= 2
    assert not H.difference(h, h)[1].any()


def test_variable_histogram():
    v = H.VariableHistogram(np.array([0.0, 2.0, 3.0, 10.0]), np.array([7, 4, 21]), 0.5, 10.0)
    assert [v.bin(x) for x in (0.0, 0.1, 2.0, 2.5, 10.0, 10.1)] == [H.LEFT, 0, 0, 1, 2, H.RIGHT]
    assert v.split(1.0) == 0 and v.counts.tolist() == [3, 4, 4, 21] and v.edge.tolist() == [0, 1, 2, 3, 10]
    assert v.split(3.0) == 2 and len(v.counts) == 4
    assert v.rebinned([0, 5, 10]).tolist() == [3 + 4 + 4 + 6, 15]
    assert v.extract([(-5.0, 1.0), (2.0, 4.0), (20.0, 30.0)]).tolist() == [3, 4 + 3, 0] and v.total == 4 + 18
    with pytest.raises(ValueError):
        v.split(11.0)
    with pytest.raises(ValueError):
        v.extract([(2.0, 3.0), (1.0, 2.0)])
    one = H.VariableHistogram.of(H.Histogram.of([8.0] * 6, H.width_scott))
    assert one.extract([(1.0, 7.0), (7.0, 8.0), (8.0, 9.0)]).tolist() == [0, 6, 0]


def test_histogram_of_data(spark):
    x = np.random.default_rng(5).lognormal(2, 0.5, 4000)
    for rule in (H.width_scott, H.width_count(200), H.width_capped(H.width_fixed(0.0), 50)):
        h = H.Histogram.of(x, rule)
        assert h.total == 4000 and h.lo == x.min() and h.hi == x.max()
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0)] * 3 + [("c", None)], "k string, v double")
    for scott, rule in ((False, H.width_count(200)), (True, H.width_capped(H.width_scott, H.MAX_BINS))):
        rows = H.packed(H.per_group(df, ["k"], "v", scott=scott), ["k"]).collect()
        got = {r["k"]: H.unpacked(r) for r in rows}
        own = H.Histogram.of(x, rule)
        assert got["a"].counts.tolist() == own.counts.tolist() and got["a"].width == pytest.approx(own.width)
        assert got["b"].counts.tolist() == [3] and "c" not in got


# -- models


def test_model_scores(spark):
    df = spark.createDataFrame([(55.0,), (45.0,), (81.0,)], "x double").withColumns({"n": F.lit(40), "mean": F.lit(50.0), "sd": F.lit(5.0)})
    assert [(r["score"], r["label"]) for r in M.sstd_label(df, "x").collect()] == [(1.0, 1), (1.0, 1), (pytest.approx(6.2), -1)]
    assert M.sstd_label(df.withColumn("n", F.lit(1)), "x").first()["label"] == 0
    h = H.Histogram(np.array([9, 70, 40, 0, 0, 0, 2]), 10.0, 10.0, 11.0, 80.0)
    limit = M.hbos_limit(h)
    assert M.hbos_scores(h, np.array([75.0]))[0] >= limit > M.hbos_scores(h, np.array([25.0]))[0]
    assert M.hbos_scores(h, np.array([200.0, -3.0, 45.0])) == pytest.approx([-math.log2(M.ALPHA)] * 3)
    assert M.copod_scores(h, np.array([80.0]))[0] >= M.copod_limit(h) > M.copod_scores(h, np.array([25.0]))[0]


def slow_fold(rows, kind, threshold=0.99):
    """Every step's histogram from raw values, merged and scored in plain Python."""
    copod, out = kind == "copod", {}
    rule = H.width_scott if copod else H.width_count(200)
    by = defaultdict(lambda: defaultdict(list))
    for k, step, x, i in rows:
        by[k][step].append((x, i))
    for steps in by.values():
        model, floor = None, math.log2(1.00001)
        for step in sorted(steps):
            v = np.array([x for x, _ in steps[step]])
            own = H.Histogram.of(v, H.width_capped(rule, H.MAX_BINS) if copod else rule)
            model = own if model is None else model.merged(own, rule)
            floor = max(floor, (M.copod_limit if copod else M.hbos_limit)(model, threshold))
            score = M.copod_scores(model, v) if copod else M.hbos_scores(model, v)
            out.update({i: (s, -1 if s >= floor else 1) for (_, i), s in zip(steps[step], score, strict=True)})
    return out


@pytest.mark.parametrize("kind", ["hbos", "copod"])
def test_steps_against_a_plain_fold(spark, kind):
    r = np.random.default_rng(9)
    rows = []
    for key, size in (("f", 300), ("g", 40)):
        for step in range(4):
            rows += [(key, step, float(round(v, 3)), len(rows) + i) for i, v in enumerate(r.lognormal(2, 0.5, size))]
        rows.append((key, 3, 400.0, len(rows)))
    rows += [("h", s, 3.0, 100_000 + s) for s in range(3)]
    df = spark.createDataFrame(rows, "k string, step int, x double, id long")
    got = {r["id"]: (r["score"], r["label"]) for r in M.folded(df, "k", "step", "x", "id", M.Params(kind)).collect()}
    want = slow_fold(rows, kind)
    assert set(got) == set(want)
    for i, (s, label) in want.items():
        assert got[i][0] == pytest.approx(s, abs=1e-6), i
        assert got[i][1] == label, i
    assert all(got[i][1] == -1 for _, _, x, i in rows if x == 400.0)


def test_models_go_on_from_a_stored_one(spark):
    rows = [("f", s, float((7 * i + s) % 23), 100 * s + i) for s in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, step int, x double, id long")
    p = M.Params("hbos")
    whole = M.step_models(df, "k", "step", "x", p).where("step = 3").first()
    half = M.step_models(df.where("step < 2"), "k", "step", "x", p).where("step = 1").drop("step")
    rest = M.step_models(df.where("step >= 2"), "k", "step", "x", p, half).where("step = 3").first()
    assert rest["counts"] == whole["counts"] and rest["limit"] == pytest.approx(whole["limit"])
    table = M.model_table(df, "k", "x", p)
    assert M.model_of(table, "k", "f").total == len(rows)
    with pytest.raises(LookupError):
        M.model_of(table, "k", "none")
    assert [M.synced(s, 1, 3) for s in range(6)] == [True, False, True, False, False, True] and not M.synced(4, 0, 0)


def test_what_a_model_leaves_out(spark):
    e = spark.createDataFrame([(i, "f", 10.0 + i % 3, 0) for i in range(30)] + [(90, "f", 500.0, 0), (91, "f", 400.0, -1), (92, "g", 1.0, 0)], "id long, func string, exclusive double, label int")
    got = {r["id"]: r["label"] for r in M.labelled(e, ["func"], "exclusive", 3.0, ["g"]).collect()}
    assert got[90] == -1 and got[91] == -1 and got[92] == 1 and got[5] == 1


def test_prune_with_a_frozen_model(spark):
    rec = spark.createDataFrame([(1, "f", 55.0, 4.0), (2, "f", 140.0, 9.0), (3, "f", 300.0, 9.0), (4, "new", 1.0, 7.0)], "id long, func string, exclusive double, score double")
    model = spark.createDataFrame([("f", 90, 50.0, 10.0)], "func string, n long, mean double, sd double")
    assert {r["id"]: r["score"] for r in M.rescored(rec, model, ["func"], "exclusive").collect()} == {2: 9.0, 3: 25.0}
    bad, good = M.pruned(rec, rec, model, ["func"], "exclusive")
    assert {r["id"]: r["score"] for r in bad.collect()} == {2: 9.0, 3: 25.0, 4: 7.0} and {r["id"] for r in good.collect()} == {1, 4}
    stats = D.with_pruned_stats(spark.createDataFrame([("f", 3), ("g", 1)], "func string, calls long"), bad.withColumns({"rid": F.lit(0), "step": F.lit(2), "entry": F.col("id"), "exit": F.col("id") + 5}))
    got = {r["func"]: r["anomaly_metrics"] for r in stats.collect()}
    assert got["g"] is None and got["f"]["count"]["accumulate"] == 2 and got["f"]["severity"]["accumulate"] == 440.0 and got["f"]["max_ts"] == 8


# -- call trees


def slow_calls(events):
    """Calls and errors of (thread, kind, fid, ts, seq) by a plain stack."""
    calls, errors = {}, []
    for t in {e[0] for e in events}:
        stack = []
        for _, kind, fid, ts, seq in sorted((e for e in events if e[0] == t), key=lambda e: e[4]):
            if kind == "ENTRY":
                if stack:
                    calls[t, stack[-1]]["n"] += 1
                calls[t, seq] = {"fid": fid, "entry": ts, "exit": 0, "parent": stack[-1] if stack else None, "n": 0, "inner": 0, "stack": [fid, *(calls[t, s]["fid"] for s in reversed(stack))]}
                stack.append(seq)
            elif not stack or calls[t, stack[-1]]["fid"] != fid or ts < calls[t, stack[-1]]["entry"]:
                errors.append((t, seq, "CallStackViolation" if stack else "EmptyCallStack"))
            else:
                c = calls[t, stack.pop()]
                c["exit"] = ts
                if stack:
                    calls[t, stack[-1]]["inner"] += ts - c["entry"]
    return {k: (c["fid"], c["entry"], c["exit"], c["parent"], c["n"], c["exit"] - c["entry"] - c["inner"] if c["exit"] else 0, len(c["stack"]), c["stack"]) for k, c in calls.items()}, sorted(errors)


def random_events(seed, threads, steps, faults):
    r = random.Random(seed)
    events = []
    for t in range(threads):
        stack, ts = [], 10 * t + 1
        for seq in range(steps):
            ts += r.choice((0, 0, 1, 7))
            if stack and r.random() < 0.45:
                fid = stack.pop()
            elif faults and t % 2 and r.random() < 0.1:
                fid = r.randrange(5)
                if stack and stack[-1] == fid:
                    stack.pop()
            else:
                stack.append(r.randrange(5))
                events.append((t, "ENTRY", stack[-1], ts, seq))
                continue
            events.append((t, "EXIT", fid, ts, seq))
    return events


@pytest.mark.parametrize("faults", [False, True])
@pytest.mark.parametrize("rows", [3, 7, 10_000])
def test_calls_against_a_plain_stack(spark, faults, rows):
    events = random_events(11, 6, 80, faults)
    df = spark.createDataFrame([(0, t % 2, t, k, f, ts, s) for t, k, f, ts, s in events], "pid long, rid long, tid long, kind string, fid long, ts long, seq int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        out = C.executions_strict(df, stack=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    calls, errors = slow_calls(events)
    assert {(r["tid"], r["seq"]): (r["fid"], r["entry"], r["exit"], r["parent"], r["n_children"], r["exclusive"], r["depth"], r["stack"]) for r in out if not r["error"]} == calls
    assert sorted((r["tid"], r["seq"], r["error"]) for r in out if r["error"]) == errors
    assert bool(errors) == faults
    nested = {r["tid"]: r["nested"] for r in C.nests(df).collect()}
    assert all(nested[t] == (t not in {e[0] for e in errors}) for t in nested)


@pytest.mark.parametrize("parts", [5, 60])
@pytest.mark.parametrize("faults", [False, True])
def test_a_thread_in_many_ranges(spark, faults, parts):
    """Threads are dealt over tasks, and calls are those of one pass; every thread was in one task."""
    events = random_events(29, 4, 400, faults) + [(7, "ENTRY", i % 3, 9 * i, i) for i in range(60)] + [(7, "EXIT", (59 - i) % 3, 1000 + i, 60 + i) for i in range(50)]
    df = spark.createDataFrame([(0, t % 2, t, k, f"f{f}", ts, s) for t, k, f, ts, s in events], "pid long, rid long, tid long, kind string, fid string, ts long, seq int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, _ = C._paired(df, False)
        assert rows.select("part").distinct().count() > parts // 2
        out = C.executions_strict(df, stack=True).collect()
        nested = {r["tid"]: r["nested"] for r in C.nests(df).collect()}
        plain = C.executions(df).drop("stack").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    calls, errors = slow_calls([(t, k, f"f{f}", ts, s) for t, k, f, ts, s in events])
    figures = lambda r: (r["fid"], r["entry"], r["exit"], r["parent"], r["n_children"], r["exclusive"], r["depth"])
    assert {(r["tid"], r["seq"]): (*figures(r), r["stack"]) for r in out if not r["error"]} == calls and len(out) == len(calls) + len(errors)
    assert {(r["tid"], r["seq"]): figures(r) for r in plain} == {k: v[:7] for k, v in calls.items()}
    assert sorted((r["tid"], r["seq"], r["error"]) for r in out if r["error"]) == errors
    assert nested == {t: t not in {e[0] for e in errors} for t in (0, 1, 2, 3, 7)}


def test_stacks_of_stored_calls(spark):
    events = random_events(5, 2, 300, False) + [(9, "ENTRY", i % 3, i, i) for i in range(150)]
    df = spark.createDataFrame([(0, 0, t, k, f"f{f}", ts, s) for t, k, f, ts, s in events], "pid long, rid long, tid long, kind string, fid string, ts long, seq int")
    c = C.executions(df, stack=True)
    want = {(r["tid"], r["seq"]): r["stack"] for r in c.collect()}
    assert {(r["tid"], r["seq"]): r["stack"] for r in C.stacks(c.drop("stack")).collect()} == want and max(map(len, want.values())) == 150


@pytest.mark.parametrize("rows", [3, 10_000])
def test_stacks_of_calls_in_many_ranges(spark, rows):
    """Paths across ranges, of parents that aren't there, that come later or that lie far back; a range's paths came from joins of all calls."""
    r = random.Random(8)
    parent = {i: i - 1 if i < 40 else r.choice([None, i - 1, i - 2, r.randrange(i), 5000]) for i in range(300)} | {300: 301, 301: 7}
    path = lambda i: [f"f{i % 7}", *(path(parent[i]) if parent[i] in parent else [])]
    calls = spark.createDataFrame([(0, 0, t, i, f"f{i % 7}", p, i * 5) for t in (1, 2) for i, p in parent.items()], "pid long, rid long, tid long, seq int, fid string, parent int, entry long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = {(r["tid"], r["seq"]): (r["entry"], r["stack"]) for r in C.stacks(calls, ("entry",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(t, i): (i * 5, path(i)) for t in (1, 2) for i in parent}


@pytest.mark.parametrize("rows", [3, 10, 40, 10**6])
def test_neighbours_across_blocks(spark, rows):
    """Long threads are cut, and windows are those of whole threads; every thread was in one task."""
    r = random.Random(rows)
    seqs = {t: sorted(r.sample(range(1000), n)) for t, n in ((0, 120), (1, 37), (2, 2))}
    calls = spark.createDataFrame([(0, 0, t, s, 1, 3 * s, 3 * s + 1) for t, own in seqs.items() for s in own], "pid long, rid long, tid long, seq int, fid long, entry long, exit long")
    blocks = C._blocks(calls, rows)
    assert (blocks.groupBy("tid", "__block").count().agg(F.max("count")).first()[0] <= 2 * rows + 1) if blocks else rows == 10**6
    got = {(r["tid"], r["seq"]): [w["seq"] for w in r["window"]] for r in C.neighbours(calls, 4, rows).collect()}
    assert got == {(t, s): own[max(0, i - 4) : i + 5] for t, own in seqs.items() for i, s in enumerate(own)}


def slow_merge(func, comm, counters):
    """At one time: entries, then messages, then counters before the first exit; with no exit after all entries."""
    out, f, m, c = [], sorted(func, key=lambda e: (e[1], e[2])), sorted(comm, key=lambda e: (e[1], e[2])), sorted(counters, key=lambda e: (e[1], e[2]))
    while f or m or c:
        least = min(x[0][1] for x in (f, m, c) if x)
        order = [f, m, c] if f and f[0][0] == "ENTRY" else [m, c, f]
        out.append(next(x for x in order if x and x[0][1] == least).pop(0))
    return out


def test_merge_of_equal_times(spark):
    r = random.Random(2)
    func = [(k, ts, i) for i, (k, ts) in enumerate([("ENTRY", 0), ("EXIT", 10), ("ENTRY", 10), ("EXIT", 20), ("ENTRY", 20), ("ENTRY", 20), ("EXIT", 20), ("ENTRY", 30), ("EXIT", 40), ("EXIT", 40)])]
    times = [0, 10, 15, 20, 30, 40, 41]
    comm, counters = ([(kind, r.choice(times), i) for i in range(12)] for kind in ("SEND", "COUNT"))
    frame = lambda rows, extra: spark.createDataFrame([(0, 0, 0, k, ts, i) for k, ts, i in rows], "pid long, rid long, tid long, kind string, ts long, idx long").withColumns(extra)
    got = C.merged(frame(func, {"fid": F.lit(1)}), frame(comm, dict.fromkeys(("tag", "partner", "bytes"), F.lit(1))), frame(counters, {"counter_id": F.lit(1), "value": F.lit(1)}).drop("kind"))
    assert [(r["kind"], r["ts"], r["idx"]) for r in got.orderBy("seq").collect()] == slow_merge(func, comm, counters)


def test_calls_that_follow_at_once(spark):
    rows = [("ENTRY", 7, 5), ("EXIT", 7, 25), ("ENTRY", 8, 25), ("EXIT", 8, 31)]
    f = spark.createDataFrame([(0, 0, 0, k, fid, ts, i) for i, (k, fid, ts) in enumerate(rows)], "pid long, rid long, tid long, kind string, fid long, ts long, idx long")
    none = f.where("false")
    m = none.selectExpr("pid", "rid", "tid", "ts", "idx", "kind", "1 AS tag", "1 AS partner", "1 AS bytes")
    calls = C.executions(C.merged(f, m, none.selectExpr("pid", "rid", "tid", "ts", "idx", "1 AS counter_id", "1 AS value")))
    assert {(r["fid"], r["entry"], r["exit"], r["parent"]) for r in calls.collect()} == {(7, 5, 25, None), (8, 25, 31, None)}
    points = spark.createDataFrame([(0, 0, 0, t) for t in (4, 5, 25, 26, 31, 32)] + [(0, 0, 1, 25)], "pid long, rid long, tid long, ts long")
    name = {r["seq"]: r["fid"] for r in calls.collect()}
    assert sorted((r["tid"], r["ts"], name.get(r["call_seq"])) for r in C.attached(points, calls, bucket=4).collect()) == [(0, 4, None), (0, 5, 7), (0, 25, 7), (0, 26, 8), (0, 31, 8), (0, 32, None), (1, 25, None)]


def test_order_and_validity(spark):
    e = spark.createDataFrame([(0, 0, 0, 8, 0), (0, 0, 0, 3, 1), (0, 0, 1, 1, 2)], "pid long, rid long, tid long, ts long, idx long")
    assert [r["ts"] for r in C.order_violations(e).collect()] == [3]
    given = T.overridden(e, pid=4).withColumn("pid", F.when(F.col("tid") == 1, 5_000_000).otherwise(F.col("pid"))).withColumn("ts", F.when(F.col("idx") == 1, -3).otherwise(F.col("ts")))
    good, bad = T.validated(given, pid=4)
    assert good.count() == 1 and bad.count() == 2
    assert {r["reason"]: r["n"] for r in T.rejects(given, pid=4).collect()} == {"pid": 1, "ts": 1}
    assert [r["seq"] for r in T.ordered(e).orderBy("tid", "idx").collect()] == [2, 1, 1]


def test_windows_and_retention(spark):
    calls = spark.createDataFrame([(0, 0, 0, i, 1, 50 * i, 50 * i + 20) for i in range(6)] + [(0, 0, 1, 0, 1, 7, 9)], "pid long, rid long, tid long, seq int, fid long, entry long, exit long")
    got = {(r["tid"], r["seq"]): [w["seq"] for w in r["window"]] for r in C.neighbours(calls, 2).collect()}
    assert got[0, 3] == [1, 2, 3, 4, 5] and got[0, 0] == [0, 1, 2] and got[1, 0] == [0]
    assert C.retained(calls, 4).count() == 5
    windows = spark.createDataFrame([(0, 0, 0, "a", 0, 100), (0, 0, 0, "b", 50, 250), (0, 0, 1, "c", 8, 8)], "pid long, rid long, tid long, w string, t0 long, t1 long")
    points = calls.selectExpr("pid", "rid", "tid", "entry AS ts")
    hit = Counter(r["w"] for r in C.in_window(points, windows, bucket=30).collect())
    assert hit == {"a": 3, "b": 5}
    with pytest.raises(Exception, match="before it begins"):
        C.in_window(points, windows.withColumn("t1", F.lit(-1))).collect()


def test_what_state_stays(spark):
    rows = [(0, 1, 90, 10, 1), (1, 2, 30, 4, 1), (2, 3, 20, 3, 0), (4, 40, 60, 7, 1), (5, 45, 50, 6, 1), (9, 70, 80, 10, 1), (20, 95, 0, None, 1), (21, 96, 97, 22, 1)]
    calls = spark.createDataFrame([(0, 0, 0, *r) for r in rows], "pid long, rid long, tid long, seq int, entry long, exit long, exit_seq int, label int")
    kept = {r["seq"]: r["kept"] for r in C.retention(calls, 1).collect()}
    assert kept == {0: "protected", 1: "protected", 2: "unlabelled", 4: None, 5: None, 9: None, 20: "incomplete", 21: "window"}
    wait = spark.createDataFrame([(0, 0, 0, 5)], "pid long, rid long, tid long, seq int")
    partner = spark.createDataFrame([(0, 0, 0, 9, 0, 2)], "pid long, rid long, tid long, seq int, other_tid long, other_seq int")
    kept = {r["seq"]: r["kept"] for r in C.retention(calls, 1, wait, partner).collect()}
    assert (kept[4], kept[5], kept[9]) == ("protected", "protected", "protected")
    r = C.retention_report(C.retention(calls, 1)).first()
    assert (r["n_purged"], r["n_kept_protected"], r["n_kept_incomplete"], r["n_kept_window"], r["n_kept_unlabelled"]) == (3, 2, 1, 1, 1)


def test_what_state_stays_in_a_long_thread(spark):
    """Time in proportion to the thread: frames that are read anew for each call took minutes."""
    calls = spark.range(100_000).selectExpr("0L AS pid", "0L AS rid", "0L AS tid", "CAST(id * 2 AS INT) AS seq", "id * 10 AS entry", "id * 10 + 5 AS exit", "CAST(id * 2 + 1 AS INT) AS exit_seq", "CAST(id % 1000 <> 0 AS INT) AS label")
    began = time.time()
    r = C.retention_report(C.retention(calls, 4)).first()
    assert time.time() - began < 30
    assert (r["n_purged"], r["n_kept_protected"], r["n_kept_window"], r["n_kept_unlabelled"]) == (99_896, 0, 4, 100)


def test_call_lookup(spark):
    calls = spark.createDataFrame([(0, 0, 1, 4, 0)], "pid long, rid long, tid long, seq int, exit long")
    more = C.registered(calls, calls.withColumn("seq", F.lit(5)))
    assert more.count() == 2 and C.call(more, 0, 0, 1, 5)["seq"] == 5 and C.list_sizes(more).first()["open"] == 2
    with pytest.raises(Exception, match="there already"):
        C.registered(calls, calls).collect()
    with pytest.raises(LookupError):
        C.call(calls, 0, 0, 1, 9)


def test_points_of_wanted_calls(spark):
    """Points near wanted calls are attached as all are, with columns of the call, in one shuffle of points."""
    r = random.Random(3)
    calls = [(0, 0, t, i, 40 * i, 40 * i + r.choice((5, 90, 400)), f"f{i}") for t in range(2) for i in range(50)]
    calls = spark.createDataFrame(calls, "pid long, rid long, tid long, seq int, entry long, exit long, fid string")
    points = spark.createDataFrame([(0, 0, i % 2, r.randrange(2100)) for i in range(300)], "pid long, rid long, tid long, ts long")
    rows = lambda df: Counter(tuple(r) for r in df.select("tid", "ts", "call_seq", "fid").collect())
    whole = rows(C.attached(points, calls, 100, ("fid",)))
    assert all((seq is None) == (fid is None) and fid in (None, f"f{seq}") for _, _, seq, fid in whole) and sum(whole.values()) == 300
    near = rows(C.attached(points, calls, 100, ("fid",), calls.where("seq % 10 = 3")))
    assert near <= whole and all(near[k] == n for k, n in whole.items() if k[2] is not None and k[2] % 10 == 3) and sum(near.values()) < 300


def test_merge_shuffles_rows_once(spark):
    e = spark.range(9).selectExpr("id % 2 AS pid", "id % 3 AS rid", "id AS tid", "id AS ts", "id AS idx", "1 AS fid", "'EXIT' AS kind", "1 AS tag", "1 AS partner", "1 AS bytes", "1 AS counter_id", "1 AS value")
    plan = C.merged(e, e, e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_members_of_records(spark):
    """Windows look at the calls around outliers only, and find the same."""
    r = random.Random(12)
    rows = [(0, 0, t, i, "f", 10 * i, 10 * i + 9, -1 if r.random() < 0.1 else 1, None) for t in range(3) for i in range(120)]
    e = spark.createDataFrame(rows, "pid long, rid long, tid long, seq int, fid string, entry long, exit long, label int, parent int")
    m = spark.createDataFrame([], "pid long, rid long, tid long, ts long, kind string, partner long, tag long, bytes long, call_seq int")
    bad = {(x[2], x[3]) for x in rows if x[7] == -1}
    got = {(x["tid"], x["seq"]): [w["seq"] for w in x["exec_window"]] for x in P.windows(e, m, 3).collect()}
    assert got == {(t, i): list(range(max(0, i - 3), min(120, i + 4))) for t, i in bad}
    assert {(x["tid"], x["seq"]) for x in P.members(e, 3).collect()} == {(t, j) for (t, _), w in got.items() for j in w if (t, j) in {(x[2], x[3]) for x in rows}} & {(t, j) for t, i in bad for j in range(i - 3, i + 4)}


def test_correlations(spark):
    pairs = spark.createDataFrame([(0, 0, t, s, v) for t, s, v in [(0, 1, 600), (0, 2, 700), (5, 1, 600), (5, 2, 700), (0, 3, 800)]] + [(0, 1, 0, 1, 800)], "pid long, rid long, tid long, seq long, value long")
    assert {(r["value"], tuple(r["a"]), tuple(r["b"])) for r in C.correlated(pairs).collect()} == {(600, (0, 1), (5, 1)), (700, (0, 2), (5, 2))}
    assert {(r["rid"], r["value"]) for r in C.unmatched(pairs).collect()} == {(0, 800), (1, 800)}
    twice = pairs.unionByName(spark.createDataFrame([(0, 0, 5, 1, 900)], pairs.schema))
    assert [(r["tid"], r["seq"], r["n"]) for r in C.several_ids(twice, spark.createDataFrame([(0, 0, 5)], "pid long, rid long, tid long")).collect()] == [(5, 1, 2)]


def test_host_parents(spark):
    execs = spark.createDataFrame([(0, 0, 2, 1, "main", ["main"]), (0, 0, 2, 2, "launch", ["launch", "main"]), (0, 0, 6, 1, "k1", ["k1"]), (0, 0, 6, 2, "k2", ["k2"]), (0, 0, 6, 3, "k3", ["k3"]), (0, 0, 6, 4, "k4", ["k4"])], "pid long, rid long, tid long, seq long, fid string, stack array<string>")
    pair = "pid long, rid long, a struct<tid:long,seq:long>, b struct<tid:long,seq:long>"
    partners = spark.createDataFrame([(0, 0, (2, 2), (6, 1)), (0, 0, (2, 1), (6, 2)), (0, 0, (2, 2), (6, 2)), (0, 0, (2, 77), (6, 4))], pair)
    threads = spark.createDataFrame([(0, 0, 6, 3)], "pid long, rid long, tid long, device long")
    got = {r["fid"]: (r["host_fid"], r["host_stack"], r["error"], r["device"]) for r in P.host_parents(execs, partners, threads, execs).collect()}
    assert got == {"k1": ("launch", ["launch", "main"], None, 3), "k2": (None, None, P.SEVERAL, 3), "k3": (None, None, P.NO_ID, 3), "k4": (None, None, P.GONE, 3)}


# -- provenance


def test_metadata_and_state(spark):
    rows = [(0, 0, 4, d, v) for d, v in (("CUDA Context", "5"), ("CUDA Device", "6"), ("CUDA Stream", "8"), ("GPU[2] Cores", "108"), ("GPU[2] Memory Bus", "wide"), ("Hostname", "c17"))]
    md = spark.createDataFrame([*rows, (0, 3, 0, "Else", "y")], T.METADATA)
    t = P.gpu_threads(md).first()
    assert (t["tid"], t["device"], t["context"], t["stream"]) == (4, 6, 5, 8)
    assert {(r["device"], r["key"], r["value"]) for r in P.gpu_properties(md).collect()} == {(2, "Cores", "108"), (2, "Memory Bus", "wide")}
    assert {r["rid"]: r["hostname"] for r in P.hostnames(md).collect()} == {0: "c17", 3: "Unknown"}
    names = spark.createDataFrame([("monitoring: cpu user",), ("bytes",)], "name string")
    assert P.watched_by_prefix(names).first()["field"] == "cpu user"
    counters = spark.createDataFrame([(0, 0, "heat", 40, 3), (0, 0, "heat", 55, 9), (0, 0, "noise", 1, 12)], "pid long, rid long, counter string, value long, ts long")
    r = P.node_state(counters, spark.createDataFrame([("heat", "temperature")], "counter string, field string")).first()
    assert (r["field"], r["value"], r["ts"]) == ("temperature", 55, 9)
    assert P.in_steps(spark.range(10).withColumnRenamed("id", "step"), 3, 5).count() == 3


def slow_examples(rows):
    """Normal examples step by step; rows: (id, tid, step, label, score, entry)."""
    cache, waiting, out = {}, set(), []
    for step in sorted({r[2] for r in rows}):
        now = [r for r in rows if r[2] == step]
        for tid in sorted({r[1] for r in now}):
            if normal := sorted((r[4], r[0]) for r in now if r[1] == tid and r[3] == 1):
                cache[tid] = normal[0][1]
        for tid in sorted(waiting & set(cache)):
            out.append((tid, step, cache.pop(tid)))
            waiting.discard(tid)
        if bad := sorted((r[5], r[0], r[1]) for r in now if r[3] == -1):
            tid = bad[0][2]
            if tid in cache:
                out.append((tid, step, cache.pop(tid)))
            else:
                waiting.add(tid)
    return sorted(out)


def test_normal_examples(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.randrange(3), r.randrange(12), r.choice((1, 1, 0, -1, -1)), round(r.random(), 3), i * 7 % 101) for i in range(60)]
    e = spark.createDataFrame([(0, 0, t, "f", i, s, lab, sc, en, 10.0) for i, t, s, lab, sc, en in rows], "pid long, rid long, tid long, func string, id long, step int, label int, score double, entry long, exclusive double")
    want = slow_examples(rows)
    assert sorted((r["tid"], r["step"], r["example"]) for r in P.normal_examples(e).collect()) == want
    state, got = spark.createDataFrame([], "pid long, rid long, tid long, func string, cache long, waiting boolean"), []
    for step in range(12):
        state = spark.createDataFrame(P.next_examples(state, e.where(F.col("step") == step)).collect(), "pid long, rid long, tid long, func string, example long, cache long, waiting boolean")
        got += [(r["tid"], step, r["example"]) for r in state.where("example IS NOT NULL").collect()]
        state = state.drop("example")
    assert sorted(got) == want


def test_records(spark):
    e = spark.createDataFrame([(0, 0, 0, 1, "main", 10, 99, 1, None, ["main"]), (0, 0, 0, 2, "g", 20, 40, -1, 1, ["g", "main"]), (0, 0, 0, 3, "g", 50, 90, -1, 1, ["g", "main"])], "pid long, rid long, tid long, seq int, fid string, entry long, exit long, label int, parent int, stack array<string>")
    e = e.withColumn("exclusive", F.col("exit") - F.col("entry")).withColumn("score", F.lit(2.0))
    m = spark.createDataFrame([(0, 0, 0, 15, "SEND", 9, 1, 3, 1), (0, 0, 0, 30, "RECV", 9, 1, 4, 2)], "pid long, rid long, tid long, ts long, kind string, partner long, tag long, bytes long, call_seq int")
    c = spark.createDataFrame([(0, 0, 0, 60, 2, 71, 3)], "pid long, rid long, tid long, ts long, counter_id long, value long, call_seq int")
    names = spark.createDataFrame([("g", "void g()")], "fid string, name string")
    got = {r["seq"]: r for r in P.records(e, c, m, window=1, stacks=e, names=names).collect()}
    assert [w["seq"] for w in got[2]["exec_window"]] == [1, 2, 3] and [x["bytes"] for x in got[2]["comm_window"]] == [3, 4] and got[2]["counter_events"] is None
    assert got[3]["stack"] == ["g", "main"] and [x["bytes"] for x in got[3]["comm_window"]] == [4] and got[3]["counter_events"][0]["value"] == 71 and got[3]["func_name"] == "void g()"
    assert {r["seq"] for r in P.records(e, c, m, minimum=30, stacks=e).collect()} == {3}
    views = D.normalised(P.records(e, c, m, stacks=e).withColumn("step", F.lit(0)))
    assert views["call_stacks"].count() == 4 and views["anomalies"].count() == 2 and views["io_steps"].count() == 1 and views["counter_values"].where("ts IS NOT NULL").count() == 1


def test_runs_with_groups_of_no_time(spark):
    run = lambda *rows: spark.createDataFrame(list(rows), "func string, tid long, calls long, total double, count long, severity double")
    a, b = run(("f", 1, 2, 0.0, 0, 0.0), ("g", 1, 2, 8.0, 1, 4.0)), run(("f", 1, 4, 5.0, 1, 5.0), ("h", 1, 0, 0.0, 1, 1.0))
    got = [(r["func"], r["relative_a"], r["frequency_a"], r["relative_b"], r["frequency_b"]) for r in D.between_runs(a, b, ["func", "tid"], "severity").collect()]
    assert str(got) == str([("f", math.nan, 0.0, 1.0, 25.0), ("g", 0.5, 50.0, None, None), ("h", None, None, math.inf, math.inf)])


def test_anomaly_metrics_over_steps(spark):
    e = spark.createDataFrame([(0, 0, s, "f", en, en + 30, 30.0, x, lab, sc) for s, en, x, lab, sc in [(4, 10, 20.0, -1, 7.0), (4, 60, 30.0, -1, 9.0), (5, 95, 1.0, 1, 0.2), (6, 200, 50.0, -1, 8.0)]], "pid long, rid long, step int, func string, entry long, exit long, runtime double, exclusive double, label int, score double")
    r = S.rolled_metrics(e, ["pid", "rid", "func"]).first()
    assert (r["count"]["mean"], r["score"]["mean"], r["severity"]["accumulate"], r["min_ts"], r["max_ts"], r["first_step"], r["last_step"]) == (1.5, 8.0, 100.0, 10, 230, 4, 6)
    assert {r["step"]: r["n_anomalies"] for r in S.anomaly_data(e).collect()} == {4: 2, 5: 0, 6: 1}
    a = S.rank_anomalies(e, 4).first()
    assert [p["step"] for p in a["packets"]] == [5, 6] and a["anomaly_count"]["accumulate"] == 3
    m = S.recent_metrics(e, 4).first()
    assert (m["new_data"]["score"]["count"], m["all_data"]["score"]["count"]) == (1, 3)


# -- collections, sources and sinks


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, i % 5, i % 3, "func" + "ab"[i % 2], float(i), i * 10) for i in range(30)], "id long, pid long, rid long, step int, func string, score double, entry long")
    root = str(tmp_path)
    for _ in range(2):
        D.append(rows, root, "anomalies", shards=4)
    got = D.load(spark, root, "anomalies")
    assert got.count() == 60 and "PartitionFilters: [isnotnull(shard" in got.where("shard = 1")._jdf.queryExecution().toString()
    assert D.select(rows, [("func", "contains", "b"), "and", "(", ("id", "<", 5), "or", ("id", ">=", 29), ")"]).count() == 3
    assert D.select(rows, "score > 27", ["score"]).first()["id"] == 29
    assert D.script(spark, root, "SELECT count(DISTINCT id) AS n FROM anomalies").first()["n"] == 30
    with pytest.raises(ValueError):
        D.predicate(["(", ("id", "<", 5)])
    with pytest.raises(ValueError):
        D.append(rows, root, "unknown")
    new = D.amend(rows, spark.createDataFrame([(3, 99.0)], "id long, score double"))
    assert new.where("id = 3").first()["score"] == 99.0 and new.count() == 30
    rows.write.parquet(f"{root}/func_stats")
    D.amend_stored(spark, root, "func_stats", spark.createDataFrame([(4, -1.0)], "id long, score double"))
    assert D.load(spark, root, "func_stats").where("score < 0").first()["id"] == 4 and D.load(spark, root, "func_stats").count() == 30
    assert [r["entry"] for r in D.lookup(D.index(rows, "rid"), rows.drop("entry"), 2).collect()] == [20, 70, 120, 170, 220, 270]
    lists = rows.withColumn("window", F.array(F.struct(F.lit(1).alias("fid"))))
    assert D.keys(lists, lists=True) == [*rows.columns, "window[fid]"] and D.ranking(rows, "score", 2, columns=["id"]).collect()[0]["id"] == 29
    assert lists.select(D.nested(lists, "window.fid").alias("a"), D.nested(lists, "window.none").alias("b")).first() == ([1], None)
    D.write_json(rows, root, "json")
    assert T.documents(spark, root + "/json").count() == 30
    D.write_json(rows, f"{root}/dump", "metadata")
    D.restore(spark, f"{root}/dump", root, "metadata", 3)
    back = D.load(spark, root, "metadata")
    assert back.count() == 30 and back.where("rid % 3 <> shard").isEmpty()
    text = rows.withColumns({"tid": F.lit(2), "exclusive": F.lit(4.5)}).where("id = 7").select(D.summary(rows)).first()["summary"]
    assert text == "funcb (0:2:2) 4.5 us, score 7.0"
    assert D.union_all([rows.select("id"), rows.select("id", "func")]).count() == 60


def test_sources(spark, tmp_path):
    attrs = spark.createDataFrame([(0, "timer 8", '"solve"'), (1, "timer 8", '"LATER"'), (2, "event_type 0", '"ENTRY"'), (3, "counter 6", '"Correlation ID"'), (4, "MetaData:2:5:Host:name", '"n"')], "seq int, name string, value string")
    d = T.attributes(attrs)
    assert tuple(d["functions"].first()) == (8, "solve") and T.counter_id(d["counters"]).first()["id"] == 6
    assert tuple(d["metadata"].first()) == (2, 5, "Host:name", "n")
    (tmp_path / "s.csv").write_text("timestamp,value\n2014-01-01,1.5\n2014-01-02,9\n")
    (tmp_path / "l.json").write_text('{"s.csv": ["2014-01-02"], "other": []}')
    rows = T.labelled(T.csv_series(spark, str(tmp_path / "s.csv")), str(tmp_path / "l.json"), "s.csv").collect()
    assert {r["timestamp"]: r["anomaly"] for r in rows} == {"2014-01-01": False, "2014-01-02": True}
    assert T.parameters('{"algorithm": "SSTD", "sstd_sigma": 6}')["algorithm"] == "sstd"
    for bad in ('{"algorithm": "x"}', '{"algorithm": "hbos"}'):
        with pytest.raises(ValueError):
            T.parameters(bad)
    (tmp_path / "w.json").write_text('[["monitoring: a", "a"], ["b", "c"]]')
    assert [tuple(r) for r in T.watch_list(spark, str(tmp_path / "w.json")).collect()] == [("monitoring: a", "a"), ("b", "c")]
    (tmp_path / "names").write_text("cudaFree\n\n cudaMalloc \n")
    assert {r["name"] for r in T.name_list(spark, str(tmp_path / "names")).collect()} == {"cudaFree", "cudaMalloc"}
    with pytest.raises(ValueError):
        T.from_rows(spark, [(0, 1, 0, 0, 1, 5)], T.FUNC_EVENTS, rid=2)


def test_reading_whole_traces(spark, tmp_path):
    names = spark.createDataFrame([(0, 4, "a"), (0, 5, "b")], "pid long, id long, name string")
    index = spark.createDataFrame([(9, "a", 0), (9, "b", 1)], "pid long, name string, fid long")
    rows = T.from_rows(spark, [(0, 0, 0, 0, 4, 5), (0, 0, 0, 1, 4, 9), (0, 0, 0, 0, 77, 1)], T.FUNC_EVENTS, 0, 0).withColumn("idx", F.monotonically_increasing_id())
    rows.write.parquet(str(tmp_path / "f"))
    got = T.func_events(spark, str(tmp_path / "f"), names.withColumn("pid", F.lit(9).cast("long")), index, pid=9, rid=3).orderBy("seq").collect()
    assert [(r["pid"], r["rid"], r["fid"], r["ts"], r["seq"]) for r in got] == [(9, 3, 0, 5, 1), (9, 3, 0, 9, 2)]
    T.from_rows(spark, [(0, 0, 0, 2, 1, 1, 8, 5), (0, 0, 0, 7, 1, 1, 8, 6)], T.COMM_EVENTS).write.parquet(str(tmp_path / "c"))
    kinds = spark.createDataFrame([(2, "SEND"), (7, "BARRIER")], "id long, name string")
    assert [r["kind"] for r in T.comm_events(spark, str(tmp_path / "c"), kinds).collect()] == ["SEND"]
    T.from_rows(spark, [(0, 0, 0, 1, 50, 5), (0, 0, 0, 2, 60, 5)], T.COUNTER_EVENTS).write.parquet(str(tmp_path / "k"))
    dim = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    watch = spark.createDataFrame([("y", "f")], "counter string, field string")
    assert [r["value"] for r in T.counter_events(spark, str(tmp_path / "k"), dim, without=watch).collect()] == [50]
    with pytest.raises(Exception, match="no counter"):
        T.counter_events(spark, str(tmp_path / "k"), dim.where("id = 1")).collect()
    e = spark.createDataFrame([(0, 0, 5, 0), (0, 0, 9, 1)], "pid long, rid long, ts long, step int")
    assert T.replayed(e, 3, 100).agg(F.max("ts")).first()[0] == 209
    assert T.replay_files(e, str(tmp_path / "r"), 2, 50, rid=8) == 4 and spark.read.parquet(str(tmp_path / "r")).agg(F.sum("ts"), F.min("rid")).first() == (2 * 14 + 100, 8)
    assert T.frames(e, 1).count() == 1 and T.frames(e, only=1).first()["ts"] == 9


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "id long, x double")
    assert sinks.append_table(df, str(tmp_path / "t")).count() == 1 and sinks.append_table(df, str(tmp_path / "t")).count() == 2
    assert sinks.parsed_only(df) > 0
    sinks.save_global(str(tmp_path), df, df, df)
    assert spark.read.parquet(str(tmp_path / "ad_model")).count() == 1
    write = sinks.to_folder(str(tmp_path))
    write(0, "{}")
    write(0, "{}")
    assert (tmp_path / "stats_1.json").exists()
    stream = spark.readStream.schema("id long, x double").parquet(str(tmp_path / "t"))
    figures = sinks.Figures()
    spark.streams.addListener(figures)
    try:
        assert sinks.finished(stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(), 60)
        assert figures.ended.wait(30)
    finally:
        spark.streams.removeListener(figures)
    assert json.loads(figures.text())["rows"]["accumulate"] == 2 and json.loads(figures.text())["resident_kB"]["maximum"] > 1000
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start()
    assert not sinks.stopped_with(spark, 2, 1) and sinks.stopped_with(spark, 2, 2) and not q.isActive
    assert sinks.observed(df.withColumn("label", F.lit(-1))).count() == 1
    assert sinks.finished(sinks.viewed(stream), 60)


def test_scalars(spark):
    df = spark.createDataFrame([(3, 1, 7)], "rank long, step long, i long").withColumn("m", F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.lit(5))))
    r = df.select(X.event_id("rank", "step", "i").alias("id"), X.random_hex(12, 1).alias("hex"), X.lookup(F.col("m"), "a", "b").alias("v"), X.lookup(F.col("m"), "z", "b").alias("none"), X.seconds("i").alias("s"), X.epoch_ms().alias("now"), X.hashed("rank", "i").alias("h")).first()
    assert r["id"] == "3:1:7" and len(r["hex"]) == 12 and set(r["hex"]) <= set("0123456789abcdef") and (r["v"], r["none"]) == (5, None) and r["s"] == 7e-6 and r["now"] > 1.7e12
    assert X.text_table(spark.createDataFrame([("ab", 1), ("c", 22)], "k string, long_name int")) == "k  long_name\nab 1\nc  22"


# -- streams


def steps_of(spark, path, rows, schema):
    for s in sorted({r[1] for r in rows}):
        spark.createDataFrame([x for x in rows if x[1] == s], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_model_equals_batch(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [("f", s, float(v)) for s in range(4) for v in r.normal(100, 5, 200)] + [("f", 2, 400.0)]
    engine.analyse(steps_of(spark, str(tmp_path / "in"), rows, "func string, step int, x double"), str(tmp_path / "out"), ["func"], "x").awaitTermination()
    versions = engine.Versions(spark, str(tmp_path / "out/model"))
    assert versions.numbers() == [2, 3]
    model = spark.read.parquet(str(tmp_path / "out/model/v=3")).select(*R.report()).first()
    assert tuple(model) == pytest.approx(moments([x for *_, x in rows]), rel=1e-9)
    assert [x["x"] for x in spark.read.parquet(str(tmp_path / "out/outliers")).collect()] == [400.0]
    assert engine.deltas(str(tmp_path / "out"), spark, 1).count() == 2


@pytest.mark.parametrize("kind", ["hbos", "copod"])
def test_streamed_histograms_equal_batch(spark, tmp_path, kind):
    r = np.random.default_rng(3)
    rows = [("fg"[i % 2], s, float(round(v, 3)), s * 1000 + i) for s in range(3) for i, v in enumerate(r.lognormal(2, 0.5, 120))]
    schema = "func string, step int, x double, id long"
    engine.analyse(steps_of(spark, str(tmp_path / "in"), rows, schema), str(tmp_path / "out"), ["func"], "x", params=M.Params(kind)).awaitTermination()
    got = {x["id"]: x["score"] for x in spark.read.parquet(str(tmp_path / "out/outliers")).collect()}
    assert got == pytest.approx({i: s for i, (s, label) in slow_fold(rows, kind).items() if label == -1})


def test_streams_wait_for_labels_gates_and_examples(spark, tmp_path):
    rows = [(0, s, i, f, x, en) for s, i, f, x, en in [(0, 1, "lone", 5.0, 1), (0, 2, "f", 10.0, 2), (0, 3, "f", 11.0, 3), (1, 4, "lone", 6.0, 4), (1, 5, "f", 10.0, 5), (2, 6, "f", 12.0, 6), (3, 7, "f", 11.0, 7)]]
    stream = steps_of(spark, str(tmp_path / "in"), rows, "tid long, step int, id long, func string, exclusive double, entry long").withColumns({"pid": F.lit(0).cast("long"), "rid": F.lit(0).cast("long")})
    root = str(tmp_path / "out")
    engine.analyse(stream, root, ["func"], "exclusive", sigma=0.9, examples=P.KEYS).awaitTermination()
    pending = engine.Versions(spark, f"{root}/pending")
    assert [x["id"] for x in pending.before(1).collect()] == [1] if 0 in pending.numbers() else True
    stats = {(x["step"], x["func"]): x["n"] for x in spark.read.parquet(f"{root}/stats").collect()}
    assert (0, "lone") not in stats and stats[1, "lone"] == 2 and stats[0, "f"] == 2
    found = spark.read.parquet(f"{root}/outliers").count()
    assert found and spark.read.parquet(f"{root}/examples").count() <= found
    gated = str(tmp_path / "gated")
    engine.analyse(stream, gated, ["func"], "exclusive", every=2, ignored=["lone"]).awaitTermination()
    assert {x["step"] for x in spark.read.parquet(f"{gated}/stats").collect()} == {1, 3} and spark.read.parquet(f"{gated}/stats").agg(F.sum("n")).first()[0] == len(rows)


def test_streamed_call_stacks_carry_over(spark, tmp_path):
    schema = "pid long, rid long, tid long, kind string, fid long, ts long, idx long"
    for part in ([("ENTRY", 4, 2), ("ENTRY", 5, 6)], [("EXIT", 5, 9), ("EXIT", 6, 12), ("EXIT", 4, 20), ("EXIT", 4, 21)]):
        spark.createDataFrame([(0, 0, 0, k, f, t, t) for k, f, t in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = engine.call_stacks(stream).writeStream.format("memory").queryName("calls_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["fid"], r["runtime"], r["exclusive"], r["error"]) for r in spark.sql("SELECT * FROM calls_out").collect()]
    assert sorted(got, key=str) == [(4, 0, 0, C.NO_CALL), (4, 18, 15, None), (5, 3, 3, None), (6, 0, 0, C.WRONG_CALL)]


def test_latest_and_time_windows(spark, tmp_path):
    rows = pd.DataFrame({"pid": 0, "rid": 0, "counter": ["a", "a", "b"], "value": [3, 9, 1], "ts": [10, 30, 20]})
    assert {r["counter"]: r["value"] for r in engine.latest(spark.createDataFrame(rows)).collect()} == {"a": 9, "b": 1}
    e = spark.createDataFrame([("f", 1.0, 5), ("f", 2.0, 59), ("f", 4.0, 61)], "func string, exclusive double, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r["n"], r["total"]) for r in engine.windowed(e).collect()) == [(1, 4.0), (2, 3.0)]
