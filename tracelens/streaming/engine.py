"""Step-by-step analysis as a stream: each micro-batch is one step.

``analyse`` keeps the model in a table of the shared folder: every batch adds what it has
learnt to the model, is scored by it, and appends outliers and statistics. Executions that
can't be labelled yet, and batches that a gate holds back, wait in a table for a later batch;
so do outliers that no normal execution is known for. ``call_stacks`` keeps open calls per
thread in keyed state, so that a call ends in the step of its exit.

State tables have a version for each batch, and the last two are kept: a batch that is run
again reads the state before it and replaces its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelens.functions import runstats as R
from tracelens.operators import models as M
from tracelens.operators import provenance as P
from tracelens.operators.calltree import NO_CALL, WRONG_CALL


class Versions:
    """A table with a version for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        p = self._path(self.path)
        return sorted(int(s.getPath().getName()[2:]) for s in self.fs.listStatus(p) if s.getPath().getName().startswith("v=")) if self.fs.exists(p) else []

    def before(self, number: int) -> DataFrame | None:
        older = [n for n in self.numbers() if n < number]
        return self.spark.read.parquet(f"{self.path}/v={older[-1]}") if older else None

    def write(self, df: DataFrame, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for n in [n for n in self.numbers() if n < number][:-1]:
            self.fs.delete(self._path(f"{self.path}/v={n}"), True)
        return self.spark.read.parquet(f"{self.path}/v={number}")


def analyse(
    stream: DataFrame, root: str, keys: list[str], x: str, sigma: float = 6.0, frozen: bool = False, checkpoint: str | None = None, params: M.Params | None = None,
    every: int = 1, sync: int = 1, examples: tuple[str, ...] | None = None, ignored: list[str] | None = None,
) -> StreamingQuery:
    """Labels every batch by the model that includes it; writes model/v=<batch>, outliers, stats and examples under ``root``.

    The algorithm is that of ``params`` (standard deviations by default). With ``every`` batches are analysed together, every so
    many; with ``sync`` the model learns in every so many (the first always; 0, or ``frozen``, keeps a stored model as it is).
    Executions without a label are offered again with the next batch. ``examples`` are the keys that outliers find normal executions by
    (needs id, entry and exclusive). A batch's outputs are written under its number and replaced when it is run again.
    """
    params = params or M.Params("sstd", sstd_sigma=sigma)
    ignored = ignored or []

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        model_v, wait_v = Versions(spark, f"{root}/model"), Versions(spark, f"{root}/pending")
        held = wait_v.before(number)
        rows = batch if held is None else batch.unionByName(held)
        if (number + 1) % every:
            wait_v.write(rows, number)
            return
        rows = rows.persist()
        learn = rows.where(~F.col(keys[0]).isin(*ignored)) if ignored else rows
        stored = model_v.before(number)
        keep = stored is not None and (frozen or not M.synced(number, 0, sync))
        if params.algorithm == "sstd":
            own = stored if keep else R.collect(learn, keys, x) if stored is None else R.merge(stored.unionByName(R.collect(learn, keys, x)), keys)
            model = model_v.write(own, number)
            known = model.select(*keys, F.col("state.n").alias("n"), F.col("state.mean").alias("mean"), R.report()[5].alias("sd"))
            scored = M.sstd_label(rows.join(known, keys, "left"), x, params.sstd_sigma).withColumn("label", F.coalesce("label", F.lit(0)))
        else:
            if not keep:
                new = M.step_models(learn.withColumn("__step", F.lit(number)), keys[0], "__step", x, params, stored).drop("__step")
                stored = new if stored is None else new.unionByName(stored.join(learn.select(keys[0]).distinct(), keys[0], "left_anti"))
            model = model_v.write(stored, number)
            scored = M.scored(rows, [keys[0]], x, model, params.algorithm == "copod")
        if ignored:
            known = F.col(keys[0]).isin(*ignored)
            scored = scored.withColumn("label", F.when(known, M.NORMAL).otherwise(F.col("label"))).withColumn("score", F.when(known, 0.0).otherwise(F.col("score")))
        scored = scored.withColumn("step", F.lit(number)).persist()
        wait_v.write(scored.where("label = 0").select(*batch.columns), number)
        scored.where(F.col("label") == M.OUTLIER).write.mode("overwrite").parquet(f"{root}/outliers/step={number}")
        scored.where("label <> 0").groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("label") == M.OUTLIER).cast("long")).alias("n_anomaly")).write.mode("overwrite").parquet(f"{root}/stats/step={number}")
        if examples:
            example_v = Versions(spark, f"{root}/requests")
            empty = spark.createDataFrame([], scored.select(*examples, F.col("id").alias("cache"), F.lit(False).alias("waiting")).schema)
            state = example_v.before(number)
            after = P.next_examples(empty if state is None else state.drop("example"), scored, examples)
            new = example_v.write(after.where("example IS NOT NULL OR cache IS NOT NULL OR waiting"), number)
            new.where("example IS NOT NULL").select(*examples, "example").write.mode("overwrite").parquet(f"{root}/examples/step={number}")
        scored.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start()


def deltas(root: str, spark: SparkSession, last: int) -> DataFrame:
    """Statistics of the steps after the last emission."""
    return spark.read.parquet(f"{root}/stats").where(F.col("step") > last)


CALLS = "pid long, rid long, tid long, fid long, entry long, exit long, runtime long, exclusive long, error string"
_STATE = "fids array<long>, entries array<long>, inner array<long>"


def call_stacks(events: DataFrame) -> DataFrame:
    """Finished calls of a stream of entries and exits; calls stay open over batches. An exit without its call is a row with an ``error``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = [list(x) for x in zip(*(list(v) for v in state.get), strict=True)] if state.exists else []
        out = []
        for kind, fid, ts in pd.concat(list(parts)).sort_values(["ts", "idx"])[["kind", "fid", "ts"]].itertuples(index=False):
            if kind == "ENTRY":
                stack.append([fid, ts, 0])
            elif stack and stack[-1][0] == fid and ts >= stack[-1][1]:
                _, entry, inner = stack.pop()
                out.append((*key, fid, entry, ts, ts - entry, ts - entry - inner, None))
                if stack:
                    stack[-1][2] += ts - entry
            else:
                out.append((*key, fid, ts, ts, 0, 0, WRONG_CALL if stack else NO_CALL))
        state.update(tuple([int(s[i]) for s in stack] for i in range(3)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLS.split(", ")])

    return events.groupBy("pid", "rid", "tid").applyInPandasWithState(run, CALLS, _STATE, "append", GroupStateTimeout.NoTimeout)


def latest(counters: DataFrame) -> DataFrame:
    """Latest value of each counter of a stream, in update mode."""
    return counters.groupBy("pid", "rid", "counter").agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def windowed(events: DataFrame, size: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per function and time window, for streams that have no steps of their own."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "func").agg(F.count("*").alias("n"), F.sum("exclusive").alias("total"))
