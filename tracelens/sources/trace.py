"""Trace sources: event tables, dictionaries, metadata, label files, model and parameter files."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONGS = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
FUNC_EVENTS = _LONGS("pid", "rid", "tid", "eid", "fid", "ts")
COMM_EVENTS = _LONGS("pid", "rid", "tid", "eid", "tag", "partner", "bytes", "ts")
COUNTER_EVENTS = _LONGS("pid", "rid", "tid", "counter_id", "value", "ts")
METADATA = T.StructType([*_LONGS("pid", "rid", "tid"), T.StructField("descr", T.StringType()), T.StructField("value", T.StringType())])
KINDS = ["ENTRY", "EXIT", "SEND", "RECV"]
#: Ids from here on aren't valid.
ID_LIMIT = 1_000_000


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A finished trace."""
    return spark.read.schema(schema).format(fmt).load(path)


def stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_step: int = 1) -> DataFrame:
    """A growing trace: each trigger takes the next files as one step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).format(fmt).load(path)


def attributes(attrs: DataFrame) -> dict[str, DataFrame]:
    """Dictionaries from attribute rows (name, value): functions, event_types, counters, metadata; the first value of a name wins."""
    first = attrs.groupBy("name").agg(F.min_by("value", "seq").alias("value")).withColumn("value", F.regexp_replace("value", '^"|"$', ""))

    def numbered(kind: str) -> DataFrame:
        return first.where(F.col("name").rlike(f"^{kind} \\d+$")).select(F.regexp_extract("name", "(\\d+)$", 1).cast("long").alias("id"), F.col("value").alias("name"))

    parts = F.split("name", ":", 4)
    metadata = first.where(F.col("name").startswith("MetaData:")).select(parts[1].cast("long").alias("rid"), parts[2].cast("long").alias("tid"), parts[3].alias("descr"), "value")
    return {"functions": numbered("timer"), "event_types": numbered("event_type"), "counters": numbered("counter"), "metadata": metadata}


def validated(events: DataFrame, pid: int | None = None, rid: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): ids in range and, where given, those of this program and rank."""
    good = (F.col("pid") <= ID_LIMIT) & (F.col("tid") < ID_LIMIT) & (F.col("ts") >= 0)
    if pid is not None:
        good &= F.col("pid") == pid
    if rid is not None:
        good &= F.col("rid") == rid
    good = F.coalesce(good, F.lit(False))
    return events.where(good), events.where(~good)


#: Why an event isn't taken.
REJECTED = ("pid", "tid", "ts", "program", "rank")


def rejects(events: DataFrame, pid: int | None = None, rid: int | None = None) -> DataFrame:
    """How many events are rejected, by the first reason that holds: reason, n."""
    why = F.when(~F.coalesce(F.col("pid") <= ID_LIMIT, F.lit(False)), "pid").when(~F.coalesce(F.col("tid") < ID_LIMIT, F.lit(False)), "tid").when(~F.coalesce(F.col("ts") >= 0, F.lit(False)), "ts")
    if pid is not None:
        why = why.when(~F.col("pid").eqNullSafe(F.lit(pid)), "program")
    if rid is not None:
        why = why.when(~F.col("rid").eqNullSafe(F.lit(rid)), "rank")
    return events.select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


#: Outcomes of taking an event.
OK, UNKNOWN_EVENT, UNKNOWN_FUNC = "OK", "UnknownEvent", "UnknownFunc"


def typed(events: DataFrame, event_types: DataFrame, functions: DataFrame) -> DataFrame:
    """Function events with ``kind`` and ``func`` by their ids, and ``outcome``: whether type and function are known. Nothing is dropped."""
    kinds = event_types.select(F.col("id").alias("eid"), F.col("name").alias("kind"))
    names = functions.select(F.col("id").alias("fid"), F.col("name").alias("func"))
    out = events.join(kinds, "eid", "left").join(names, "fid", "left")
    bad = ~F.coalesce(F.col("kind").isin("ENTRY", "EXIT"), F.lit(False))
    return out.withColumn("outcome", F.when(bad, UNKNOWN_EVENT).when(F.col("func").isNull(), UNKNOWN_FUNC).otherwise(OK))


def func_events(spark: SparkSession, path: str, local: DataFrame, index: DataFrame, pid: int | None = None, rid: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Function events of a trace: ids overridden where given, local functions made global, each thread in order of (ts, idx)."""
    from tracelens.operators import dictionary

    rows = read(spark, path, T.StructType([*FUNC_EVENTS.fields, T.StructField("idx", T.LongType())]), fmt)
    known, _ = dictionary.resolved(overridden(rows, pid, rid), local, index)
    return ordered(known)


def ordered(events: DataFrame) -> DataFrame:
    """``seq``: the place of an event in its thread by time; events of one time keep their order (idx)."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("pid", "rid", "tid").orderBy("ts", "idx")))


def comm_events(spark: SparkSession, path: str, event_types: DataFrame, pid: int | None = None, rid: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Messages of a trace; those of a type that isn't SEND or RECV are left out."""
    kinds = event_types.where(F.col("name").isin("SEND", "RECV")).select(F.col("id").alias("eid"), F.col("name").alias("kind"))
    return overridden(read(spark, path, COMM_EVENTS, fmt), pid, rid).join(F.broadcast(kinds), "eid")


def counter_events(spark: SparkSession, path: str, counters: DataFrame, pid: int | None = None, rid: int | None = None, fmt: str = "parquet", without: DataFrame | None = None) -> DataFrame:
    """Counters of a trace with their names; those of ``without`` (counter), which give the node state, are left out."""
    out = named_counters(overridden(read(spark, path, COUNTER_EVENTS, fmt), pid, rid), counters)
    return out if without is None else unwatched(out, without)


def named_counters(events: DataFrame, counters: DataFrame) -> DataFrame:
    """Counter events with ``counter``, the name of their id; an id that the dictionary doesn't have is an error."""
    names = counters.select(F.col("id").alias("counter_id"), F.col("name").alias("counter"))
    both = events.join(names, "counter_id", "left")
    return both.withColumn("counter", F.when(F.col("counter").isNull(), F.raise_error(F.concat(F.lit("no counter "), F.col("counter_id").cast("string")))).otherwise(F.col("counter")))


def unwatched(counters: DataFrame, watch: DataFrame) -> DataFrame:
    """Counters that aren't watched for the node state: only these belong to calls."""
    return counters.join(watch.select("counter"), "counter", "left_anti")


def counter_id(counters: DataFrame, name: str = "Correlation ID") -> DataFrame:
    """The id of a counter by its name."""
    return counters.where(F.col("name") == name).select("id")


def from_rows(spark: SparkSession, rows: list, schema: T.StructType, pid: int | None = None, rid: int | None = None) -> DataFrame:
    """A source from rows in memory; a row of another program or rank is an error."""
    names = schema.fieldNames()
    for r in rows:
        for name, want in (("pid", pid), ("rid", rid)):
            if want is not None and r[names.index(name)] != want:
                raise ValueError(f"{name} {r[names.index(name)]} isn't {want}")
    return spark.createDataFrame(rows, schema)


def described(df: DataFrame) -> DataFrame:
    """Variables of a source: name, type, rows that have a value, least and greatest value as text."""
    out = df.agg(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.count(n).alias("n"), F.min(F.col(n).cast("string")).alias("low"), F.max(F.col(n).cast("string")).alias("high")).alias(n) for n, t in df.dtypes))
    return out.select(F.explode(F.array(*df.columns)).alias("v")).select("v.*")


def watch_list(spark: SparkSession, path: str) -> DataFrame:
    """Watched counters from a JSON file [[counter, field], ...]."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    return pairs.select(F.col("p")[0].alias("counter"), F.col("p")[1].alias("field"))


def analysis_batches(events: DataFrame, every: int) -> DataFrame:
    """``batch``: steps are analysed together, ``every`` of them at a time."""
    return events.withColumn("batch", F.floor(F.col("step") / F.lit(every)).cast("long"))


def frames(events: DataFrame, most: int = -1, only: int | None = None) -> DataFrame:
    """The first ``most`` steps (-1: all), or one of them alone."""
    out = events if most < 0 else events.where(F.col("step") < most)
    return out if only is None else out.where(F.col("step") == only)


def runtimes(execs: DataFrame, key: str = "func") -> DataFrame:
    """Exclusive times of each function, one row for each call, sorted: a dump of any length stays rows."""
    return execs.select(key, "exclusive").repartitionByRange(key, "exclusive").sortWithinPartitions(key, "exclusive")


def overridden(events: DataFrame, pid: int | None = None, rid: int | None = None) -> DataFrame:
    """Program and rank columns replaced where given."""
    given = {k: F.lit(v).cast("long") for k, v in (("pid", pid), ("rid", rid)) if v is not None}
    return events.withColumns(given) if given else events


def replayed(events: DataFrame, times: int, period: int, rid: int | None = None) -> DataFrame:
    """The events again and again, each round later by ``period``."""
    rounds = events.withColumn("replay", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return overridden(rounds.withColumn("ts", F.col("ts") + F.col("replay") * period), rid=rid)


def replay_files(events: DataFrame, folder: str, times: int, period: int, seconds: float = 0.0, rid: int | None = None) -> int:
    """Writes the steps of a trace one after another into a folder that a stream reads, each round later by ``period``; waits between steps."""
    steps = [r["step"] for r in events.select("step").distinct().orderBy("step").collect()]  # as many as the trace has steps
    for k in range(times):
        for s in steps:
            shifted = overridden(events.where(F.col("step") == s).withColumn("ts", F.col("ts") + k * period), rid=rid)
            shifted.withColumn("replay", F.lit(k)).write.mode("append").parquet(folder)
            time.sleep(seconds)
    return times * len(steps)


def csv_series(spark: SparkSession, path: str) -> DataFrame:
    """A time series with columns timestamp, value."""
    return spark.read.option("header", True).schema("timestamp string, value double").csv(path)


def labelled(series: DataFrame, labels_path: str, dataset: str) -> DataFrame:
    """Adds ``anomaly``: the timestamp is listed for this data set in the JSON file {dataset: [timestamp, ...]}."""
    spark = series.sparkSession
    text = spark.read.text(labels_path, wholetext=True)
    listed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "v")).where(F.col("k") == dataset).select(F.explode("v").alias("timestamp")).distinct()
    return series.join(listed.withColumn("anomaly", F.lit(True)), "timestamp", "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(False)))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


REQUIRED = {"sstd": ("sstd_sigma",), "hbos": ("hbos_thres", "glob_thres", "hbos_max_bins"), "copod": ("hbos_thres",)}


def parameters(text: str) -> dict:
    """Algorithm parameters from JSON; the keys that the algorithm needs must be there."""
    given = json.loads(text)
    kind = str(given.get("algorithm", "")).lower()
    if kind not in REQUIRED:
        raise ValueError(f"unknown algorithm {given.get('algorithm')!r}")
    if missing := [k for k in REQUIRED[kind] if k not in given]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    return given | {"algorithm": kind}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of a folder tree program/rank/step, with the file they came from."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name())
