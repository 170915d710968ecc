"""Document collections: storage by rank, filters, rankings, indexes, comparison and validation of runs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import runstats as R

MAIN, GLOBAL = ("anomalies", "metadata", "normalexecs"), ("func_stats", "counter_stats", "ad_model")


def append(df: DataFrame, root: str, collection: str, shards: int = 1, rank: str = "rid") -> None:
    """Adds documents; those of main collections are filed by rank modulo ``shards``."""
    if collection in MAIN:
        df.withColumn("shard", F.pmod(F.col(rank), F.lit(shards))).write.mode("append").partitionBy("shard").parquet(f"{root}/{collection}")
    elif collection in GLOBAL:
        df.write.mode("append").parquet(f"{root}/{collection}")
    else:
        raise ValueError(f"no collection {collection}")


def load(spark: SparkSession, root: str, collection: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{collection}")


def write_json(df: DataFrame, root: str, collection: str) -> None:
    """JSON files in a folder per program, rank and step."""
    df.write.mode("append").partitionBy("pid", "rid", "step").json(f"{root}/{collection}")


OPERATORS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v, "contains": lambda c, v: c.contains(v),
}


def predicate(parts: list) -> Column:
    """A filter from (key, operator, value) tuples joined by "and", "or" and their opposites in brackets "(" and ")"."""

    def either(i: int) -> tuple[Column, int]:
        left, i = both(i)
        while i < len(parts) and parts[i] in ("or", "||"):
            right, i = both(i + 1)
            left = left | right
        return left, i

    def both(i: int) -> tuple[Column, int]:
        left, i = one(i)
        while i < len(parts) and parts[i] in ("and", "&&"):
            right, i = one(i + 1)
            left = left & right
        return left, i

    def one(i: int) -> tuple[Column, int]:
        p = parts[i]
        if p in ("not", "!"):
            c, i = one(i + 1)
            return ~c, i
        if p == "(":
            c, i = either(i + 1)
            if i >= len(parts) or parts[i] != ")":
                raise ValueError("a bracket isn't closed")
            return c, i + 1
        key, op, value = p
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        return OPERATORS[op](F.col(key), F.lit(value)), i + 1

    out, i = either(0)
    if i != len(parts):
        raise ValueError(f"{parts[i]!r} isn't expected here")
    return out


def select(df: DataFrame, condition: str | list = "DUMP", order: list[str] | None = None) -> DataFrame:
    """Documents that meet a condition (SQL text, a list for :func:`predicate`, or all), largest first by ``order``."""
    out = df if condition == "DUMP" else df.where(predicate(condition) if isinstance(condition, list) else condition)
    return out.orderBy(*(F.desc_nulls_last(c) for c in order)) if order else out


def script(spark: SparkSession, root: str, sql: str) -> DataFrame:
    """SQL text over the collections that exist, as views of their names."""
    for name in (*MAIN, *GLOBAL):
        try:
            load(spark, root, name).createOrReplaceTempView(name)
        except Exception as e:  # a collection that was never written has no view
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.sql(sql)


def keys(df: DataFrame, kinds=("bigint", "int", "double", "string", "boolean"), lists: bool = False) -> list[str]:
    """Top-level keys that hold plain values; with ``lists`` also those that hold lists of documents, as key[field]."""
    out = [n for n, t in df.dtypes if t in kinds]
    for f in df.schema.fields if lists else ():
        inner = getattr(f.dataType, "elementType", None)
        out += [f"{f.name}[{g}]" for g in getattr(inner, "names", ())]
    return out


def amend(df: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Documents with the values of ``updates`` where there are any."""
    new = [c for c in updates.columns if c != key]
    both = df.join(updates.select(key, *(F.col(c).alias(f"__{c}") for c in new)), key, "left")
    return both.select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in df.columns if c != key))


def index(df: DataFrame, key: str, id_: str = "id", entry: str = "entry") -> DataFrame:
    """Inverted index rows (value, entry, id), sorted within values; a value's list may be of any length."""
    return df.select(F.col(key).alias("value"), F.col(entry).alias("entry"), F.col(id_).alias("id")).where("value IS NOT NULL").repartitionByRange("value", "entry").sortWithinPartitions("value", "entry", "id")


def lookup(idx: DataFrame, df: DataFrame, value, id_: str = "id") -> DataFrame:
    """Documents of one value, by entry."""
    return idx.where(F.col("value") == value).join(df, idx["id"] == df[id_]).drop(idx["id"]).orderBy("entry")


def ranking(stats: DataFrame, by: str, n: int = 10, ascending: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The first n rows by a column (-1: all), with the columns that are shown."""
    out = stats.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by))
    out = out if n < 0 else out.limit(n)
    return out.select(*columns) if columns else out


def function_ranking(stats: DataFrame) -> DataFrame:
    """Columns of the ranking of functions from (pid, fid, name, exclusive, inclusive, count, severity): times in s, their means in ms."""
    return stats.select(
        "pid", "fid", "name", F.col("count.accumulate").cast("long").alias("anom_count"), F.col("severity.accumulate").alias("accum_sev"), F.col("severity.mean").alias("avg_sev"),
        F.col("exclusive.count").alias("exec_count"), (F.col("count.accumulate") / F.col("exclusive.count")).alias("anom_freq"),
        (F.col("exclusive.accumulate") / 1e6).alias("tot_runtime_excl"), (F.col("inclusive.accumulate") / 1e6).alias("tot_runtime_incl"),
        (F.col("exclusive.mean") / 1e3).alias("avg_runtime_excl"), (F.col("inclusive.mean") / 1e3).alias("avg_runtime_incl"),
    )


def counter_ranking(stats: DataFrame) -> DataFrame:
    """Columns of the ranking of counters from (pid, counter, stats)."""
    return stats.select("pid", "counter", F.col("stats.count").alias("count"), F.col("stats.minimum").alias("min"), F.col("stats.maximum").alias("max"), F.col("stats.mean").alias("avg"))


def _quotient(x: str, y: str) -> Column:
    """x / y as doubles have it: by zero NaN or infinite, where Spark's division is an error."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, -float("inf")).when(a == 0, float("nan"))
    by_zero = F.when(F.isnan(a), float("nan")).otherwise(by_zero)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def between_runs(a: DataFrame, b: DataFrame, keys_: list[str], severity: str, n: int = 10) -> DataFrame:
    """Functions of two runs side by side, by the greater severity of both.

    With columns count, calls and total also the share of calls that are anomalies (percent) and of time that is spent in them;
    shares of nothing are what they are for doubles (NaN or infinite), not errors.
    """
    left, right = (d.select(*keys_, *(F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in keys_)) for d, s in ((a, "a"), (b, "b")))
    both = left.join(right, keys_, "full_outer").withColumn("greatest", F.greatest(f"{severity}_a", f"{severity}_b"))
    if {"count", "calls", "total"} <= set(a.columns):
        for s in "ab":
            both = both.withColumn(f"frequency_{s}", _quotient(f"count_{s}", f"calls_{s}") * 100).withColumn(f"relative_{s}", _quotient(f"{severity}_{s}", f"total_{s}"))
    return both.orderBy(F.desc_nulls_last("greatest"), *keys_).limit(n)


def validated(records: DataFrame, reported: DataFrame, keys_: list[str]) -> DataFrame:
    """Counts of stored records beside those that statistics report; rows where they differ."""
    found = records.groupBy(*keys_).agg(F.count("*").alias("stored"))
    both = reported.join(found, keys_, "full_outer").fillna(0, ["stored", "reported"])
    return both.where("stored <> reported")


def pruned_stats(records: DataFrame, func: str = "func") -> DataFrame:
    """Anomaly metrics of each function from the records that survive: steps, span, run statistics of scores, of severities, and of the counts per rank and step."""
    figures = lambda x, name: F.struct(*R.aggregates(x)).alias(name)
    each = records.groupBy(func, "rid", "step").agg(F.count("*").alias("k")).groupBy(func).agg(figures("k", "count"))
    rest = records.groupBy(func).agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.min("entry").alias("min_ts"), F.max("exit").alias("max_ts"), figures("score", "score"), figures("exclusive", "severity"))
    return rest.join(each, func)


def with_pruned_stats(func_stats: DataFrame, records: DataFrame, func: str = "func") -> DataFrame:
    """Function statistics whose anomaly_metrics are those of the records that survive a prune; null where none does."""
    new = pruned_stats(records, func)
    new = new.select(func, F.struct(*[c for c in new.columns if c != func]).alias("anomaly_metrics"))
    return func_stats.drop("anomaly_metrics").join(new, func, "left")


def amend_stored(spark: SparkSession, root: str, collection: str, updates: DataFrame, key: str = "id") -> None:
    """Writes documents back with the values of ``updates``: into a new folder first, which then replaces the old one."""
    path = f"{root}/{collection}"
    amend(load(spark, root, collection), updates, key).write.mode("overwrite").parquet(f"{path}.new")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    if not fs.rename(fs_path(f"{path}.new"), fs_path(path)):
        raise OSError(f"{path}.new can't take the place of {path}")


def restore(spark: SparkSession, json_root: str, root: str, collection: str, shards: int = 1, schema: str | None = None) -> None:
    """Files the JSON documents of a dump by rank again, in as many shards as are wanted."""
    reader = spark.read.option("basePath", f"{json_root}/{collection}")
    docs = (reader.schema(schema) if schema else reader).json(f"{json_root}/{collection}")
    append(docs, root, collection, shards)


def assigned(df: DataFrame, shards_of: DataFrame, rank: str = "rid") -> DataFrame:
    """``shard`` of each document by a table (rank, shard); a rank that isn't listed is an error."""
    both = df.join(shards_of.withColumnRenamed("rank", "__rank"), F.col(rank) == F.col("__rank"), "left").drop("__rank")
    return both.withColumn("shard", F.when(F.col("shard").isNull(), F.raise_error(F.concat(F.lit("no shard for rank "), F.col(rank).cast("string")))).otherwise(F.col("shard")))


def nested(df: DataFrame, path: str) -> Column:
    """The value at a dotted path of nested columns, or null where the schema has no such field."""
    kind = df.schema
    for part in path.split("."):
        kind = getattr(kind, "elementType", kind)
        if not hasattr(kind, "names") or part not in kind.names:
            return F.lit(None)
        kind = kind[part].dataType
    return F.col(path)


def normalised(records: DataFrame) -> dict[str, DataFrame]:
    """Relational views of anomaly records: anomalies, call_stacks, counter_values, io_steps."""
    own = ["pid", "rid", "tid", "seq"]
    return {
        "anomalies": records.select(*own, "step", "fid", "entry", "exit", "exclusive", "score"),
        "call_stacks": records.select(*own, F.posexplode("stack").alias("level", "fid")),
        "counter_values": records.select(*own, F.explode_outer("counter_events").alias("c")).select(*own, "c.*"),
        "io_steps": records.groupBy("pid", "rid", "step").agg(F.min("entry").alias("min_ts"), F.max("exit").alias("max_ts")),
    }


def summary(df: DataFrame) -> Column:
    """One line of text for an event."""
    return F.format_string("%s (%s:%s:%s) %s us, score %s", "func", "pid", "rid", "tid", "exclusive", "score").alias("summary")


def packet(sections: dict[str, list[dict]], created_at: int) -> str:
    """A visualisation packet as JSON text."""
    return json.dumps({"created_at": created_at, "version": 2} | sections, sort_keys=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
