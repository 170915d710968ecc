"""Names and global indexes of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assign(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Global indexes (pid, name, fid): known ones stay, new names (pid, name, first) follow by first appearance.

    A program's dictionary is as small as its source code, so one window over the new names suffices.
    """
    new = seen.groupBy("pid", "name").agg(F.min("first").alias("first")).join(known.select("pid", "name"), ["pid", "name"], "left_anti")
    top = known.agg(F.coalesce(F.max("fid"), F.lit(-1)).alias("top"))
    k = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("first", "pid", "name"))
    return known.select("pid", "name", "fid").unionByName(new.withColumn("k", k).join(F.broadcast(top)).select("pid", "name", (F.col("top") + F.col("k")).cast("long").alias("fid")))


def resolved(events: DataFrame, local: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with global fid and name, events of unknown functions); ``local`` maps a program's own ids to names."""
    dim = local.select("pid", F.col("id").alias("fid"), "name").join(index.select("pid", "name", F.col("fid").alias("global")), ["pid", "name"])
    both = events.join(F.broadcast(dim), ["pid", "fid"], "left")
    known = F.col("global").isNotNull()
    return both.where(known).drop("fid").withColumnRenamed("global", "fid"), events.join(F.broadcast(dim), ["pid", "fid"], "left_anti")


def model_names(model: DataFrame, index: DataFrame) -> DataFrame:
    """Models with their functions' names; a model without a name is an error."""
    out = model.join(F.broadcast(index), "fid", "left")
    return out.withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("no name for function "), F.col("fid").cast("string")))).otherwise(F.col("name")))
