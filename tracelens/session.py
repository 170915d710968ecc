"""What every operator needs from the running session: shared storage and shipped code."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, one machine) a temporary folder is made and set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tracelens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "step", **options) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet (with these options) to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelens/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the written table replaces the shuffles of this execution
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path  # type: ignore[attr-defined]
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; ``df`` can't be read afterwards."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tracelens_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tracelens-"), "tracelens_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path("tracelens") / p.relative_to(top)))
    sc.addPyFile(target)
    sc._tracelens_shipped = True


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of this size has; the deployment scales it with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
