"""Sinks: visualisation packets to disk or HTTP, models, global statistics, run metrics."""

from __future__ import annotations

import itertools
import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tracelens.operators import collections as D

#: Rows of one packet; a packet goes to a viewer and is bounded, what is left goes in the next.
PACKET_ROWS = 10_000


def post(url: str, body: str, timeout: float = 10) -> int:
    """Sends JSON text; gives the HTTP status."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status


def packets(stream: DataFrame, deliver: Callable[[int, str], None], section: str = "anomaly_stats", checkpoint: str | None = None, period_ms: int | None = None) -> StreamingQuery:
    """Each batch's rows as packets for ``deliver(batch, text)``, every ``period_ms`` or all that there is; rows are taken in turn and never all at once."""

    def send(batch: DataFrame, number: int) -> None:
        rows, sent = [], False
        for r in batch.toJSON().toLocalIterator():
            rows.append(json.loads(r))
            if len(rows) == PACKET_ROWS:
                deliver(number, D.packet({section: rows}, int(time.time() * 1000)))
                rows, sent = [], True
        if rows or not sent:
            deliver(number, D.packet({section: rows}, int(time.time() * 1000)))

    out = stream.writeStream.foreachBatch(send)
    out = out.option("checkpointLocation", checkpoint) if checkpoint else out
    return (out.trigger(processingTime=f"{period_ms} milliseconds") if period_ms else out.trigger(availableNow=True)).start()


def to_folder(folder: str) -> Callable[[int, str], None]:
    """Delivers packets as numbered JSON files."""
    numbers = itertools.count()

    def deliver(_: int, text: str) -> None:
        (Path(folder) / f"stats_{next(numbers)}.json").write_text(text)

    return deliver


def sent(rows: DataFrame, frequency: int, last_step: int) -> DataFrame:
    """Rows of the steps in which their rank sends (:func:`due`); the last step always does."""
    turn = F.lit(frequency > 0) & (F.pmod(F.col("step") + F.col("rid"), F.lit(max(frequency, 1))) == 0)
    return rows.where(turn | (F.col("step") == last_step))


def save_model(model: DataFrame, path: str) -> None:
    """A model table as JSON lines; it replaces an older one."""
    model.write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_global(root: str, func_stats: DataFrame, counter_stats: DataFrame, model: DataFrame) -> None:
    """The three global collections at the end of a run."""
    for name, df in (("func_stats", func_stats), ("counter_stats", counter_stats), ("ad_model", model)):
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def due(step: int, rank: int, frequency: int, last: bool = False) -> bool:
    """Whether a rank sends in this step: ranks take turns, and the last step always sends."""
    return last or (frequency > 0 and (step + rank) % frequency == 0)


def observed(df: DataFrame, name: str = "run") -> DataFrame:
    """Counts rows and labelled outliers as they pass, for query listeners."""
    outliers = F.sum((F.col("label") == -1).cast("long")) if "label" in df.columns else F.lit(None).cast("long")
    return df.observe(name, F.count(F.lit(1)).alias("rows"), outliers.alias("outliers"))


def viewed(stream: DataFrame, rows: int = 20, seconds: float | None = None) -> StreamingQuery:
    """Shows each step of a stream on the console."""
    out = stream.writeStream.format("console").option("numRows", rows).option("truncate", False)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def parsed_only(df: DataFrame) -> float:
    """Reads everything and keeps nothing; gives the seconds that it took."""
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def append_table(df: DataFrame, path: str) -> DataFrame:
    """Appends rows to a table and reads it back."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(query: StreamingQuery, seconds: float) -> bool:
    """Waits for a stream's end; after ``seconds`` it is stopped and False is given. What failed is raised."""
    if query.awaitTermination(seconds):
        return True
    query.stop()
    return False


class Figures(StreamingQueryListener):
    """Run statistics of a stream's progress by label, and resident memory, as JSON text."""

    def __init__(self):
        self.values: dict[str, list[float]] = {}
        self.ended = threading.Event()

    def add(self, label: str, value: float) -> None:
        n, total, low, high = self.values.get(label, (0, 0.0, float("inf"), float("-inf")))
        self.values[label] = [n + 1, total + value, min(low, value), max(high, value)]

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.add("rows", p.numInputRows)
        for name, ms in p.durationMs.items():
            self.add(f"{name}_ms", ms)
        self.add("resident_kB", resident_kb())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def text(self) -> str:
        return json.dumps({k: {"count": n, "accumulate": t, "minimum": lo, "maximum": hi, "mean": t / n} for k, (n, t, lo, hi) in sorted(self.values.items())})


def resident_kb() -> float:
    """Resident memory of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1024


def stopped_with(spark: SparkSession, clients: int, done: int) -> bool:
    """Ends all streams once every client has gone."""
    if done < clients:
        return False
    for q in spark.streams.active:
        q.stop()
    return True
