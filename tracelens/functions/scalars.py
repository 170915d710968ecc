"""Scalar functions on ids, text, time, maps and JSON, as column expressions, and a plain-text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_id(rank, step, index) -> Column:
    """Id of an event: rank, step and place in the step, by colons."""
    return F.concat_ws(":", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in (rank, step, index)))


def id_parts(c: str) -> list[Column]:
    """rank, step and index of an event id."""
    return [F.split(c, ":")[i].cast("long").alias(n) for i, n in enumerate(("rank", "step", "index"))]


def random_hex(digits: int, seed: int | None = None) -> Column:
    """Random hexadecimal digits, each alike."""
    one = lambda k: F.substring(F.lit("0123456789abcdef"), (F.floor(F.rand(None if seed is None else seed + k) * 16) + 1).cast("int"), F.lit(1))
    return F.concat(*(one(k) for k in range(digits)))


def port_of(rank: str, ports: int, base: int) -> Column:
    """Port of the server instance that a rank talks to."""
    return (F.lit(base) + F.pmod(F.col(rank), F.lit(ports))).cast("int")


def seconds(micros) -> Column:
    return (F.col(micros) if isinstance(micros, str) else micros) / 1e6


def date_time(micros: str) -> Column:
    """Date and time in text of microseconds since 1970."""
    return F.date_format(F.timestamp_micros(micros), "yyyy/MM/dd HH:mm:ss")


def epoch_ms() -> Column:
    """Milliseconds since 1970, now."""
    return F.unix_millis(F.current_timestamp())


def lookup(m: Column, *path) -> Column:
    """Value of nested maps; null where a key is missing."""
    for k in path:
        m = F.try_element_at(m, F.lit(k))
    return m


def plus(a: Column, b: Column) -> Column:
    """Maps added up key by key; a key of one side keeps its value."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def json_at(c: str, *path: str) -> Column:
    """Value at a path of JSON text; null where there is none."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))


def hashed(*c: str) -> Column:
    """One hash of several columns."""
    return F.xxhash64(*c)


def text_table(df: DataFrame, rows: int = 10) -> str:
    """The first rows, left-justified, a space between columns; a report that is ``rows`` long by design."""
    head, body = df.columns, [["" if v is None else str(v) for v in r] for r in df.take(rows)]
    width = [max(len(r[i]) for r in [head, *body]) for i in range(len(head))]
    return "\n".join(" ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [head, *body])
