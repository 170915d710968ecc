"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Every line is hashed; a rolling hash over each line and the two before it marks a line where
it is divisible by ``DIVISOR``. A marked line ends a chunk if the line before isn't marked, and
neither the first line of a text nor its last but one ends a chunk, so every chunk has two lines
or more, but that of a text of one line. A boundary depends on four lines alone, so an insertion
moves no boundary further on. Chunks of two lines or more are grouped by two hashes and their
bytes: the grouping is the byte comparison. Of those that occur more than once the first (least
doc_id, then position) stays, the others are cut out of their texts. Equal chunks meet within
each task before the shuffle; the few chunks that make up most copies are joined by broadcast (at most
``HOT`` of them, by their share), the others by their hashes. A passage that an edit or a cut of its
ends changes keeps the chunks at that place: up to a chunk at either end.

Null text stays null and has no lines; an empty text is one empty line. Rows that repeat
with the same doc_id are one document: their chunks don't remove each other. A null
doc_id comes before all others. Extra columns are kept, whatever their names;
an empty table stays empty. A text of any length is one row, handled whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _shared

DIVISOR = 3
#: A chunk is joined by broadcast if it has at least this part of all copies: there are no more than HOT such chunks.
HOT = 5000

_HASHES = "transform(__lines, l -> cast(conv(substr(md5(l), 1, 8), 16, 10) AS bigint))"
_MARK = f"(get(__h, {{0}} - 1) + 31 * coalesce(get(__h, {{0}} - 2), 0L) + 961 * coalesce(get(__h, {{0}} - 3), 0L)) % {DIVISOR} = 0"
_ENDS = f"""filter(sequence(1, size(__lines)), i -> i = size(__lines)
  OR (i > 1 AND i < size(__lines) - 1 AND {_MARK.format("i")} AND NOT {_MARK.format("(i - 1)")}))"""
_CHUNKS = """transform(__ends, (e, k) -> struct(k AS pos, e - coalesce(get(__ends, k - 1), 0) AS n,
  array_join(slice(__lines, coalesce(get(__ends, k - 1), 0) + 1, e - coalesce(get(__ends, k - 1), 0)), '\\n') AS bytes))"""


def _once(df: DataFrame, name: str, value) -> DataFrame:
    """Adds a column that is computed once for each row; a plain projection would be repeated within lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _cut(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__chunks``: position, lines and bytes of each chunk."""
    out = _once(docs, "__lines", F.split(F.col(text), "\n", -1))
    out = _once(out, "__h", F.expr(_HASHES))
    out = _once(out, "__ends", F.expr(_ENDS))
    return _once(out, "__chunks", F.expr(_CHUNKS)).drop("__h", "__ends", "__lines")


def chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per chunk: __id, pos, n, bytes, and two hashes."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("__id"), F.col(text).alias("__text"))
    return _cut(rows, "__text").select("__id", F.explode("__chunks").alias("c")).select("__id", "c.pos", "c.n", "c.bytes", F.xxhash64("c.bytes").alias("hash"), F.conv(F.substring(F.md5("c.bytes"), 1, 15), 16, 10).cast("long").alias("check"))


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Positions of the chunks to cut from each document: __id, __cut (array)."""
    multi = chunks(docs, text, key).where("n >= 2")
    at = F.col("__id").cast("decimal(38,0)") * F.lit(2**31) + F.col("pos")
    by_bytes = multi.groupBy("hash", "check", "bytes").agg(F.min(at.cast("decimal(38,0)")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = session.materialize(by_bytes.select("hash", "check", "first", "copies"), "chunks")
    total = first.agg(F.sum("copies")).first()[0] or 0
    hot = first.where(F.col("copies") * HOT >= total).select("hash", "check", F.col("first").alias("__hot"))
    rest = first.where(F.col("copies") * HOT < total).select(F.col("hash").alias("__hash"), F.col("check").alias("__check"), F.col("first").alias("__rest"))
    some = multi.select("__id", "pos", "hash", "check", at.cast("decimal(38,0)").alias("at")).join(F.broadcast(hot), ["hash", "check"], "left")
    # what has met its hot chunk is dealt by its place and meets nothing
    key = F.when(F.col("__hot").isNull(), F.col("hash")).otherwise(F.xxhash64("__id", "pos"))
    some = some.withColumn("__hash", key).withColumn("__check", F.when(F.col("__hot").isNull(), F.col("check")).otherwise(-1))
    found = some.join(rest, ["__hash", "__check"], "left").where(F.col("at") > F.coalesce("__hot", "__rest"))
    return found.groupBy("__id").agg(F.collect_set("pos").alias("__cut"))


@_shared.sheltered
def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = False) -> DataFrame:
    """The documents without repeated chunks; with ``counts`` also n_lines, n_removed_lines, n_chunks, n_removed_chunks."""
    cut = repeated(docs, text, key)
    given = docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    rows = _cut(given.join(cut, "__id", "left"), text)
    rows = rows.withColumn("__kept", F.expr("CASE WHEN __cut IS NULL THEN __chunks ELSE filter(__chunks, c -> NOT array_contains(__cut, c.pos)) END"))
    rows = rows.withColumn("__new", F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.expr("array_join(transform(__kept, c -> c.bytes), '\n')")))
    columns = [F.col("__new").alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        lines = "aggregate({}, 0L, (a, c) -> a + c.n)"
        columns += [
            F.coalesce(F.expr(lines.format("__chunks")), F.lit(0)).alias("n_lines"),
            F.coalesce(F.expr(f"{lines.format('__chunks')} - {lines.format('__kept')}"), F.lit(0)).alias("n_removed_lines"),
            F.coalesce(F.size("__chunks").cast("long"), F.lit(0)).alias("n_chunks"),
            F.coalesce((F.size("__chunks") - F.size("__kept")).cast("long"), F.lit(0)).alias("n_removed_chunks"),
        ]
    return rows.select(*columns)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH line AS (
  SELECT doc_id, i AS no, l, ('0x' || substr(md5(l), 1, 8))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
marked AS (
  SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % {DIVISOR} = 0 AS mark
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
ending AS (
  SELECT *, no = lines OR (no > 1 AND no < lines - 1 AND mark AND NOT lag(mark) OVER (PARTITION BY doc_id ORDER BY no)) AS ends FROM marked),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ending),
chunk AS (
  SELECT doc_id, pos, count(*) AS n, string_agg(l, chr(10) ORDER BY no) AS bytes FROM numbered GROUP BY doc_id, pos),
judged AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, bytes ORDER BY doc_id, pos) > 1 AS cut FROM chunk),
kept AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (cut), 0)::BIGINT AS n_removed_lines, count(*) AS n_chunks,
    count(*) FILTER (cut) AS n_removed_chunks, coalesce(string_agg(bytes, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text
  FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed_lines, n_chunks, n_removed_chunks, octet_length(encode(text))::BIGINT AS kept_bytes, sha256(text) AS kept_sha256 FROM kept
"""
