"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo two primes, the polynomial hash of each prefix; the
hash of any span follows from two entries, so spans of two texts can be compared and
their longest common extension found by binary search without reading the texts again.

A fingerprint is the hash of the whole text, its length, and the ``SKETCH`` least mixed
hashes among all spans of ``SPAN`` code points (shorter texts: the whole text as the only
span). ``likeness`` estimates from two fingerprints the Jaccard similarity of the texts'
span sets; equal texts have likeness 1.

Null text is empty text. An empty text has no spans; two empty texts have likeness 1, an
empty and another text 0. Rows with equal keys are ordered by their text's digest, null
keys come last; a table of one row has itself as its next row, an empty one gives nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
SPAN = 12
SKETCH = 64
#: Rows that one part of the ordered walk holds, until there are MOST_PARTS: the driver sees a key for each part.
PART_ROWS = 4096
MOST_PARTS = 16_384

_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """base**i modulo prime for i below n or more, by repeated doubling."""
    have = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
    _POWERS[base, prime] = have
    return have


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        self.cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            out = np.zeros(len(self.cp) + 1, np.uint64)
            terms = (self.cp + np.uint64(1)) * _powers(len(self.cp), base, prime)[: len(self.cp)] % np.uint64(prime)
            np.cumsum(terms, out=out[1:])  # below 2**31 each, so exact for 2**33 code points
            self.sums.append(out % np.uint64(prime))

    def __len__(self) -> int:
        return len(self.cp)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end): the two residues side by side in 62 bits."""
        both = np.zeros(len(start), np.uint64)
        for sums, base, prime in zip(self.sums, BASES, PRIMES, strict=True):
            p = np.uint64(prime)
            back = _powers(len(self.cp) + 1, pow(base, -1, prime), prime)
            both = (both << np.uint64(31)) | ((sums[end] + p - sums[start]) % p * back[start] % p)
        return both

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension of a[i:] and b[j:], by binary search over prefix hashes."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(p: Prefixes) -> np.ndarray:
    """The least mixed hashes of the text's spans, ascending and distinct."""
    if not len(p):
        return np.zeros(0, np.uint64)
    start = np.arange(max(1, len(p) - SPAN + 1))
    h = _mixed(p.spans(start, np.minimum(start + SPAN, len(p))))
    k = SKETCH
    while True:  # repeats may fill the least hashes, so look further until enough differ
        least = np.unique(np.partition(h, k)[:k] if len(h) > k else h)
        if len(least) >= SKETCH or len(h) <= k:
            return least[:SKETCH]
        k *= 4


def fingerprint(p: Prefixes, least: np.ndarray | None = None) -> str:
    """length, whole hash and sketch in hex."""
    least = sketch(p) if least is None else least
    return f"{len(p):x}-{p.span(0, len(p)):016x}-{least.astype('>u8').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Jaccard similarity of the span sets, estimated from two fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u8").astype(np.uint64) for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:SKETCH]
    return float(np.isin(union, x, assume_unique=True)[np.isin(union, y, assume_unique=True)].sum() / len(union))


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def _compare(text: str, own: str, prefixes: Prefixes, following: str, next_print: str) -> tuple:
    changed = edit(text, following)
    p = Prefixes(changed)
    mark = fingerprint(p)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, mark, likeness(own, mark), likeness(own, next_print), common_extension(prefixes, 0, p, 0)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text edited with its next row's, by descending key.

    The table is cut into ranges of the key's order at quantiles; each range also gets
    a copy of the row after its last, and is walked in order. Each text is shuffled once (and
    once more where it begins a range); the ranges' first keys, at most MOST_PARTS, are all that the
    driver sees, and a range is sorted by Spark, which spills, and walked row by row, so it may be of any length.
    Other columns are left out.
    """
    spark = docs.sparkSession
    session.ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumn("d", F.substring(F.sha2("t", 256), 1, 16))
    # descending key, nulls last, then digest: one ascending order of (a, b)
    rows = rows.select("k", "t", F.coalesce(F.bitwise_not("k"), F.lit((1 << 63) - 1)).alias("a"), F.col("d").alias("b"))
    order = rows.select("a", "b")
    count = order.count()
    if not count:
        return spark.createDataFrame([], f"{key} long, {SCHEMA}")
    parts = max(1, min(count, max(session.partitions(spark), min(MOST_PARTS, -(-count // PART_ROWS)))))
    cuts = sorted({min(int(x), (1 << 63) - 1) for x in order.approxQuantile("a", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    bounds = np.array(cuts, np.int64)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, batch.column(batch.num_columns - 2).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], names=[*batch.schema.names, "part"])

    firsts = order.mapInArrow(numbered, "a long, b string, part long").groupBy("part").agg(F.min(F.struct("a", "b")).alias("f")).orderBy("part").collect()
    heads = [(r["part"], r["f"]["a"], r["f"]["b"]) for r in firsts]
    head = {(a, b): heads[i - 1][0] for i, (_, a, b) in enumerate(heads)}  # the first one's copy goes to the last part

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "t", "a", "b", "part", "tail"]
        for batch in batches:
            a, b = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            part = np.searchsorted(bounds, a, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64()), pa.array(np.zeros(len(a), bool))], names=names)
            copies = [i for i, x in enumerate(zip(a.tolist(), b, strict=True)) if x in head]
            if copies:
                some = batch.take(pa.array(copies))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([head[a[i], b[i]] for i in copies], pa.int64()), pa.array([True] * len(copies))], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size, at = None, [], 0, None
        names = [key, *(x.split()[0] for x in SCHEMA.split(", "))]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            for r in range(batch.num_rows):
                k, t, part, tail = (batch.column(i)[r].as_py() for i in (0, 1, 4, 5))
                if part != at:
                    held, at, tailed = None, part, False
                if tail and tailed:
                    continue  # rows that equal a range's first row were copied as well
                tailed = tail
                p = Prefixes(t)
                mark = fingerprint(p)
                if held is not None:
                    out.append((held[0], *_compare(held[1], held[2], held[3], t, mark)))
                    size += 1
                held = None if tail else (k, t, mark, p)
                if size >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out, strict=True), types, strict=True)], names=names)

    placed = rows.select("k", "t", "a", "b").mapInArrow(dealt, "k long, t string, a long, b string, part long, tail boolean")
    placed = placed.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "a", "b")
    return placed.mapInArrow(walk, f"{key} long, {SCHEMA}")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, beside those of its edited text and of the next document."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
