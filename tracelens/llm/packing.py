"""Packing of token sequences: shortest pack first over the histogram of lengths.

Each document's ids, then one separator, are cut into full sequences and a rest. The
histogram of piece lengths has as many bins as a sequence has tokens, so the driver can
plan on it whatever the corpus holds: lengths are placed longest first, each into the
shortest packs that exist, in bulk, which updates counts of packing patterns. Every piece
then finds its pattern by its rank among the pieces of its length: ranks are counted
within each batch when it is cut, and batches are added up per length by a window over
their counts. No length, however common, meets in one task.

Null or empty text has no ids and becomes the separator alone. A string of the tokenizer's added
tokens in a text is that token, as in the library. Repeated rows are packed once for each row;
ties among equal lengths follow batch order; an empty table gives none. A very long text is
tokenised whole by one task and gives as many pieces as it needs. Only the key and the text are
read, so other columns, whatever their names, make no difference.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _pretoken

SIZE = 1024
SEPARATOR = 0


@dataclass
class Plan:
    """Slots of the patterns, by piece length and rank: where the rank's run starts and what it maps to."""

    key: np.ndarray  # length << 40 | first rank, ascending
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 40) | rank, "right") - 1
        return self.sequence[at] + rank - (self.key[at] & ((1 << 40) - 1)), self.offset[at]


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Packing patterns for ``histogram`` (length -> pieces) by shortest pack first."""
    packs: dict[int, list[list]] = {}  # filled tokens -> [count, pattern]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            least = min(packs, default=size)
            if least + length > size:
                packs.setdefault(length, []).append([left, (length,)])
                break
            count, pattern = packs[least].pop()
            used = min(count, left)
            if count > used:
                packs[least].append([count - used, pattern])
            elif not packs[least]:
                del packs[least]
            packs.setdefault(least + length, []).append([used, (*pattern, length)])
            left -= used
    ranks = dict.fromkeys(histogram, 0)
    slots, sequence = [], 0
    for filled in sorted(packs):
        for count, pattern in packs[filled]:
            at = 0
            for length in pattern:
                slots.append((length << 40 | ranks[length], sequence, at))
                ranks[length] += count
                at += length
            sequence += count
    slots.sort()
    columns = [np.array(c, np.int64) for c in zip(*slots, strict=True)] if slots else [np.zeros(0, np.int64)] * 3
    return Plan(*columns, sequences=sequence)


class _Encoder:
    """Ids of single words by the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def __call__(self, words: list[str]) -> list[tuple[np.ndarray, bytes]]:
        return [(np.array(e.ids, np.uint32), w.encode("utf-8", "surrogatepass")) for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True)]


_WORKER: dict[str, tuple[_pretoken.WordTable, re.Pattern | None]] = {}


def _table(path: str) -> tuple[_pretoken.WordTable, re.Pattern | None]:
    """Words' ids, and the pattern of the tokenizer's added tokens, which it finds in a text before all else."""
    if path not in _WORKER:
        encoder = _Encoder(path)
        _WORKER[path] = _pretoken.WordTable(encoder), encoder.added
    return _WORKER[path]


def cut(docs: DataFrame, tokenizer: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, and its batch and rank there among equal lengths."""
    session.ship(docs.sparkSession)
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "batch", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, ids, at, _, _ in _pretoken.encoded(batch.column(1), *_table(tokenizer)):
                count = np.diff(at) + 1
                pieces = -(-count // size)
                doc = np.repeat(np.arange(len(count)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, count[doc] - start)
                crc, end = np.empty(len(doc), np.int64), np.uint32(SEPARATOR).tobytes()
                for i, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                    last = s + n == count[d]
                    own = ids[at[d] + s : at[d] + s + n - last].astype("<u4").tobytes()
                    crc[i] = zlib.crc32(own + end if last else own)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - first
                keys = batch.column(0).slice(lo, len(count)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x.astype(np.int64)) for x in (start, length, crc, count[doc], np.full(len(doc), number), rank))], names=names)
                number += 1

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, batch long, rank long")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = session.materialize(cut(docs, tokenizer, size, key, text), "pieces")
    counts = pieces.groupBy("batch", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    shared = spark.sparkContext.broadcast(plan(histogram, size))
    before = F.sum("n").over(W.partitionBy("length").orderBy("batch").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("batch", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["batch", "length"]).select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            sequence, offset = shared.value.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(run, f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
