"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a text
with a smaller doc_id, or earlier in the same text. Two rounds double the compared length.

Round one ranks the strings of half the length. A rank is a 64-bit hash of the string, so
that equal strings get equal ranks without a global sort; a position whose rank is unique
can't start a repeat and is out. Not every position has to travel for that: a window of
``LENGTH`` bytes is represented by the least rank among the half-length strings in it, which
equal windows share, and runs of windows with one representative are one entry.

Round two takes the runs whose representative occurs again, anywhere. Every position becomes
the pair of its rank and the rank half a length on, pairs are sorted beside (doc_id,
position), and all but the first of equal pairs are repeats. This is done in steps, since an
earlier occurrence that any step finds settles a window: first within a block of texts, so a
block sends each string once; then, for representatives of over ``HOT`` texts, among the blocks of one
salt; then among all that is left of a range. A passage of a third of all texts so costs one
window for each block, split over its salts. Repeats return to their texts as byte spans.
Two strings are equal if both of their 64-bit ranks are.

Null text is empty; texts under ``LENGTH`` bytes have no window. Rows that repeat a doc_id
and a text are one document and get the same result; different texts with one doc_id are
judged by their position alone. A null doc_id comes after all others. Ties can't occur
otherwise. Extra columns are kept by :func:`dedup`, whatever their names; an empty table
gives an empty one. A text is handled whole by one task, in slices but for some 100 bytes
of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _shared, _text

LENGTH = 100
HALF = LENGTH // 2
#: Ranges of representatives for each shuffle partition: a range's windows are judged in memory.
RANGES = 8
#: Texts with a representative from which on its windows are judged by salts first, one salt for as many texts.
HOT = 512
#: Bytes of windows that one block of texts holds.
BLOCK_BYTES = 4 << 20
#: Bytes ranked at once.
PIECE = 1 << 20
_TOP = np.uint64(2**64 - 1)
_LAST = (1 << 63) - 1


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i : i + width] for every i that has as many."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    f = np.minimum if least else np.maximum
    rows = -(-len(x) // width)
    padded = np.full(rows * width, _TOP if least else 0, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = f.accumulate(grid, axis=1).reshape(-1)
    back = f.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(back[:n], ahead[width - 1 : width - 1 + n])


def ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the HALF bytes from each position that has as many; a rank depends on its bytes alone."""
    n = max(len(data) - HALF + 1, 0)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, PIECE):
        part = data[lo : lo + PIECE + HALF - 1]
        m = len(part) - HALF + 1
        pre = _text.prefix(_text.BYTE_VALUES[part])
        h = (pre[HALF:] - pre[:m]) * _text.powers(len(pre))[1][:m]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[lo : lo + m] = h ^ (h >> np.uint64(32))
    return out


def representatives(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks by position, representative of each window by its start, and whether a window starts there."""
    rank = ranks(data)
    rep = _sliding(rank, LENGTH - HALF + 1, True)
    valid = np.ones(len(rep), bool)
    # windows that would run into the next text
    for back in (offsets[1:-1],):
        lo = np.maximum(back - LENGTH + 1, 0)
        valid[_text.ragged(lo, np.maximum(np.minimum(back, len(rep)) - lo, 0))] = False
    return rank, rep, valid


def spread(rep: np.ndarray) -> np.ndarray:
    """48 bits for each representative, even over their range; representatives themselves are least ranks and crowd at its low end."""
    return _text.mix(rep) >> np.uint64(16)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of the representatives, and their rows."""
    _, rep, valid = representatives(data, offsets)
    start = np.flatnonzero(valid & np.append(True, (rep[1:] != rep[:-1]) | ~valid[:-1])[: len(rep)]) if len(rep) else np.zeros(0, np.int64)
    return spread(rep[start]), np.searchsorted(offsets, start, "right") - 1


def runs(data: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, and 48-bit representative, of one text's runs that may hold repeats; ranks by position.

    ``known``: representatives that other texts have too, ascending. A run also counts if its
    representative's string occurs at several positions of this text.
    """
    rank, rep, _ = representatives(data, np.array([0, len(data)]))
    if not len(rep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), rank
    first = np.flatnonzero(np.append(True, rep[1:] != rep[:-1]))
    last = np.append(first[1:], len(rep)) - 1
    own = rep[first]
    # positions that represent some window: their rank is the largest representative around them
    around = np.concatenate([np.zeros(LENGTH - HALF, np.uint64), rep, np.zeros(LENGTH - HALF, np.uint64)])
    at = rank[rank == _sliding(around, LENGTH - HALF + 1, False)]
    at.sort()
    twice = np.unique(at[1:][at[1:] == at[:-1]])
    short = spread(own)
    hit = np.isin(own, twice) if len(twice) else np.zeros(len(own), bool)
    if len(known):
        hit |= known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
    return first[hit], last[hit], short[hit], rank


def _leads(rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each entry the first one that equals it in both ranks; entries stand in order."""
    n = len(rank)
    if not n:
        return np.zeros(0, np.int64)
    pair = _text.mix(rank * np.uint64(0x9E3779B97F4A7C15) + end)
    low = max(1, int(n).bit_length())
    mask = np.uint64((1 << low) - 1)
    key = (pair & ~mask) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & mask).astype(np.int64)
    top = key & ~mask
    del key
    head = np.append(True, top[1:] != top[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    out = np.empty(n, np.int64)
    out[order] = order[lead]
    other = (rank != rank[out]) | (end != end[out])
    if other.any():  # different strings that agree in the sorted bits: their groups once more, by both ranks
        some = np.flatnonzero(np.isin(out, np.unique(out[other])))
        again = some[np.lexsort((some, end[some], rank[some]))]
        head = np.append(True, (rank[again][1:] != rank[again][:-1]) | (end[again][1:] != end[again][:-1]))
        out[again] = again[np.maximum.accumulate(np.where(head, np.arange(len(again)), 0))]
    return out


@dataclass
class Runs:
    """Runs of windows: row in its block, doc_id, first window, number of windows, representative, block."""

    row: np.ndarray
    id: np.ndarray
    at: np.ndarray
    size: np.ndarray
    token: np.ndarray
    origin: np.ndarray

    def take(self, k: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f.name)[k] for f in fields(self)))


def judge(runs: Runs, rank: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Runs, np.ndarray]:
    """Repeats among some runs' windows: spans (origin, row, start, end); runs of what isn't settled, and their windows' indices.

    ``rank`` and ``end`` are the ranks of all windows, run by run.
    """
    begin = np.cumsum(runs.size) - runs.size
    order = np.lexsort((runs.at, runs.id))
    size = runs.size[order]
    place = _text.ragged(begin[order], size)  # windows by (doc_id, position)
    run = np.repeat(order, size)
    lead = _leads(rank[place], end[place])
    again = lead != np.arange(len(lead))
    if again.any():  # rows that repeat a document have the same windows at the same places: those aren't earlier
        k = np.flatnonzero(again)
        at = lambda i: runs.at[run[i]] + place[i] - begin[run[i]]
        again[k] = (runs.id[run[k]] != runs.id[run[lead[k]]]) | (at(k) != at(lead[k]))

    def pieces(mark):
        edge = np.flatnonzero(mark & np.append(True, ~mark[:-1] | (run[1:] != run[:-1]))) if len(mark) else np.zeros(0, np.int64)
        stop = np.flatnonzero(mark & np.append(~mark[1:] | (run[1:] != run[:-1]), True)) if len(mark) else edge
        r = run[edge]
        return r, runs.at[r] + place[edge] - begin[r], stop - edge + 1

    r, at, n = pieces(again)
    found = np.stack([runs.origin[r], runs.row[r], at, at + n - 1 + LENGTH], axis=1).astype(np.int64)
    r, at, n = pieces(~again)
    return found, Runs(runs.row[r], runs.id[r], at, n, runs.token[r], runs.origin[r]), place[~again]


RUNS, META, FOUND = 0, 1, 2
SCHEMA = "part long, block long, kind int, a binary, b binary"


def _rows(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table({c.split()[0]: pa.array(x, t) for c, x, t in zip(SCHEMA.split(", "), columns, kinds, strict=True)})


def _groups(x: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut], [*cut, len(x)], strict=True)) if len(x) else []


def _spread_runs(runs: Runs, bodies: Callable[[np.ndarray], bytes], part: np.ndarray, block: int) -> list[tuple]:
    """Rows of the runs by their part."""
    order = np.argsort(part, kind="stable")
    out = []
    for lo, hi in _groups(part[order]):
        k = order[lo:hi]
        head = np.stack([runs.row[k], runs.id[k], runs.at[k], runs.size[k], runs.token[k].astype(np.int64), runs.origin[k]], axis=1).astype(np.int64)
        out.append((int(part[k[0]]), block, RUNS, _text.pack(head.reshape(-1)), bodies(k)))
    return out


def _judge_group(table: pa.Table, edges: np.ndarray, last: bool) -> pa.Table:
    """Judges the runs of a group; spans go to their blocks, and if this isn't the last step what is left to its range."""
    kind = table.column("kind").to_numpy()
    at = np.flatnonzero(kind == RUNS)
    rows = [(0, r["block"], r["kind"], r["a"], r["b"]) for r in table.take(pa.array(np.flatnonzero(kind != RUNS))).to_pylist()]
    if not len(at):
        return _rows(rows)
    heads, begin, base, body = [], [], 0, []
    for i in at:
        heads.append(_text.unpack(table.column("a")[i].as_py(), np.int64).reshape(-1, 6))
        body.append(np.frombuffer(table.column("b")[i].as_py(), np.uint8))
    head, body = np.concatenate(heads), np.concatenate(body)
    some = Runs(*head.T[:4], head[:, 4].astype(np.uint64), head[:, 5])
    length = some.size + LENGTH - 1
    begin = np.cumsum(length) - length
    rank = ranks(body)
    first = _text.ragged(begin, some.size)
    found, left, _ = judge(some, rank[first], rank[first + LENGTH - HALF])
    by = np.argsort(found[:, 0], kind="stable")
    for lo, hi in _groups(found[by, 0]):
        rows.append((0, int(found[by[lo], 0]), FOUND, found[by[lo:hi], 1:].tobytes(), None))
    if not last:
        where = np.searchsorted(edges, left.token, "right")
        # a window's bytes lie in the run that it was part of
        old = _owner(some, left)
        start = begin[old] + left.at - some.at[old]
        rows += _spread_runs(left, lambda k: body[_text.ragged(start[k], left.size[k] + LENGTH - 1)].tobytes(), where.astype(np.int64), -1)
    del body, rank, first
    _text.trim()
    return _rows(rows)


def _owner(some: Runs, left: Runs) -> np.ndarray:
    """The run of ``some`` that each run of ``left`` is part of: runs of one row of a block don't share windows."""
    order = np.lexsort((some.at, some.row, some.origin))
    rank = np.zeros(len(some.at) + len(left.at), np.int64)
    both = np.lexsort((np.append(np.zeros(len(some.at)), np.ones(len(left.at))), np.append(some.at, left.at), np.append(some.row, left.row), np.append(some.origin, left.origin)))
    rank[both] = np.cumsum(both < len(some.at)) - 1
    return order[rank[len(some.at) :]]


def spans(docs: DataFrame) -> DataFrame:
    """Spans to remove (columns id long, text): id, h (hash of the text), starts and ends (int64 bytes), a row per text that has some."""
    spark = docs.sparkSession
    parts = session.partitions(spark) * RANGES
    shared = _shared.shared_tokens(docs, tokens, "ranks")
    known = shared.where("tokens IS NOT NULL").groupBy("id").agg(F.collect_list("tokens").alias("known"), F.collect_list("freqs").alias("freqs"))
    given = docs.select("id", F.xxhash64("text").alias("h"), "text").join(known, "id", "left")
    edges = _shared.bounds(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def rows(ids, marks, entries, bodies):
            token, row, at, size, times = (np.concatenate([e[i] for e in entries]) for i in range(5))
            rank, end = (np.concatenate([e[i] for e in entries]) for i in (5, 6))
            own, length = np.array(ids, np.int64), size + LENGTH - 1
            body, begin = np.concatenate(bodies), np.cumsum(length) - length
            some = Runs(row, own[row], at, size, token, np.full(len(row), block))
            found, left, _ = judge(some, rank, end)
            old = _owner(some, left)
            start = begin[old] + left.at - at[old]
            where, salts = np.searchsorted(edges, left.token, "right").astype(np.int64), times[old].astype(np.int64) // HOT
            salt = 1 + _shared.home(block, 1 << 20) % np.maximum(salts, 1)
            part = np.where(salts > 0, salt * parts + where, where)
            out = [(_shared.home(block, parts), block, META, own.tobytes(), np.array(marks, np.int64).tobytes())]
            if len(found):
                out.append((_shared.home(block, parts), block, FOUND, found[:, 1:].tobytes(), None))
            out += _spread_runs(left, lambda k: body[_text.ragged(start[k], left.size[k] + LENGTH - 1)].tobytes(), part, block)
            return _rows(out).combine_chunks().to_batches()

        ids, marks, entries, bodies, held = [], [], [], [], 0
        for batch in batches:
            data, offsets = _text.buffers(batch.column(2))
            own, mark = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if offsets[i + 1] - offsets[i] < LENGTH:
                    continue
                text = data[offsets[i] : offsets[i + 1]]
                lists, freqs = batch.column(3)[i].as_py() or [], batch.column(4)[i].as_py() or []
                token = np.concatenate([np.frombuffer(x, np.uint64) for x in lists]) if lists else np.zeros(0, np.uint64)
                times = np.concatenate([np.frombuffer(x, np.uint16) for x in freqs]) if freqs else np.zeros(0, np.uint16)
                if len(lists) > 1:
                    token, at = np.unique(token, return_index=True)
                    times = times[at]
                first, last, token_, rank = runs(text, token)
                if not len(first):
                    continue
                size = last - first + 1
                often = np.zeros(len(first), np.uint16)
                if len(token):
                    at = np.minimum(np.searchsorted(token, token_), len(token) - 1)
                    often = np.where(token[at] == token_, times[at], 0).astype(np.uint16)
                window = _text.ragged(first, size)
                entries.append((token_, np.full(len(first), len(ids)), first, size, often, rank[window], rank[window + LENGTH - HALF]))
                bodies.append(text[_text.ragged(first, size + LENGTH - 1)])
                ids.append(own[i])
                marks.append(mark[i])
                held += len(bodies[-1])
                if held > BLOCK_BYTES or len(ids) >= _shared.BLOCK_ROWS:
                    yield from rows(ids, marks, entries, bodies)
                    ids, marks, entries, bodies, held, block = [], [], [], [], 0, block + 1
        if ids:
            yield from rows(ids, marks, entries, bodies)
        _text.trim()

    def gather(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        at = int(np.flatnonzero(kind == META)[0])
        ids, marks = (np.frombuffer(table.column(c)[at].as_py(), np.int64) for c in "ab")
        found = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(table.column("a")[i].as_py(), np.int64).reshape(-1, 3) for i in np.flatnonzero(kind == FOUND))])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        doc = np.unique(found[:, 0])
        cut = np.append(np.searchsorted(found[:, 0], doc), len(found))
        starts = [found[cut[i] : cut[i + 1], 1].tobytes() for i in range(len(doc))]
        ends = [found[cut[i] : cut[i + 1], 2].tobytes() for i in range(len(doc))]
        return pa.table({"id": pa.array(ids[doc]), "h": pa.array(marks[doc]), "starts": pa.array(starts, pa.binary()), "ends": pa.array(ends, pa.binary())})

    sent = given.mapInArrow(send, SCHEMA)
    judged = session.materialize(sent.groupBy("part").applyInArrow(lambda t: _judge_group(t, edges, t.column("part")[0].as_py() < parts), SCHEMA), "judged")
    session.drop_table(shared)
    hot = judged.where(F.col("kind") == RUNS).groupBy("part").applyInArrow(lambda t: _judge_group(t, edges, True), SCHEMA)
    all_ = judged.where(F.col("kind") != RUNS).unionByName(hot)
    out = session.materialize(all_.groupBy("block").applyInArrow(gather, "id long, h long, starts binary, ends binary"), "spans")
    session.drop_table(judged)
    return out


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return data[~gone], int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0


def _with_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with ``__spans``: (h, starts, ends) of the texts with this key."""
    rows = docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), F.lit(_LAST)))
    found = spans(rows.select(F.col("__id").alias("id"), F.col(text).alias("text")))
    found = found.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("h", "starts", "ends")).alias("__spans"))
    return rows.withColumn("__h", F.xxhash64(text)).join(found, "__id", "left").drop("__id")


def _each(batch: pa.RecordBatch, text: int, mark: int, found: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, kept bytes and removed runs of each row."""
    data, offsets = _text.buffers(batch.column(text))
    marks = batch.column(mark).to_pylist()
    for i in range(batch.num_rows):
        body = data[offsets[i] : offsets[i + 1]]
        lists = [x for x in (batch.column(found)[i].as_py() or []) if x["h"] == marks[i]]
        if lists:
            yield body, *_kept(body, *(np.concatenate([np.frombuffer(x[n], np.int64) for x in lists]) for n in ("starts", "ends")))
        else:
            yield body, body, 0


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows = _with_spans(docs.select(key, text), key, text).select(key, text, "__h", "__spans")

    def run(batches):
        for batch in batches:
            out = [(len(body), len(body) - len(kept), n, hashlib.sha256(kept.tobytes()).hexdigest()) for body, kept, n in _each(batch, 1, 2, 3)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.withColumn(key, F.col(key).cast("long")).mapInArrow(run, f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@_shared.sheltered
def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated strings; characters that a cut runs through go wholly."""
    kept = [c for c in docs.columns if c != text]
    rows = _with_spans(docs, key, text).select(*kept, text, "__h", "__spans")
    schema = docs.select(*kept, text).schema

    def run(batches):
        for batch in batches:
            k = len(kept)
            null = batch.column(k).is_null().to_pylist()
            texts = [None if none else new.tobytes().decode("utf-8", "ignore") for none, (_, new, _) in zip(null, _each(batch, k, k + 1, k + 2), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string())], names=[*kept, text])

    return rows.mapInArrow(run, schema).select(*docs.columns)


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suffix dedup removes from every document."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, (2 * p + 1)::INT, 200) AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS p FROM doc WHERE length(h) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
run AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, (p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 100)::INT AS new FROM again)) GROUP BY doc_id, g),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM run GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(range(n_spans + 1), lambda i: substr(h, (2 * CASE WHEN i = 0 THEN 0 ELSE b[i] END + 1)::INT, (2 * (CASE WHEN i = n_spans THEN length(h) // 2 ELSE a[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE b[i] END))::INT)), '')) END) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""
