"""Which tokens of each document occur in other documents too, with their document frequency.

Rows of (token, document) would be the largest shuffle by far, so tokens travel in
blocks: a block of documents sorts its (token, row) pairs as single 64-bit numbers and
sends one slice to each token range. A range counts its tokens over all blocks and sends
back those that occur at least twice; the slices of a block then meet again and fall into
documents. Tokens are 48-bit hashes, even over ranges. A token that many rows of a block
have is added up in the block first and costs one entry there, so a range holds at most
``HEAVY`` entries of a token for each block, however many documents share it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _text

#: Text that one block takes before it is sent.
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 60_000
#: Rows of a block that have one token, from which on the block sends their number instead of them.
HEAVY = 64
_ALL = np.uint64(0xFFFF)  # stands for the rows of such a token; a block has fewer

def sheltered(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that keep the columns of their first argument: columns whose names begin like those that operators add get other names meanwhile."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        mark = "own_"
        while any(c.startswith(mark) for c in docs.columns):
            mark += "_"
        own = {c: f"{mark}{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        return f(docs.withColumnsRenamed(own), *args, **kwargs).withColumnsRenamed({v: c for c, v in own.items()})

    return run


#: A key is joined by broadcast if it has at least this part of all rows: there are no more than HOT such keys.
HOT = 5000


def met(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``value`` by ``key`` (a long) from ``right``: key, value and ``hot``, a row for each key, at most HOT of them hot.

    Hot keys are joined by broadcast. Rows that have met one are dealt by all that they hold, so no key's rows come to one task.
    """
    hot = right.where("hot").select(key, F.col(value).alias("__hot"))
    rest = right.where("NOT hot").select(F.col(key).alias("__key"), F.lit(0).alias("__off"), F.col(value).alias("__rest"))
    out = left.join(F.broadcast(hot), key, "left")
    done = F.col("__hot").isNotNull()
    out = out.withColumn("__off", done.cast("int")).withColumn("__key", F.when(done, F.xxhash64(*left.columns)).otherwise(F.col(key)))
    return out.join(rest, ["__key", "__off"], "left").withColumn(value, F.coalesce("__hot", "__rest")).drop("__key", "__off", "__hot", "__rest")


Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def bounds(parts: int) -> np.ndarray:
    """Least token of each range but the first."""
    return np.array([(i << 48) // parts for i in range(1, parts)], np.uint64)


def home(block: int, parts: int) -> int:
    """The range that a block's own rows travel with: blocks of all tasks are dealt evenly."""
    return int(_text.mix(np.array([block & (1 << 63) - 1], np.uint64))[0] % np.uint64(parts))


def shared_tokens(docs: DataFrame, extract: Extract, name: str, keep_percent: int = 0) -> DataFrame:
    """A row per row of ``docs`` (columns id long, text): id, n, tokens, frequencies.

    ``extract(bytes, offsets)`` gives tokens (uint64 below 2**48) and their row. n counts a row's
    distinct tokens; ``tokens`` are the shared ones, ascending (uint64 bytes), beside frequencies
    (uint16 bytes; 65535 stands for more, which only orders tokens). Both are null if under
    ``keep_percent`` of n or none are shared.
    """
    spark = docs.sparkSession
    session.ship(spark)
    parts = session.partitions(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        names = ["part", "block", "meta", "a", "b", "c"]
        edges = bounds(parts)

        def rows(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
            key = np.unique(np.concatenate(keys))
            own = np.concatenate(ids)
            count = np.bincount((key & _ALL).astype(np.int64), minlength=len(own)).astype(np.uint32)
            token = key >> np.uint64(16)
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(token)))
            many = np.repeat(times >= HEAVY, times)
            kept, times = key[many], times[times >= HEAVY].astype(np.uint32)
            key = np.concatenate([key[~many], np.unique(kept | _ALL)])
            key.sort()
            cut = np.concatenate([[0], np.searchsorted(key, edges << np.uint64(16)), [len(key)]])
            at = np.concatenate([[0], np.cumsum((key & _ALL) == _ALL)])[cut]
            some = [i for i in range(parts) if cut[i] < cut[i + 1]]
            a = [own.astype("<i8").tobytes(), *(_text.pack(key[cut[i] : cut[i + 1]]) for i in some)]
            b = [count.tobytes(), *(times[at[i] : at[i + 1]].tobytes() for i in some)]
            c = [_text.pack(kept), *[None] * len(some)]
            return pa.RecordBatch.from_arrays(
                [pa.array([home(block, parts), *some], pa.int32()), pa.array([block] * len(a), pa.int64()), pa.array([True] + [False] * len(some)), *(pa.array(x, pa.binary()) for x in (a, b, c))], names=names
            )

        keys, ids, size, number = [], [], 0, 0
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in _text.row_slices(offsets):
                if number and (number + hi - lo > BLOCK_ROWS or size > BLOCK_BYTES):
                    yield rows(keys, ids)
                    keys, ids, size, number, block = [], [], 0, 0, block + 1
                token, row = extract(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys.append(np.unique((token << np.uint64(16)) | (row + number).astype(np.uint64)))
                ids.append(own[lo:hi])
                number += hi - lo
                size += int(offsets[hi] - offsets[lo])
        if number:
            yield rows(keys, ids)

    def count(table: pa.Table) -> pa.Table:
        meta = table.column("meta").to_numpy(zero_copy_only=False)
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        at = np.flatnonzero(~meta)
        keys = [_text.unpack(a[i], np.uint64) for i in at]
        weights = []
        for i, key in zip(at, keys, strict=True):
            weights.append(np.ones(len(key), np.uint32))
            weights[-1][(key & _ALL) == _ALL] = np.frombuffer(b[i], np.uint32)
        token = np.concatenate([k >> np.uint64(16) for k in keys]) if keys else np.zeros(0, np.uint64)
        order = np.argsort(token)
        token = token[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        times = np.add.reduceat(np.concatenate(weights)[order], first, dtype=np.int64) if len(token) else np.zeros(0, np.int64)
        known, times = token[first][times >= 2], np.minimum(times[times >= 2], 65535).astype(np.uint16)
        del token, order, weights
        for i, key in zip(at, keys, strict=True):
            if not len(known):
                a[i], b[i] = b"", b""
                continue
            own = key >> np.uint64(16)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[place] == own
            a[i], b[i] = _text.pack(key[hit]), times[place[hit]].tobytes()
        return table.select(["part", "block", "meta"]).append_column("a", pa.array(a, pa.binary())).append_column("b", pa.array(b, pa.binary())).append_column("c", table.column("c"))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        meta = table.column("meta").to_numpy(zero_copy_only=False)
        a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
        at = int(np.flatnonzero(meta)[0])
        ids, n = np.frombuffer(a[at], "<i8"), np.frombuffer(b[at], np.uint32).astype(np.int64)
        rest = [i for i in np.flatnonzero(~meta) if b[i]]
        key = np.concatenate([_text.unpack(a[i], np.uint64) for i in rest]) if rest else np.zeros(0, np.uint64)
        times = np.concatenate([np.frombuffer(b[i], np.uint16) for i in rest]) if rest else np.zeros(0, np.uint16)
        if len(kept := _text.unpack(table.column("c")[at].as_py(), np.uint64)):
            heavy = (key & _ALL) == _ALL  # ascending, as ranges are
            known = np.searchsorted(key[heavy] >> np.uint64(16), kept >> np.uint64(16))
            key, times = np.concatenate([key[~heavy], kept]), np.concatenate([times[~heavy], times[heavy][known]])
            order = np.argsort(key)
            key, times = key[order], times[order]
        row = (key & _ALL).astype(np.uint16)
        order = np.argsort(row, kind="stable")
        token, times = (key >> np.uint64(16))[order], times[order]
        size = np.bincount(row, minlength=len(ids))
        end = np.cumsum(size)
        whole = (size > 0) & (size * 100 >= keep_percent * n)
        tokens = [token[e - s : e].tobytes() if w else None for s, e, w in zip(size, end, whole, strict=True)]
        freqs = [times[e - s : e].tobytes() if w else None for s, e, w in zip(size, end, whole, strict=True)]
        return pa.table({"id": pa.array(ids), "n": pa.array(n), "tokens": pa.array(tokens, pa.binary()), "freqs": pa.array(freqs, pa.binary())})

    schema = "part int, block long, meta boolean, a binary, b binary, c binary"
    sent = docs.select("id", "text").mapInArrow(send, schema)
    counted = sent.groupBy("part").applyInArrow(count, schema)
    return session.materialize(counted.groupBy("block").applyInArrow(gather, "id long, n long, tokens binary, freqs binary"), name)
