"""Byte-level BPE encoding and decoding with recursive queries in DuckDB.

Each partition splits its texts by the public pattern, gives every distinct word once
to a recursive query and lays the words' ids side by side again. In the query, rows
of (word, position, token) join the merge table; every round contracts each word's
leftmost pair of least rank, until no pair is left. An ordered aggregation turns the
tokens back into bytes.

A long word is cut first, wherever no token of the vocabulary that the word holds lies
across (every merge makes such a token, so none crosses a cut), and its parts are words of
their own. A part that stays long takes a few rounds of a query that contracts all
repeats of its least pair at once; then it is cut again between the tokens that it has
by now. Queries are given work by the rows that their rounds will hold, so memory is
bounded for words of any length, and a very long text takes memory for itself, its ids and
its bytes, in one task.

Null or empty text gives no ids. Repeated rows and ties don't matter: each row is encoded
on its own, and an empty table gives an empty result. Extra columns are kept; those named
like a result give way to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tracelens import session
from tracelens.llm import _pretoken, _text

#: Rows that the rounds of one query hold at most, but for a single word.
QUERY_ROWS = 3_000_000

#: Parts of more tokens take the query that contracts a pair's repeats in one round.
LONG_TOKENS = 48
#: Rounds of that query before its parts are cut again.
ROUNDS = 8

#: Rows are dense by position within a word and carry the next token (-1 at the end).
SHORT = """
WITH RECURSIVE step(round, word, pos, tok, nxt) AS (
  SELECT 0, word, pos, tok, nxt FROM token
  UNION ALL
  (WITH best AS (
     SELECT s.word, min(m.rank::BIGINT * 64 + s.pos) AS least
     FROM step s JOIN merge m ON m.pair = s.tok::BIGINT * 65536 + s.nxt WHERE s.nxt >= 0 GROUP BY s.word),
   chosen AS (
     SELECT b.word, (b.least % 64)::INT AS pos, (b.least // 64)::INT AS rank, s.nxt
     FROM best b JOIN step s ON s.word = b.word AND s.pos = b.least % 64 + 1)
   SELECT s.round + 1, s.word, CASE WHEN s.pos > c.pos THEN s.pos - 1 ELSE s.pos END,
     CASE WHEN s.pos = c.pos THEN c.rank ELSE s.tok END,
     CASE WHEN s.pos = c.pos THEN c.nxt WHEN s.pos = c.pos - 1 THEN c.rank ELSE s.nxt END
   FROM step s JOIN chosen c ON c.word = s.word
   WHERE s.pos <> c.pos + 1)
), ended AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT s.word, s.tok FROM step s JOIN ended e ON e.word = s.word AND e.round = s.round ORDER BY s.word, s.pos
"""

DECODE = "SELECT t.word, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM token t JOIN vocab v ON v.tok = t.tok GROUP BY t.word ORDER BY t.word"

LONG = """
WITH RECURSIVE step(round, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM token
  UNION ALL
  (WITH cur AS (
     SELECT round, word, pos, tok, lead(tok) OVER w AS nxt, row_number() OVER w AS seq
     FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)),
   pair AS (
     SELECT c.word, c.seq, m.rank, min(m.rank) OVER (PARTITION BY c.word) AS best
     FROM cur c JOIN merge m ON m.pair = c.tok::BIGINT * 65536 + c.nxt),
   island AS (
     SELECT word, seq, rank, seq - row_number() OVER (PARTITION BY word ORDER BY seq) AS run FROM pair WHERE rank = best),
   chosen AS (
     SELECT word, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY seq) AS k FROM island) WHERE k % 2 = 1)
   SELECT c.round + 1, c.word, c.pos, coalesce(l.rank, c.tok)
   FROM cur c JOIN (SELECT DISTINCT word FROM chosen) a ON a.word = c.word
   LEFT JOIN chosen l ON l.word = c.word AND l.seq = c.seq
   LEFT JOIN chosen r ON r.word = c.word AND r.seq = c.seq - 1
   WHERE r.word IS NULL AND c.round < $rounds)
), ended AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT s.word, s.tok FROM step s JOIN ended e ON e.word = s.word AND e.round = s.round ORDER BY s.word, s.pos
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """The merge table of one vocabulary in a DuckDB of one thread and bounded memory."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": ""})
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, np.int32) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int32),) * 3
        table = pa.table({"pair": a.astype(np.int64) * 65536 + b, "rank": r})
        vocab = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("merge_in", table)
        self.db.execute("CREATE TABLE merge AS SELECT * FROM merge_in")
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        several = [t for t in ranks if len(t) > 1]
        self.longest = max(map(len, several), default=1)
        at = np.cumsum([0, *map(len, several)])
        self.known = np.unique(_text.spans(_text.prefix(_text.BYTE_VALUES[np.frombuffer(b"".join(several), np.uint8)]), at[:-1], at[1:]))

    def __call__(self, words: list[str]) -> list[tuple[np.ndarray, bytes]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array([self.ranks.get(w, -1) for w in raw], np.int32)  # a word that is a token takes no round
        rest = np.flatnonzero(whole < 0)
        size = np.array([len(raw[i]) for i in rest], np.int64)
        tokens = self.byte[np.frombuffer(b"".join(raw[i] for i in rest), np.uint8)]
        number, tokens = self.merged(np.repeat(rest, size), tokens)
        word, tok = np.append(np.flatnonzero(whole >= 0), number), np.append(whole[whole >= 0], tokens)
        order = np.argsort(word, kind="stable")
        word, tok = word[order], tok[order]
        cut = np.searchsorted(word, np.arange(len(raw) + 1))
        back = self.decoded(word, tok)
        return [(tok[cut[i] : cut[i + 1]].astype(np.uint32), back[i]) for i in range(len(raw))]

    def decoded(self, word: np.ndarray, tok: np.ndarray) -> list[bytes]:
        """The bytes of each word's tokens, words ascending and none missing."""
        out = []
        cut = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
        for lo, hi in _portions(np.diff(np.append(cut, len(word)))):
            lo, hi = cut[lo], cut[hi] if hi < len(cut) else len(word)
            out += [bytes.fromhex(x) for x in self.run(DECODE, word[lo:hi], tok[lo:hi]).column("hex").to_pylist()]
        return out

    def run(self, query: str, word: np.ndarray, tok: np.ndarray, **parameters) -> pa.Table:
        """A query over rows of words (ascending) and their tokens in order."""
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(first, len(word)))
        nxt = np.append(tok[1:], -1).astype(np.int32)
        nxt[first + size - 1] = -1
        pos = (np.arange(len(word)) - np.repeat(first, size)).astype(np.int32)
        self.db.register("token", pa.table({"word": word.astype(np.int32), "pos": pos, "tok": tok.astype(np.int32), "nxt": nxt}))
        out = self.db.execute(query, parameters or None).to_arrow_table()
        self.db.unregister("token")
        return out

    def crossed(self, part: np.ndarray, tok: np.ndarray) -> np.ndarray:
        """Whether some token of several neighbours within a part lies across each token's beginning."""
        n = len(tok)
        at = np.append(0, np.cumsum(self.size[tok]))
        data = np.frombuffer(b"".join(map(self.bytes.__getitem__, tok.tolist())), np.uint8)
        cover = np.zeros(n + 1, np.int32)
        piece = 1 << 18
        for lo in range(0, n, piece):
            end = min(lo + piece + self.longest, n)
            pre = _text.prefix(_text.BYTE_VALUES[data[at[lo] : at[end]]])
            start = np.arange(lo, min(lo + piece, n))
            for k in range(2, self.longest + 1):
                start = start[start + k <= end]
                start = start[(part[start + k - 1] == part[start]) & (at[start + k] - at[start] <= self.longest)]
                if not len(start):
                    break
                h = _text.spans(pre, at[start] - at[lo], at[start + k] - at[lo])
                hit = start[self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h] if len(self.known) else start[:0]
                np.add.at(cover, hit + 1, 1)
                np.add.at(cover, hit + k, -1)
        return np.cumsum(cover[:n]) > 0

    def merged(self, word: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words (ascending) and their tokens when no pair is left, from rows of words and bytes' tokens."""
        place = np.arange(len(word))  # keeps the order of what is done and what is not
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part = word
        while len(tok):
            first = np.append(True, part[1:] != part[:-1])
            size = np.diff(np.append(np.flatnonzero(first), len(part)))
            long = np.repeat(size > LONG_TOKENS, size)
            if long.any():
                cut = first.copy()
                cut[long] |= ~self.crossed(part[long], tok[long])
                first = cut
            part = np.cumsum(first) - 1
            size = np.diff(np.append(np.flatnonzero(first), len(part)))
            short = np.repeat(size <= LONG_TOKENS, size)
            done += self.rounds(SHORT, part[short], tok[short], place[short], word[short], size[size <= LONG_TOKENS] ** 2 // 2 + 1)
            rest, size = ~short, size[size > LONG_TOKENS]
            if not rest.any():
                break
            old = int(rest.sum())
            got = list(self.rounds(LONG, part[rest], tok[rest], place[rest], word[rest], size * ROUNDS, rounds=ROUNDS))
            word, tok, place, part = (np.concatenate([g[i] for g in got]) for i in range(4))
            if len(tok) == old:  # no pair is left
                done.append((word, tok, place, part))
                break
        if not done:
            return word[:0], tok[:0]
        word, tok, place = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.argsort(place, kind="stable")
        return word[order], tok[order]

    def rounds(self, query: str, part: np.ndarray, tok: np.ndarray, place: np.ndarray, word: np.ndarray, cost: np.ndarray, **parameters) -> Iterator[tuple[np.ndarray, ...]]:
        """(word, token, place, part) after a query's rounds; a part's tokens lie at its first places."""
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
        edge = np.append(first, len(part))
        for lo, hi in _portions(cost):
            own = slice(edge[lo], edge[hi])
            got = self.run(query, part[own], tok[own], **parameters)
            number, new = got.column("word").to_numpy(), got.column("tok").to_numpy()
            start = np.append(True, number[1:] != number[:-1])
            index = np.cumsum(start) - 1
            step = np.arange(len(number)) - np.flatnonzero(start)[index]
            base = edge[lo:hi][index]
            yield word[base], new, place[base] + step, number.astype(np.int64)


def _portions(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose costs add up to QUERY_ROWS at most, or single ones."""
    total, at = np.append(0, np.cumsum(cost)), 0
    while at < len(cost):
        to = max(at + 1, int(np.searchsorted(total, total[at] + QUERY_ROWS, "right")) - 1)
        yield at, to
        at = to


_WORKER: dict[str, _pretoken.WordTable] = {}


def _table(path: str) -> _pretoken.WordTable:
    if path not in _WORKER:
        _WORKER[path] = _pretoken.WordTable(Encoder(load_ranks(path)))
    return _WORKER[path]


def encode_batch(column, path: str) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    """For slices of a text column: first row, then ids and decoded bytes of each row."""
    for lo, ids, at, raw, rat in _pretoken.encoded(column, _table(path)):
        yield lo, [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)], [raw[rat[i] : rat[i + 1]].tobytes() for i in range(len(at) - 1)]


def encode(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """Adds ``token_ids`` (array<int>) and ``decoded`` (binary); with ``digests`` their counts and SHA-256 instead."""
    session.ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ({text} if digests else set())]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["token_ids", "decoded"]
    kept = [c for c in kept if c not in names]
    types = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded binary"
    source = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = docs.select(*kept).schema
    for f in StructType.fromDDL(types).fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids, raw in encode_batch(batch.column(len(kept)), path):
                part = batch.slice(lo, len(ids))
                if digests:
                    new = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())]
                else:
                    new = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True)
