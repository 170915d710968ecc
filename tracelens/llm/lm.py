"""Language-model scores by online logistic context mixing over bits.

A text is scored as its bytes with A-Z in lower case, each the path in a binary code tree built from what
followed the byte before in the training texts (an end of text is one more symbol), so that likely bytes take few binary
decisions. It falls into units: a word with the white space (or end) that ends it. For each decision
three predictors look up the log-odds that the training texts gave to (context, node of the tree):

* the two symbols before, across units; from a unit's fifth symbol on the three before, with the class that the third predictor has;
* the unit so far;
* the unit so far after the last of the ``CLASSES`` most frequent units that the text had before,
  which tells its language or form.

Logistic mixing adds them up by weights that are gated by how sure the two longer contexts are. Weights
are learnt by logistic regression on all decisions of all training texts, each predicted from the counts
less the one sight that it gave itself, and a refinement stage, keyed by the quantised mixed log-odds and
the gate, learns there what such predictions came to. Log-odds are small whole numbers, so these
decisions are added up exactly, by log-odds and outcome, and no text need be left out for them. Every document starts from these weights and refines its own by gradient, after blocks of its
symbols that grow with what has been coded; a block is scored by the weights from before it. The bits
of all decisions add up to the text's, and their base-10 logarithm is the score.

Counts and frequent units cover all training texts, exactly, and grow with the corpus. Texts travel in blocks. A block
adds up what it has and asks ranges: it sends each (class, unit) that it holds once, with its training count, to
the range of its first ``HEAD`` symbols, and contexts that end before that, which units share, as number codes. A range
adds up all blocks' counts by context and sends back the log-odds along the path of each symbol that
was asked for. Nothing of the counts is broadcast; the model that travels with the code is the trees, the class list and the weights,
whose sizes are fixed. A hot word or context costs one entry for each block.

The base score is a unigram model over words with add-half smoothing. Words travel as 64-bit hashes
with their rows and counts, in blocks by hash range; a range adds up its training counts and sends back sums per row.

Null text is empty text, which has the end alone. Repeated rows count each for themselves and score
alike; with no training text every c is 0 and every decision costs one bit. Only the key and the text are read, so
other columns, whatever their names, make no difference; an empty table gives an empty result. A text, however
long, is coded whole by one task, which takes some 30 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _shared, _text

END = 256
SYMBOLS = 257
#: Symbols of a unit whose contexts are sent as codes.
HEAD = 4
#: Frequent units that tell texts apart; class 0 is a text that had none of them yet, and ALL counts every class.
CLASSES = 32
ALL = 63
#: Low bits of a key, which name the symbol by its leaf; the top 16 are the range's, the others the context's.
LOW = np.uint64(511)
PREDICTORS = 3
#: Log-odds are stored in quarters; mixed log-odds are rounded to 64ths, so that both outcomes' chances add up to 1.
SCALE = 4.0
#: What each outcome counts before it was seen.
PRIOR = 0.25
FINE, REACH = 64, 12
LEVELS = 2 * FINE * REACH + 1
_GRID = np.arange(-FINE * REACH, FINE * REACH + 1) / FINE
_CHANCE = (1 / (1 + np.exp(-_GRID))).astype(np.float32)
#: Sureness by stored log-odds: none, mixed or weak, one or two sights of one outcome, more.
SURE = np.digitize(np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(int)), [1, 6, 10]).astype(np.int32)
GATES = 16
#: A task tells of units that make up at least this share of its own; all of them where that leaves the most frequent ones open.
UNIT_SHARE = 1 / 50_000
#: Ranges that units and symbols are added up in, at most: a task tells each of them one row.
CENSUS_PARTS = 64
#: Log-odds and outcome of a decision in one number.
SPAN = 255
#: Symbols of the first blocks of a text and of the longest; how far a block's gradient moves the weights.
FIRST, LONGEST = 64, 512
RATE, CALM = 0.2, 12.0
#: Decisions of a text that the gradient is taken from: one of so many.
STRIDE = 3
#: Text of one block of texts, and of what is coded at once.
BLOCK_BYTES = 4 << 20
SLICE = 1 << 20
#: Keys that are added up at once, about; and those whose paths are looked up, or symbols hashed: longer runs only take memory.
KEYS, PATHS = 1 << 20, 1 << 17
#: Blocks are coded in so many turns: the answers of one turn are on disk twice, as table and as shuffle.
TURNS = 4
#: The setting for bytes of a batch between Spark and Python, and rows of a batch that comes back.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", 16
#: How tables of packed rows are written: as they are, in small pages and row groups, which readers hold whole.
PACKED = {"compression": "none", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 8, "parquet.page.size.row.check.min": 8}
#: White space and the end of a text end a unit.
ENDS = np.append(_text.SPACE, True)
_ENDING = np.array([*np.flatnonzero(_text.SPACE), END], np.int16)
_TURN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Code:
    """Code trees, by what came before: a symbol in its tree has the number tree * SYMBOLS + symbol."""

    tree: np.ndarray  # symbol before, plus 1 (0: nothing), -> its tree; what ends a unit counts as nothing
    size: np.ndarray  # number -> decisions
    node: np.ndarray  # depth x number, hashed
    bit: np.ndarray  # depth x number
    leaf: np.ndarray  # number -> place from left to right, so that symbols under one node are neighbours
    symbol: np.ndarray  # tree * SYMBOLS + place -> number
    start: np.ndarray  # number -> where its outcomes begin in ``path``
    path: np.ndarray

    def numbers(self, sym: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Numbers of symbols by the symbols before them (plus 1, or 0)."""
        return self.tree[before] * np.int32(SYMBOLS) + sym


#: Symbols before that have a tree of their own make up at least this share of the training texts.
OWN_TREE = 1 / 1000


def _tree(counts: np.ndarray) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """A Huffman tree of the 257 symbols, every one with a path, seen or not: (node, way) from the root, and the symbols from left to right."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
    under = {i: [i] for i in range(SYMBOLS)}
    for node in range(SYMBOLS - 1):
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in under[x]:
            paths[s].append((node, 0))
        for s in under[y]:
            paths[s].append((node, 1))
        under[SYMBOLS + node] = under.pop(x) + under.pop(y)
        heapq.heappush(heap, (a + b, SYMBOLS + node, SYMBOLS + node))
    paths = [p[::-1] for p in paths]
    return paths, np.array(sorted(range(SYMBOLS), key=lambda s: [way for _, way in paths[s]]))


def trees(counts: np.ndarray) -> Code:
    """Trees from counts of (symbol before plus 1, symbol); rare symbols before share the tree of all."""
    counts = np.asarray(counts).reshape(SYMBOLS + 1, SYMBOLS)
    total = counts.sum(axis=1)
    own = [0, *(p for p in range(1, SYMBOLS + 1) if not ENDS[p - 1] and total[p] >= max(1, OWN_TREE * total.sum()))]
    tree = np.full(SYMBOLS + 1, len(own), np.int32)
    tree[own] = np.arange(len(own))
    tree[1:][ENDS] = 0
    made = [_tree(counts[p]) for p in own] + [_tree(counts.sum(axis=0))]
    size = np.array([len(x) for p, _ in made for x in p], np.int64)
    node, bit = np.zeros((size.max(), len(size)), np.uint32), np.zeros((size.max(), len(size)), np.int32)
    for t, (way, _) in enumerate(made):
        for sym, path in enumerate(way):
            for depth, (n, b) in enumerate(path):
                node[depth, t * SYMBOLS + sym], bit[depth, t * SYMBOLS + sym] = (n + 1) * 0x9E3779B1 & 0xFFFFFFFF, b
    leaf = np.concatenate([np.argsort(order) for _, order in made]).astype(np.uint64)
    symbol = np.concatenate([order + t * SYMBOLS for t, (_, order) in enumerate(made)]).astype(np.int32)
    path = np.concatenate([bit[:n, i] for i, n in enumerate(size)]).astype(np.int32)
    return Code(tree, size, node, bit, leaf, symbol, (np.cumsum(size) - size).astype(np.int32), path)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols in lower case, each text followed by its end, and where each text starts."""
    out = np.insert(_text.LOWER[data].astype(np.int16), offsets[1:], END)
    return out, offsets + np.arange(len(offsets))


def decisions(code: Code, sym: np.ndarray) -> Iterator[tuple[int, np.ndarray | None, np.ndarray]]:
    """By depth: which of the symbols still decide (None: all), and those symbols."""
    at, size = None, code.size[sym]
    for depth in range(len(code.node)):
        if (keep := size > depth).all():
            yield depth, at, sym
            continue
        at = np.flatnonzero(keep) if at is None else at[keep]
        sym, size = sym[keep], size[keep]
        if not len(sym):
            return
        yield depth, at, sym


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their times."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and every key's number among them."""
    order = np.argsort(keys)
    own = keys[order]
    head = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(head, dtype=np.int32) - 1
    return own[head], number


def paths(code: Code, keys: np.ndarray, times: np.ndarray, tails: bool) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`all_paths` gives, without the losses."""
    out, _, start = all_paths(code, keys, times, tails)
    return out, start


def all_paths(code: Code, keys: np.ndarray, times: np.ndarray, tails: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds (in quarters) for the outcome that the path takes, for all decisions on each key's path; what they lose if it was seen once less (0 if never seen); and where each path starts.

    What was seen once is alike on every path so, and compresses well; :func:`begins` has the outcomes.
    ``keys`` are ascending and hold all that was counted in their contexts; they are ``tails`` or codes.
    """
    sym = key_numbers(code, keys, tails)
    start = np.concatenate([[0], np.cumsum(code.size[sym])])
    out, loss = np.zeros(start[-1], np.int8), np.zeros(start[-1], np.int8)
    lo = 0
    while lo < len(keys):  # some whole contexts at a time
        last = keys[min(lo + PATHS, len(keys)) - 1] | LOW
        hi = int(np.searchsorted(keys, last, "right"))
        _paths(code, sym[lo:hi], keys[lo:hi] >> np.uint64(9), times[lo:hi], start[lo:hi], out, loss)
        lo = hi
    return out, loss, start


def looked_up(code: Code, keys: list[np.ndarray], times: list[np.ndarray], tails: bool) -> list[tuple[bytes, bytes]]:
    """For each block's keys (ascending): the packed log-odds of their paths by all blocks' times, and their losses.

    Some whole contexts at a time, however many a range has: all units that begin alike come to one.
    """
    if not keys:
        return []
    number = sum(len(k) for k in keys)
    stride = max(1, KEYS // (8 * max(len(keys), 1)))
    some = np.sort(np.concatenate([k[::stride] for k in keys])) | LOW  # the last keys of contexts
    cuts = [np.searchsorted(k, np.unique(some[:: max(1, len(some) * KEYS // max(number, 1))][1:]), "right") for k in keys]
    cuts = [np.concatenate([[0], c, [len(k)]]) for c, k in zip(cuts, keys, strict=True)]
    out: list[tuple[list, list]] = [([], []) for _ in keys]
    for step in range(len(cuts[0]) - 1):
        own = [slice(int(c[step]), int(c[step + 1])) for c in cuts]
        known, n = summed(np.concatenate([k[o] for k, o in zip(keys, own, strict=True)]), np.concatenate([t[o] for t, o in zip(times, own, strict=True)]).astype(np.int64))
        odds, loss, start = all_paths(code, known, n, tails)
        for k, o, (a, b) in zip(keys, own, out, strict=True):
            to = np.searchsorted(known, k[o])
            at = _text.ragged(start[to], start[to + 1] - start[to])
            a.append(odds[at])
            b.append(loss[at])
    done = []
    for k, (a, b) in enumerate(out):
        odds, out[k] = np.concatenate(a), ([], [])
        done.append((squeezed(odds.tobytes()), lost(odds, np.concatenate(b))))
    return done


def _paths(code: Code, sym: np.ndarray, context: np.ndarray, times: np.ndarray, start: np.ndarray, out: np.ndarray, loss: np.ndarray) -> None:
    for depth, at, s in decisions(code, sym):
        if not len(s):
            break
        at = np.arange(len(s)) if at is None else at
        node, own, n = code.node[depth][s], context[at], times[at].astype(np.float64)
        group = np.cumsum(np.append(True, (own[1:] != own[:-1]) | (node[1:] != node[:-1]))) - 1
        one, both = np.bincount(group, n * code.bit[depth][s]), np.bincount(group, n)
        odds = np.clip(np.rint(np.log((one + PRIOR) / (both - one + PRIOR)) * SCALE), -127, 127).astype(np.int8)
        way = code.bit[depth][s]
        here = start[at] + depth
        out[here] = own = np.where(way == 1, odds[group], -odds[group])
        taken = np.where(way == 1, one[group], (both - one)[group])
        less = np.rint(np.log((np.maximum(taken - 1, 0) + PRIOR) / (both[group] - taken + PRIOR)) * SCALE)
        loss[here] = np.where(taken > 0, own - np.clip(less, -127, 127).astype(np.int8), 0)


def key_numbers(code: Code, keys: np.ndarray, tails: bool) -> np.ndarray:
    """Numbers of the symbols that keys ask for: a key tells what came before, so which tree it is."""
    context = (keys >> np.uint64(9)).astype(np.int64)
    if tails:
        tree = context & 255
    else:
        place = np.where(context >> 38 & 1, context >> 27 & 3, HEAD - 1)  # of a pair: both symbols are there
        tree = code.tree[np.where(place > 0, context >> (9 * (HEAD - 1 - place)) & 511, 0)]
    return code.symbol[tree * SYMBOLS + (keys & LOW).astype(np.int64)]


def unit_starts(sym: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, ENDS[sym[:-1]])) if len(sym) else np.zeros(0, np.int64)


def hashes(sym: np.ndarray, start: np.ndarray, size: np.ndarray, whole: bool = True) -> np.ndarray:
    """Hashes of units (``start``, ``size``; side by side in ``sym``), or of what stands before each of their symbols."""
    out = np.empty(len(start) if whole else len(sym), np.uint64)
    at, total = 0, np.append(start, len(sym))
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PATHS, "right")) - 1)
        lo, hi = int(total[at]), int(total[to])
        pre = _text.prefix(_text.SYMBOL_VALUES[sym[lo:hi]])
        own = start[at:to] - lo
        if whole:
            out[at:to] = _text.spans(pre, own, own + size[at:to])
        else:
            out[lo:hi] = _text.spans(pre, np.repeat(own, size[at:to]), np.arange(hi - lo))
        at = to
    return out


def classes(unit: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Class of each unit: which frequent one its text had last before it. ``first``: the first unit of its text."""
    index = np.arange(len(unit))
    order = np.argsort(frequent)
    known = frequent[order]
    at = np.minimum(np.searchsorted(known, unit), max(len(known) - 1, 0))
    hit = known[at] == unit if len(known) else np.zeros(len(unit), bool)
    last = np.append(-1, np.maximum.accumulate(np.where(hit, index, -1))[:-1]) if len(unit) else index
    return np.where(last >= first, order[at[np.maximum(last, 0)]] + 1 if len(known) else 0, 0).astype(np.int64)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and every key's number among them; keys that agree in the sorted bits only may have several."""
    n = len(key)
    low = max(1, int(n).bit_length())
    mask = np.uint64((1 << low) - 1)
    both = (key & ~mask) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & mask).astype(np.int32)
    both >>= np.uint64(low)
    head = np.append(True, both[1:] != both[:-1]) if n else np.zeros(0, bool)
    del both
    group = np.cumsum(head, dtype=np.int32) - np.int32(1)
    place = order[head]
    other = np.flatnonzero(key[order] != key[place[group]])
    group[other] = len(place) + np.arange(len(other))
    number = np.empty(n, np.int32)
    number[order] = group
    return np.concatenate([place, order[other]]), number


def indices(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans of a block's symbols: every symbol's span, and its place."""
    at = np.repeat((start - (np.cumsum(size) - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return np.repeat(np.arange(len(size), dtype=np.int32), size), at


def ranged(context: np.ndarray) -> np.ndarray:
    """16 bits that deal contexts to ranges, as the top of a key."""
    return _text.mix(context * _TURN + np.uint64(1)) >> np.uint64(48) << np.uint64(48)


def tail_keys(leaf: np.ndarray, tree: np.ndarray, kind: np.ndarray, head: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Keys of the symbols after a unit's head: the head's 16 bits, 31 of the hash of class and prefix, and the tree."""
    context = _text.mix(prefix + (kind.astype(np.uint64) + np.uint64(1)) * _TURN) >> np.uint64(33)
    return head | (context << np.uint64(17)) | (tree.astype(np.uint64) << np.uint64(9)) | leaf


def pair_keys(leaf: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys of symbols after two others (18 bits)."""
    return ranged(before) | (before << np.uint64(9)) | leaf


@dataclass
class Entries:
    """Distinct (class, unit) pairs: symbols side by side, and the keys of all their symbols, for their class and for all."""

    kind: np.ndarray
    size: np.ndarray
    sym: np.ndarray
    head: np.ndarray  # the range's 16 bits of each entry

    @classmethod
    def of(cls, kind: np.ndarray, size: np.ndarray, sym: np.ndarray) -> Entries:
        start = np.cumsum(size) - size
        first = [np.where(size > j, sym[np.minimum(start + j, max(len(sym) - 1, 0))] + 1, 0).astype(np.uint64) if len(size) else np.zeros(0, np.uint64) for j in range(HEAD)]
        mixed = np.zeros(len(size), np.uint64)
        for f in first:
            mixed = (mixed << np.uint64(9)) | f
        return cls(kind, size, sym, ranged(mixed))

    def numbers(self, code: Code) -> np.ndarray:
        before = np.append(0, self.sym[:-1] + 1)[: len(self.sym)]
        before[np.cumsum(self.size) - self.size] = 0
        return code.numbers(self.sym, before)

    def heads(self, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Entry and place of the first symbols, the distinct keys (two rows: class, ALL), and each symbol's number among them."""
        start = np.cumsum(self.size) - self.size
        n = np.minimum(self.size, HEAD)
        entry, at = indices(start, n)
        place = (at - start[entry]).astype(np.uint64)
        whole = (self.kind[entry].astype(np.uint64) << np.uint64(2)) | place
        for j in range(HEAD - 1):
            whole = (whole << np.uint64(9)) | np.where(place > j, self.sym[np.minimum(start + j, max(len(self.sym) - 1, 0))][entry] + 1, 0).astype(np.uint64)
        leaf = code.leaf[self.numbers(code)[at]]
        some, number = distinct(_text.mix((whole << np.uint64(9)) | leaf))
        context = np.stack([whole[some], (whole[some] & np.uint64((1 << 29) - 1)) | np.uint64(ALL << 29)]) | np.uint64(1 << 38)
        return entry, at, ranged(context) | (context << np.uint64(9)) | leaf[some], number

    def lates(self, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`heads`, for the symbols after them: keys (one row) of their class and the three symbols before."""
        start = np.cumsum(self.size) - self.size
        n = np.maximum(self.size - HEAD, 0)
        entry, at = indices(start + HEAD, n)
        whole = self.kind[entry].astype(np.uint64)
        for j in range(HEAD - 1, 0, -1):
            whole = (whole << np.uint64(9)) | (self.sym[at - j] + 1).astype(np.uint64)
        leaf = code.leaf[self.numbers(code)[at]]
        some, number = distinct(_text.mix((whole << np.uint64(9)) | leaf))
        context = whole[some] | np.uint64(1 << 37)
        return entry, at, ranged(context) | (context << np.uint64(9)) | leaf[some], number

    def tails(self, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.cumsum(self.size) - self.size
        n = np.maximum(self.size - HEAD, 0)
        entry, at = indices(start + HEAD, n)
        prefix = hashes(self.sym, start, self.size, whole=False)[at]
        number = self.numbers(code)[at]
        out = np.empty((2, len(at)), np.uint64)
        for k in range(0, len(at), PATHS):
            own, e, z = slice(k, k + PATHS), entry[k : k + PATHS], number[k : k + PATHS]
            for row, kind in zip(out, (self.kind[e], np.full(len(e), ALL)), strict=True):
                row[own] = tail_keys(code.leaf[z], z // SYMBOLS, kind, self.head[e], prefix[own])
        return entry, at, out

    def long(self) -> np.ndarray:
        return np.flatnonzero(self.size > HEAD)

    def take(self, k: np.ndarray) -> Entries:
        start = np.cumsum(self.size) - self.size
        return Entries(self.kind[k], self.size[k], self.sym[_text.ragged(start[k], self.size[k])], self.head[k])

    def packed(self) -> bytes:
        """Bytes from which :meth:`unpacked` makes the entries again: the last symbol of a unit is one of few."""
        end = np.cumsum(self.size) - 1
        body = np.ones(len(self.sym), bool)
        body[end] = False
        last = np.searchsorted(_ENDING, self.sym[end]).astype(np.uint8)
        return squeezed(len(self.size).to_bytes(8, "little") + self.kind.astype(np.uint8).tobytes() + last.tobytes() + _text.pack(self.size.astype(np.uint32)) + self.sym[body].astype(np.uint8).tobytes())

    @classmethod
    def unpacked(cls, raw: bytes) -> Entries:
        raw = loosened(raw)
        n = int.from_bytes(raw[:8], "little")
        kind, last = np.frombuffer(raw, np.uint8, 2 * n, 8).reshape(2, n)
        size = _text.unpack(raw[8 + 2 * n : 8 + 6 * n], np.uint32).astype(np.int64)
        sym = np.empty(int(size.sum()), np.int16)
        body = np.ones(len(sym), bool)
        body[np.cumsum(size) - 1] = False
        sym[body], sym[~body] = np.frombuffer(raw, np.uint8, offset=8 + 6 * n), _ENDING[last]
        return cls.of(kind.astype(np.int64), size, sym)


@dataclass
class Block:
    """Texts with what they ask for: the distinct keys of codes and tails, and where each symbol's paths are among them."""

    number: np.ndarray  # of each symbol in its tree
    starts: np.ndarray
    entries: Entries
    times: np.ndarray  # training units of each entry
    codes: np.ndarray  # ascending
    code_times: np.ndarray
    unit: np.ndarray  # first symbol of each unit
    entry: np.ndarray  # entry of each unit
    pair: np.ndarray  # number of each symbol's pair among ``pairs``
    pairs: np.ndarray  # number of each pair among the codes
    head_at: np.ndarray  # the entries' first symbols
    head_code: np.ndarray  # numbers of theirs among the codes (two rows: class, ALL)
    late_at: np.ndarray  # the entries' other symbols
    late_code: np.ndarray


def _alphabet(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols, and each symbol's number among them from 1 on."""
    used = np.flatnonzero(np.bincount(sym, minlength=SYMBOLS))
    number = np.zeros(SYMBOLS, np.int32)
    number[used] = np.arange(1, len(used) + 1)
    return used, number


def analysed(code: Code, frequent: np.ndarray, data: np.ndarray, offsets: np.ndarray, counted: np.ndarray) -> Block:
    """A block of texts; ``counted`` texts are learnt from."""
    sym, starts = symbols(data, offsets)
    unit = unit_starts(sym)
    size = np.diff(np.append(unit, len(sym)))
    own = hashes(sym, unit, size)
    first = np.searchsorted(unit, starts[:-1])
    units = np.diff(np.append(first, len(unit)))
    kind = classes(own, np.repeat(first, units), frequent)
    place, entry = distinct(_text.mix(own + (kind.astype(np.uint64) + np.uint64(1)) * _TURN))
    del own
    entries = Entries.of(kind[place], size[place], sym[_text.ragged(unit[place], size[place])])
    times = np.bincount(entry, np.repeat(counted, units), len(place)).astype(np.int64)
    # pairs: a dense table over the two symbols before that the block has, and its alphabet
    used, rank = _alphabet(sym)
    width, back = len(used) + 1, np.append(-1, used) + 1
    dense, number = np.empty(len(sym), np.int32), np.empty(len(sym), np.int32)
    seen = np.zeros(width**2, bool)
    for lo, hi in _text.row_slices(starts, SLICE):
        a, b = int(starts[lo]), int(starts[hi])
        s = rank[sym[a:b]]
        one, two = np.zeros(b - a, np.int32), np.zeros(b - a, np.int32)
        one[1:], two[2:] = s[:-1], s[:-2]
        first = starts[lo:hi] - a
        one[first] = two[first] = 0
        two[np.minimum(first + 1, b - a - 1)] = 0
        dense[a:b], number[a:b] = two * width + one, code.numbers(sym[a:b], back[one])
        seen[dense[a:b]] = True
    both = np.flatnonzero(seen)
    place_of = np.zeros(width**2, np.int32)
    place_of[both] = np.arange(len(both))
    seen, n = np.zeros(len(both) * width, bool), np.zeros(len(both) * width, np.int64)
    for lo, hi in _text.row_slices(starts, SLICE):
        a, b = int(starts[lo]), int(starts[hi])
        dense[a:b] = own = place_of[dense[a:b]] * width + rank[sym[a:b]]
        seen[own] = True
        n += np.bincount(own[np.repeat(counted[lo:hi], np.diff(starts[lo : hi + 1]))], minlength=len(n))
    have = np.flatnonzero(seen)
    n = n[have]
    earlier = both[have // width]
    just = back[earlier % width]
    context = (back[earlier // width].astype(np.uint64) << np.uint64(9)) | just.astype(np.uint64)
    pairs = pair_keys(code.leaf[code.numbers(back[have % width] - 1, just)], context)
    to = np.zeros(len(seen), np.int32)
    to[have] = np.arange(len(have))
    dense = to[dense]
    del sym, seen, to
    who, head_at, keys, head = entries.heads(code)
    late_who, late_at, late_keys, late = entries.lates(code)
    codes, index = numbered(np.concatenate([pairs, keys.reshape(-1), late_keys]))
    head_code = index[len(pairs) : len(pairs) + keys.size].reshape(2, -1)
    each = np.bincount(head, times[who], keys.shape[1])
    code_times = np.bincount(index, np.concatenate([n, each, each, np.bincount(late, times[late_who], len(late_keys))]), len(codes)).astype(np.int64)
    return Block(number, starts, entries, times, codes, code_times, unit, entry, dense, index[: len(pairs)], head_at, head_code[:, head], late_at, index[len(pairs) + keys.size :][late])


def begins(code: Code, block: Block, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the paths of each pair and of each symbol of the entries (after three symbols, or -1; for ALL; for their class) begin in the answers, codes' before tails'; and the answers for the outcome 1."""
    begin = lambda z: np.append(0, np.cumsum(code.size[z])).astype(np.int32)
    of_codes = key_numbers(code, block.codes, False)
    code_begin = begin(of_codes)
    place = np.empty((2, len(block.entries.sym)), np.int32)
    place[:, block.head_at] = code_begin[block.head_code]
    at, keys = block.entries.tails(code)[1:]
    tails, number = numbered(keys.reshape(-1))
    del keys
    of_tails = key_numbers(code, tails, True)
    place[:, at] = (code_begin[-1] + begin(of_tails))[number.reshape(2, -1)]
    del at, tails, number
    odds = answers.copy()
    for lo, z in ((0, of_codes), (int(code_begin[-1]), of_tails)):
        for k in range(0, len(z), PATHS):
            way = code.path[_text.ragged(code.start[z[k : k + PATHS]].astype(np.int64), code.size[z[k : k + PATHS]])]
            own = odds[lo : lo + len(way)]
            np.negative(own, out=own, where=way == 0)
            lo += len(way)
    late = np.full(len(block.entries.sym), -1, np.int32)
    late[block.late_at] = code_begin[block.late_code]
    return code_begin[block.pairs], late, place[1], place[0], odds


def _near(pair: np.ndarray, late: np.ndarray) -> np.ndarray:
    return np.where(late >= 0, late, pair)


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def loosened(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def lost(odds: np.ndarray, loss: np.ndarray) -> bytes:
    """Bytes of what log-odds lose, ordered by them: few losses go with one, so they compress well."""
    return squeezed(loss[np.argsort(odds, kind="stable")].tobytes())


def lessened(odds: np.ndarray, raw: bytes) -> np.ndarray:
    """Log-odds less what :func:`lost` packed."""
    order = np.argsort(odds, kind="stable")
    out = np.empty(len(odds), np.int8)
    out[order] = odds[order] - np.frombuffer(loosened(raw), np.int8)
    return out


@dataclass
class Model:
    """Weights of the predictors by gate, and what refined predictions cost: bits by gate, level and outcome."""

    weights: np.ndarray  # GATES x PREDICTORS, for stored log-odds
    cost: np.ndarray

    @classmethod
    def plain(cls) -> Model:
        return cls.made(np.full((GATES, PREDICTORS), 0.45), np.tile(_GRID, (GATES, 1)))

    @classmethod
    def made(cls, weights: np.ndarray, refined: np.ndarray) -> Model:
        cost = np.stack([np.logaddexp(0, refined), np.logaddexp(0, -refined)], axis=2) / np.log(2)
        return cls((weights / SCALE).astype(np.float32), cost.astype(np.float32).reshape(-1))


def levels(mixed: np.ndarray) -> np.ndarray:
    mixed *= np.float32(FINE)
    mixed += np.float32(FINE * REACH + 0.5)
    np.clip(mixed, 0, LEVELS - 1, out=mixed)
    return mixed.astype(np.int32)


def gates(word: np.ndarray, classed: np.ndarray) -> np.ndarray:
    return SURE[word.view(np.uint8)] * 4 + SURE[classed.view(np.uint8)]


def expanded(code: Code, sym: np.ndarray, begin: list[np.ndarray], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For all decisions of these symbols: how many each symbol takes, the outcomes and the predictors' log-odds."""
    n = code.size[sym]
    first = (np.cumsum(n) - n).astype(np.int32)
    step = np.arange(int(n.sum()), dtype=np.int32)
    at = lambda b: np.repeat(b - first, n) + step
    return n, code.path[at(code.start[sym])], [odds[at(b)] for b in begin]


def learnt(at_gate: np.ndarray, x: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> Model:
    """Weights by logistic regression within each gate (pulled to those of all gates), then the refinement of what they predict.

    A row stands for as many decisions as ``times`` says, or for one.
    """
    times = np.ones(len(bit)) if times is None else times.astype(float)

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start.copy()
        for _ in range(8):
            p = 1 / (1 + np.exp(-np.clip(x[rows] @ w, -REACH, REACH)))
            weight = (p * (1 - p) + 1e-4) * times[rows]
            step = np.linalg.solve((x[rows] * weight[:, None]).T @ x[rows] + 20 * np.eye(PREDICTORS), x[rows].T @ ((bit[rows] - p) * times[rows]) - 20 * (w - start))
            w = w + np.clip(step, -0.5, 0.5)
        return w

    plain = np.full(PREDICTORS, 0.45)
    if not len(bit):
        return Model.plain()
    common = fit(np.arange(len(bit)), plain)
    weights = np.stack([fit(rows, common) if len(rows := np.flatnonzero(at_gate == g)) else common for g in range(GATES)])
    mixed = np.clip((x * weights[at_gate]).sum(axis=1), -REACH, REACH)
    # what came of predictions near each half of a unit of log-odds, with as much weight again for the prediction itself
    knots = np.arange(-REACH, REACH + 0.25, 0.5)
    near = np.rint((mixed + REACH) * 2).astype(int)
    refined = np.empty((GATES, LEVELS))
    for g in range(GATES):
        own = at_gate == g
        n, one = np.bincount(near[own], times[own], len(knots)), np.bincount(near[own], bit[own] * times[own], len(knots))
        p = 1 / (1 + np.exp(-knots))
        share = (one + 50 * p) / (n + 50)
        refined[g] = np.interp(_GRID, knots, np.log(share / (1 - share)))
    return Model.made(weights, refined)


def sample_decisions(code: Code, block: Block, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gate, log-odds and outcome of all decisions of a block."""
    pair, late, word, classed, odds = begins(code, block, odds)
    at = _text.ragged((np.cumsum(block.entries.size) - block.entries.size)[block.entry], block.entries.size[block.entry])
    _, bit, (a, b, c) = expanded(code, block.number, [_near(pair[block.pair], late[at]), word[at], classed[at]], odds)
    return gates(b, c), np.stack([a, b, c], axis=1) / SCALE, bit.astype(float)


def tallied(code: Code, block: Block, odds: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each (log-odds, outcome) was decided in the ``counted`` texts of a block, as :func:`untallied` reads it."""
    pair, late, word, classed, odds = begins(code, block, odds)
    entry_start = np.cumsum(block.entries.size) - block.entries.size
    unit_at = np.searchsorted(block.unit, block.starts)
    low, high = (int(odds.min()), int(odds.max())) if len(odds) else (0, 0)
    width = high - low + 1
    total = np.zeros(2 * width**PREDICTORS, np.int64)
    for lo, hi in _text.row_slices(block.starts, SLICE >> 1):
        a, b = int(block.starts[lo]), int(block.starts[hi])
        e = block.entry[int(unit_at[lo]) : int(unit_at[hi])]
        at = _text.ragged(entry_start[e], block.entries.size[e])
        own = np.flatnonzero(np.repeat(counted[lo:hi], np.diff(block.starts[lo : hi + 1])))
        at = at[own]
        _, bit, x = expanded(code, block.number[a:b][own], [_near(pair[block.pair[a:b][own]], late[at]), word[at], classed[at]], odds)
        number = np.zeros(len(bit), np.int32)
        for v in x:
            number *= np.int32(width)
            number += v
            number -= np.int32(low)
        total += np.bincount(number * np.int32(2) + bit, minlength=len(total))
    some = np.flatnonzero(total)
    rest, out = some >> 1, some & 1
    for k in range(PREDICTORS):
        out += (rest % width + low + SPAN // 2) * (2 * SPAN**k)
        rest //= width
    return out, total[some]


def untallied(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gate, log-odds and outcome of decisions by their numbers."""
    rest = number >> 1
    a, b, c = ((rest // SPAN**k % SPAN - SPAN // 2).astype(np.int8) for k in (2, 1, 0))
    return gates(b, c), np.stack([a, b, c], axis=1) / SCALE, (number & 1).astype(float)


def bits(code: Code, model: Model, block: Block, odds: np.ndarray) -> np.ndarray:
    """Cost in bits of each text of a block; documents lie side by side, a block of each at a time."""
    pair, late, word, classed, odds = begins(code, block, odds)
    entry_start = np.cumsum(block.entries.size) - block.entries.size
    out = np.zeros(len(block.starts) - 1)
    unit_at = np.searchsorted(block.unit, block.starts)
    for lo, hi in _text.row_slices(block.starts, SLICE):
        a, b = int(block.starts[lo]), int(block.starts[hi])
        own = slice(int(unit_at[lo]), int(unit_at[hi]))
        e = block.entry[own]
        at = _text.ragged(entry_start[e], block.entries.size[e])
        out[lo:hi] = _coded(code, model, block.number[a:b], block.starts[lo : hi + 1] - a, [_near(pair[block.pair[a:b]], late[at]), word[at], classed[at]], odds)
    return out


def _coded(code: Code, model: Model, sym: np.ndarray, starts: np.ndarray, begin: list[np.ndarray], odds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(starts) - 1)
    weights = [np.tile(model.weights[:, k], (len(total), 1)) for k in range(PREDICTORS)]
    at, end, length, turn = starts[:-1].copy(), starts[1:], FIRST, 0
    going = np.arange(len(total))
    while len(going := going[at[going] < end[going]]):
        n = np.minimum(length, end[going] - at[going])
        pos = _text.ragged(at[going], n)
        each, bit, x = expanded(code, sym[pos], [b[pos] for b in begin], odds)
        first = np.append(0, np.cumsum(each))[np.cumsum(n) - n]  # of each text's decisions
        decided = np.diff(np.append(first, len(bit)))
        gate = gates(x[1], x[2])
        at_weight = np.repeat(np.arange(len(going), dtype=np.int32) * GATES, decided) + gate
        local = [w[going].reshape(-1) for w in weights]
        mixed = local[0][at_weight] * x[0]
        for w, v in zip(local[1:], x[1:], strict=True):
            mixed += w[at_weight] * v
        level = levels(mixed)
        gate *= LEVELS
        gate += level
        gate += gate
        gate += bit
        total[going] += np.add.reduceat(model.cost[gate], first, dtype=np.float64)
        # every STRIDE-th decision of each text tells the gradient
        taken = -(-decided // STRIDE)
        pick = np.repeat(first - STRIDE * (np.cumsum(taken) - taken), taken) + STRIDE * np.arange(int(taken.sum()))
        some = at_weight[pick].astype(np.int64)
        miss = (bit[pick] - _CHANCE[level[pick]]).astype(np.float64)
        seen = np.bincount(some, minlength=len(local[0])) + CALM / STRIDE
        for w, v, whole in zip(local, x, weights, strict=True):
            step = np.bincount(some, miss * v[pick], len(w)) * (RATE / SCALE / SCALE) / seen
            whole[going] = (w + step).reshape(-1, GATES)
        at[going] += n
        turn += 1
        if turn % 2 == 0:
            length = min(length * 2, LONGEST)
    return total


def _slices(batch_column, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = _text.buffers(batch_column)
    for lo, hi in _text.row_slices(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def census(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the training texts (column text): counts of (symbol before plus 1, symbol), where what ends a unit counts as nothing before; and the hashes of the most frequent units, ascending."""
    counts, frequent = _census(docs, UNIT_SHARE)
    return counts, _census(docs, 0)[1] if frequent is None else frequent


def told(batches: Iterator[pa.RecordBatch], share: float, parts: int) -> Iterator[pa.RecordBatch]:
    """A task's counts for :func:`_census`, a row for each range: packed symbols and units, each with their times, and what a unit that isn't told of may have."""
    total = np.zeros((SYMBOLS + 1) * SYMBOLS, np.int64)
    units, times, new, number = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        for _, _, data, offsets in _slices(batch.column(0), SLICE):
            sym, _ = symbols(data, offsets)
            before = np.append(0, np.where(ENDS[sym[:-1]], 0, sym[:-1] + 1))
            total += np.bincount(before * SYMBOLS + sym, minlength=len(total))
            start = unit_starts(sym)
            new.append(summed(hashes(sym, start, np.diff(np.append(start, len(sym)))), np.ones(len(start), np.int64)))
            number += len(start)
            if sum(len(k) for k, _ in new) > max(SLICE, len(units)):
                units, times = (np.concatenate([old, *x]) for old, x in zip((units, times), zip(*new, strict=True), strict=True))
                units, times = summed(units, times)
                new = []
    units, times = summed(*(np.concatenate([old, *(x[k] for x in new)]) for k, old in enumerate((units, times))))
    least = max(1, int(number * share))
    kept = times >= least
    missing = 0 if kept.all() else least - 1
    units, times, some = units[kept], times[kept], np.flatnonzero(total)
    cut = np.concatenate([[0], np.searchsorted(units, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)), [len(units)]])
    own = np.searchsorted(some, np.arange(parts + 1) * len(total) // parts)
    rows = [i for i in range(parts) if cut[i] < cut[i + 1] or own[i] < own[i + 1]]
    sent = [[squeezed(_text.pack(x[at[i] : at[i + 1]])) for i in rows] for x, at in ((some, own), (total[some], own), (units, cut), (times, cut))]
    columns = [pa.array(rows, pa.int32()), *(pa.array(x, pa.binary()) for x in sent), pa.array([missing] * len(rows), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "a", "b", "c", "d", "missing"])
    _text.trim()


def _census(docs: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray | None]:
    """As :func:`census`; no units if those that make up less than ``share`` of a task's could be among the most frequent."""
    parts = min(session.partitions(docs.sparkSession), CENSUS_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return told(batches, share, parts)

    def add(table: pa.Table) -> pa.Table:
        """A range's symbols and its most frequent units."""
        read = lambda name, dtype: np.concatenate([_text.unpack(loosened(x), dtype) for x in table.column(name).to_pylist()])
        some, n = summed(read("a", np.int64), read("b", np.int64))
        units, times = summed(read("c", np.uint64), read("d", np.int64))
        most = np.lexsort((units, -times))[: CLASSES + 1]
        out = [[x.tobytes()] for x in (some, n, units[most], times[most])]
        missing = int(table.column("missing").to_numpy().sum())
        _text.trim()
        return pa.table({"part": table.column("part")[:1], **{k: pa.array(x, pa.binary()) for k, x in zip("abcd", out, strict=True)}, "missing": pa.array([missing], pa.int64())})

    schema = "part int, a binary, b binary, c binary, d binary, missing long"
    added = session.materialize(docs.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema), "census")
    found = added.toArrow()  # at most 66,307 symbols after another, and some units of each range
    session.drop_table(added)
    read = lambda name, dtype: np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for x in found.column(name).to_pylist())])
    out = np.zeros((SYMBOLS + 1) * SYMBOLS, np.int64)
    out[read("a", np.int64)] = read("b", np.int64)
    units, times = read("c", np.uint64), read("d", np.int64)
    most = np.lexsort((units, -times))[: CLASSES + 1]  # ties as in frequent_units
    missing = max([0, *found.column("missing").to_pylist()])
    n = [*times[most].tolist(), *[0] * (CLASSES + 1)]
    sure = missing == 0 or n[CLASSES - 1] > n[CLASSES] + missing
    return out.reshape(SYMBOLS + 1, SYMBOLS), np.sort(units[most[:CLASSES]]) if sure else None


def frequent_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of the most frequent units of some texts."""
    sym, _ = symbols(data, offsets)
    start = unit_starts(sym)
    own, n = np.unique(hashes(sym, start, np.diff(np.append(start, len(sym)))), return_counts=True)
    return own[np.lexsort((own, -n))][:CLASSES]


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability)."""
    spark = docs.sparkSession
    before = spark.conf.get(BATCH)
    # a group is made of batches as it comes; an executor's memory outside its heap holds some whole batches of each task
    spark.conf.set(BATCH, "1m")
    try:
        return _score(docs, key, text)
    finally:
        spark.conf.set(BATCH, before)


def _score(docs: DataFrame, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    session.ship(spark)
    # ids may be null: the last long stands for null on the way
    last = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(last)).alias("id"), held_out(key).alias("held"), F.col(text).alias("text"))
    counts, frequent = census(rows.where("NOT held"))
    code = trees(counts)
    parts = session.partitions(spark)
    names = ["part", "block", "kind", "a", "b", "c", "d"]
    edges = np.array([(i << 16) // parts for i in range(1, parts)], np.uint64) << np.uint64(48)

    def cuts(keys: np.ndarray, bounds: np.ndarray = edges) -> list[tuple[int, int, int]]:
        """Ranges that have keys, and where these are."""
        cut = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
        return [(i, int(cut[i]), int(cut[i + 1])) for i in range(parts) if cut[i] < cut[i + 1]]

    def table_of(rows: list[tuple]) -> pa.Table:
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(names, zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of texts, and what they ask of the ranges."""
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def blocks_(texts, sizes, ids, held):
            data, size, own, held_ = (np.concatenate(x) for x in (texts, sizes, ids, held))
            got = analysed(code, frequent, data, np.append(0, np.cumsum(size)), ~held_)
            meta = own.tobytes() + held_.astype(np.int64).tobytes() + size.tobytes()
            out = [(_shared.home(block, parts), block, 1, meta, squeezed(data.tobytes()), None, None)]
            slices: dict[int, list] = {}
            for i, lo, hi in cuts(got.codes):
                slices.setdefault(i, [None] * 4)[:2] = squeezed(_text.pack(got.codes[lo:hi])), squeezed(_text.pack(got.code_times[lo:hi].astype(np.uint32)))
            long = got.entries.long()
            long = long[np.argsort(got.entries.head[long], kind="stable")]
            for i, lo, hi in cuts(got.entries.head[long]):
                slices.setdefault(i, [None] * 4)[2:] = got.entries.take(long[lo:hi]).packed(), squeezed(_text.pack(got.times[long[lo:hi]].astype(np.uint32)))
            out += [(i, block, 0, *s) for i, s in slices.items()]
            return table_of(out).to_batches(max_chunksize=BATCH_ROWS)

        texts, sizes, ids, held, size, number = [], [], [], [], 0, 0
        for batch in batches:
            own, out = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in _slices(batch.column(2), SLICE):
                if number and (number + hi - lo > 60_000 or size > BLOCK_BYTES):
                    yield from blocks_(texts, sizes, ids, held)
                    _text.trim()
                    texts, sizes, ids, held, size, number, block = [], [], [], [], 0, 0, block + 1
                texts.append(data)
                sizes.append(np.diff(offsets).astype(np.int64))
                ids.append(own[lo:hi].astype(np.int64))
                held.append(out[lo:hi].astype(bool))
                number += hi - lo
                size += len(data)
        if number:
            yield from blocks_(texts, sizes, ids, held)
        _text.trim()

    def answer(table: pa.Table) -> pa.Table:
        """What a range knows of the paths that each block asked for: log-odds in a and c, their losses in b and d."""
        kind = table.column("kind").to_numpy()
        a, b, c, d = (table.column(x).to_pylist() for x in "abcd")
        at = np.flatnonzero(kind == 0)
        own = [i for i in at if a[i] is not None]
        keys = [_text.unpack(loosened(a[i]), np.uint64) for i in own]
        times = [_text.unpack(loosened(b[i]), np.uint32) for i in own]
        for i, got in zip(own, looked_up(code, keys, times, False), strict=True):
            a[i], b[i] = got
        own = [i for i in at if c[i] is not None]
        keys, times = [], []
        for i in own:
            who, _, k = (e := Entries.unpacked(c[i])).tails(code)
            k, n = summed(k.reshape(-1), np.tile(_text.unpack(loosened(d[i]), np.uint32).astype(np.int64)[who], 2))
            keys.append(k)
            times.append(n.astype(np.uint32))
            c[i] = d[i] = e = who = k = n = None
        for i, got in zip(own, looked_up(code, keys, times, True), strict=True):
            c[i], d[i] = got
        del keys, times
        _text.trim()
        out = table.select(["part", "block", "kind"])
        for name, column in zip("abcd", (a, b, c, d), strict=True):
            out = out.append_column(name, pa.array(column, pa.binary()))
        return out

    def opened(table: pa.Table, less: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, held, texts, offsets and answered paths of a block; ``less``: without each outcome's own sight."""
        table = table.sort_by("part")
        kind = table.column("kind").to_numpy()
        at = int(np.flatnonzero(kind == 1)[0])
        own, held_, size = np.frombuffer(table.column("a")[at].as_py(), np.int64).reshape(3, -1)
        data = np.frombuffer(loosened(table.column("text")[at].as_py()), np.uint8)
        answers = [np.zeros(0, np.int8)]
        for x, y in ("ab", "cd"):
            for i in np.flatnonzero(kind == 0):
                if (raw := table.column(x)[i].as_py()) is not None:
                    odds = np.frombuffer(loosened(raw), np.int8)
                    answers.append(lessened(odds, table.column(y)[i].as_py()) if less else odds)
        return own, held_, data, np.append(0, np.cumsum(size)), np.concatenate(answers)

    def tally(table: pa.Table) -> pa.Table:
        """What the decisions of a block's training texts came to, each without its own sight."""
        own, held_, data, offsets, odds = opened(table, less=True)
        got = analysed(code, frequent, data, offsets, np.zeros(len(own), bool))
        number, n = tallied(code, got, odds, held_ == 0)
        del got, odds
        _text.trim()
        return pa.table({"number": pa.array(number), "n": pa.array(n)})

    schema = "part int, block long, kind int, a binary, b binary, c binary, d binary"
    asking = rows.select("id", "held", "text").mapInArrow(ask, schema)
    answered = session.materialize(asking.groupBy("part").applyInArrow(answer, schema), "answers", **PACKED)
    own_row = F.col("kind") == 1  # whose column b is the texts

    def in_turns(step: Callable[[DataFrame], DataFrame], name: str) -> list[DataFrame]:
        """Tables of what comes of the answers, some blocks at a time."""
        turn = F.pmod(F.xxhash64("block"), F.lit(TURNS))
        given = answered.withColumn("text", F.when(own_row, F.col("b"))).withColumn("b", F.when(~own_row, F.col("b")))
        return [session.materialize(step(given.where(turn == k)), name, **PACKED) for k in range(TURNS)]

    def added(tallies: DataFrame) -> DataFrame:
        return tallies.groupBy("number").agg(F.sum("n").alias("n"))

    tallies = in_turns(lambda x: added(x.groupBy("block").applyInArrow(tally, "number long, n long")), "tallies")
    found = added(functools.reduce(DataFrame.unionByName, tallies)).orderBy("number").toArrow()  # a row for each log-odds and outcome that occur, whatever the corpus
    for t in tallies:
        session.drop_table(t)
    model = learnt(*untallied(found.column("number").to_numpy()), found.column("n").to_numpy())
    del found
    shared = spark.sparkContext.broadcast(model)

    def coded(table: pa.Table) -> pa.Table:
        """A block's texts are coded; its words go to the ranges."""
        block = table.column("block")[0].as_py()
        own, held_, data, offsets, odds = opened(table)
        cost = bits(code, shared.value, analysed(code, frequent, data, offsets, np.zeros(len(own), bool)), odds)
        del odds
        _text.trim()
        words = []
        for lo, hi in _text.row_slices(offsets, PATHS):
            low, off = _text.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
            first, end, where = _text.words(low, off)
            words.append((_text.spans(_text.prefix(_text.BYTE_VALUES[low]), first, end), np.repeat(np.arange(lo, hi), np.diff(where))))
        h, row = np.concatenate([w for w, _ in words]), np.concatenate([r for _, r in words])
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(h))).astype(np.uint32)
        h, row = h[first], row[first]
        n = np.bincount(row, times, len(own)).astype(np.int64)
        pair = (row.astype(np.uint32) << np.uint32(1)) | (held_[row] == 0).astype(np.uint32)
        meta = own.tobytes() + held_.tobytes() + n.tobytes() + cost.tobytes()
        out = [(_shared.home(block, parts), block, 1, meta, None, None, None)]
        out += [(i, block, 0, *(squeezed(_text.pack(x[lo:hi])) for x in (h, pair, times)), None) for i, lo, hi in cuts(h, word_edges)]
        del words, h, row, order, first, times, pair
        _text.trim()
        return pa.Table.from_batches(table_of(out).drop_columns(["d"]).to_batches(max_chunksize=BATCH_ROWS))

    word_edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def count(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        at = np.flatnonzero(kind == 0)
        words = [_text.unpack(loosened(a[i]), np.uint64) for i in at]
        pairs = [_text.unpack(loosened(b[i]), np.uint32) for i in at]
        times = [_text.unpack(loosened(c[i]), np.uint32) for i in at]
        known, total = np.zeros(0, np.uint64), np.zeros(0)
        if len(at):
            trained = [(p & 1).astype(bool) for p in pairs]
            h = np.concatenate([w[t] for w, t in zip(words, trained, strict=True)])
            n = np.concatenate([x[t] for x, t in zip(times, trained, strict=True)])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order].astype(np.float64)
            del order, trained
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            known, total = h[first], np.add.reduceat(n, first) if len(h) else n
            del h, n, first
            _text.trim()
        for i, w, p, x in zip(at, words, pairs, times, strict=True):
            got = np.zeros(len(w))
            if len(known):
                k = np.minimum(np.searchsorted(known, w), len(known) - 1)
                got = np.where(known[k] == w, total[k], 0.0)
            row = p >> 1
            own, start = np.unique(row, return_inverse=True)
            a[i] = own.astype(np.int64).tobytes()
            b[i] = np.bincount(start, np.log10(got + 0.5) * x, len(own)).tobytes()
            c[i] = np.bincount(start, (got > 0) * x, len(own)).tobytes()
        del words, pairs, times
        part = table.column("part")
        a.append(np.array([len(known)], np.int64).tobytes())
        b.append(np.array([int(total.sum())], np.int64).tobytes())
        c.append(None)
        old = pa.table({"part": part, "block": table.column("block"), "kind": table.column("kind")})
        new = pa.table({"part": pa.array([part[0].as_py()], pa.int32()), "block": pa.array([-1 - part[0].as_py()], pa.int64()), "kind": pa.array([2], pa.int32())})
        head = pa.concat_tables([old, new])
        del known, total
        _text.trim()
        return pa.table({n: head.column(n) for n in ("part", "block", "kind")} | {n: pa.array(x, pa.binary()) for n, x in zip("abc", (a, b, c), strict=True)})

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        kind = table.column("kind").to_numpy()
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        fields = ["id", "held", "n", "known", "base", "bits", "types", "trained"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        if kind[0] == 2:
            columns = [[None], [None], [None], [None], [None], [None], [int(np.frombuffer(a[0], np.int64)[0])], [int(np.frombuffer(b[0], np.int64)[0])]]
            return pa.table({n: pa.array(x, t) for n, x, t in zip(fields, columns, types, strict=True)})
        ids, held, n, cost = np.frombuffer(a[int(np.flatnonzero(kind == 1)[0])], np.int64).reshape(4, -1)
        base, known = np.zeros(len(ids)), np.zeros(len(ids))
        for i in np.flatnonzero(kind == 0):
            row = np.frombuffer(a[i], np.int64)
            base[row] += np.frombuffer(b[i], np.float64)
            known[row] += np.frombuffer(c[i], np.float64)
        columns = [ids, held, n, known.astype(np.int64), base, np.ascontiguousarray(cost).view(np.float64), [None] * len(ids), [None] * len(ids)]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(fields, columns, types, strict=True)})

    words = "part int, block long, kind int, a binary, b binary, c binary"
    sent = in_turns(lambda x: x.select("part", "block", "kind", "a", "c", "text").groupBy("block").applyInArrow(coded, words), "words")
    session.drop_table(answered)
    counted = functools.reduce(DataFrame.unionByName, sent).groupBy("part").applyInArrow(count, words)
    out = session.materialize(counted.groupBy("block").applyInArrow(gather, "id long, held long, n long, known long, base double, bits double, types long, trained long"), "scores")
    for t in sent:
        session.drop_table(t)
    stats = out.agg(F.sum("types").alias("v"), F.sum("trained").alias("n"), F.sum(1 - F.col("held")).alias("ends")).first()
    ends = stats["ends"] or 0
    total, types = (stats["n"] or 0) + ends, (stats["v"] or 0) + (ends > 0)
    each = float(np.log10(total + 0.5 * (types + 1)))
    tokens = F.col("n") + 1
    return out.where("id IS NOT NULL").select(
        F.when(F.col("id") != last, F.col("id")).alias(key),
        (F.col("held") == 1).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 0.5)) - tokens * each).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        F.col("bits").alias("total_bits"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
