"""The public BPE split pattern as array operations, and a table of words that are already encoded."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from tracelens.llm import _text

_TABLES: dict[str, np.ndarray] = {}
LETTER, NUMBER, OTHER = 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    if "cls" not in _TABLES:
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = LETTER if kind == "L" else NUMBER
        table[WHITE_SPACE] = 0
        _TABLES["cls"] = table
        _TABLES["val"] = np.random.default_rng(7).integers(1, 2**64 - 1, size=0x110000, dtype=np.uint64) | np.uint64(1)
    return _TABLES["cls"]


def pieces(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches, texts never sharing one.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    edge = first[:n].copy()
    edge[1:] |= c[1:] != c[:-1]
    start = edge.copy()
    # the last white space before something else stands alone, or with it if it is a plain space
    last = np.flatnonzero((c[:-1] == 0) & (c[1:] != 0) & ~first[1:n])
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    # contractions: a lone apostrophe that begins a match, before the letters
    quote = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & (c[1:] == LETTER) & ~first[1:n])
    if len(quote):
        one, end = cp[quote + 1], first[np.minimum(quote + 2, n)]
        two = np.where(end | (quote + 2 >= n), 0, cp[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for q, k in ((quote[short], 2), (quote[long], 3)):
            for j in range(1, k):
                start[q + j] = False
            q = q + k
            start[q[q < n]] = True
    return np.flatnonzero(start)


class WordTable:
    """Words seen by this worker with their ids; emptied when it holds ``limit`` words or ``limit_bytes`` of them."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[np.ndarray, bytes]]], limit: int = 1_000_000, limit_bytes: int = 32 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.parts: list[np.ndarray] = []
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bstart, self.bsize = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def rows(self, h: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """The table's row of each hash; ``word(i)`` gives the i-th word's text."""
        u = np.unique(h)
        inv = np.searchsorted(u, h)
        if (len(self.hash) + len(u) > self.limit or len(self.raw) > self.limit_bytes) and len(self.hash):
            self.clear()
        at = np.searchsorted(self.hash, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == u[inside]
        new = np.flatnonzero(~known)
        if len(new):
            example = np.empty(len(u), np.int64)
            example[inv[::-1]] = np.arange(len(h) - 1, -1, -1)
            got = self.encode([word(int(i)) for i in example[new]])
            size = np.array([len(x) for x, _ in got], np.int64)
            bsize = np.array([len(b) for _, b in got], np.int64)
            base = len(self.start)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.bstart = np.concatenate([self.bstart, len(self.raw) + np.cumsum(bsize) - bsize])
            self.size, self.bsize = np.concatenate([self.size, size]), np.concatenate([self.bsize, bsize])
            self.ids = np.concatenate([self.ids, *(np.asarray(x, np.uint32) for x, _ in got)])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(b for _, b in got), np.uint8)])
            self.row = np.insert(self.row, at[new], base + np.arange(len(new)))
            self.hash = np.insert(self.hash, at[new], u[new])
        return self.row[np.searchsorted(self.hash, u)][inv]


def encoded(column, table: WordTable, special: re.Pattern | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, ids, ids' offsets by row, decoded bytes, their offsets by row.

    What ``special`` matches within a text is one word, and the text on either side is split by itself.
    Words are found by their hash; that the table's words are the text is then compared byte by byte.
    """
    data, offsets = _text.buffers(column)
    classes()
    for lo, hi in _text.row_slices(offsets):
        body = data[offsets[lo] : offsets[hi]]
        off = offsets[lo : hi + 1] - offsets[lo]
        text = body.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        heads = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
        coff = heads[off]
        apart = _matches(text, coff, special) if special else coff[:0]
        start = pieces(cp, np.unique(np.concatenate([coff, *apart])) if len(apart) else coff)
        if len(apart):
            inside = np.searchsorted(apart[0], start, "right") - 1
            start = start[(inside < 0) | (start <= apart[0][inside]) | (start >= apart[1][inside])]
        end = np.append(start[1:], len(cp))
        h = _text.spans(_text.prefix(_TABLES["val"][cp]), start, end)
        row = table.rows(h, lambda i: text[start[i] : end[i]]) if len(start) else np.zeros(0, np.int64)
        at = np.searchsorted(start, coff)
        size, bsize = table.size[row], table.bsize[row]
        ids = table.ids[_text.ragged(table.start[row], size)]
        raw = table.raw[_text.ragged(table.bstart[row], bsize)]
        if len(raw) != len(body) or not np.array_equal(raw, body):  # two words share a hash, or the bytes aren't UTF-8
            got = table.encode([text[a:b] for a, b in zip(start, end, strict=True)])
            size, bsize = (np.array([len(x[i]) for x in got], np.int64) for i in (0, 1))
            ids, raw = np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, np.uint32) for x, _ in got)]), np.frombuffer(b"".join(b for _, b in got), np.uint8)
        yield lo, ids, np.concatenate([[0], np.cumsum(size)])[at], raw, np.concatenate([[0], np.cumsum(bsize)])[at]


def _matches(text: str, offsets: np.ndarray, special: re.Pattern) -> np.ndarray:
    """Starts and ends of what matches within a row."""
    found = np.array([m.span() for m in special.finditer(text)], np.int64).reshape(-1, 2)
    whole = np.searchsorted(offsets, found[:, 0], "right") == np.searchsorted(offsets, found[:, 1], "left")
    if whole.all():
        return found.T if len(found) else offsets[:0]
    rows = [(a, text[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]  # a match runs over the end of a row
    found = np.array([(a + m.start(), a + m.end()) for a, t in rows for m in special.finditer(t)], np.int64).reshape(-1, 2)
    return found.T if len(found) else offsets[:0]
