"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

The kernel is the blended-spectrum presence kernel: k(x, y) counts the distinct character
n-grams (n from 1 to ``MAX_N``, letters in lower case, every other run one blank) that
both texts hold, normalised by the root of k(x, x) k(y, y). The n-grams are those of the
landmark texts, which is the space that all kernel values against landmarks live in.
With landmarks L, the feature map is k(x, L) K(L, L)**(-1/2); one-versus-rest ridge
regression is solved on it for the training sample. Scoring a batch is two matrix
products: presence rows times the landmarks' presence, then times one matrix that folds
the Nyström root and the ridge weights.

The ridge output says which language is nearest, not whether the text is in one at all. For that
a text's evidence counts: the share of its n-grams (repeats included) that the landmarks of its
language hold. ``Model.least`` is the bound of each language, fitted on the labelled sample
(median less four times its distance from the 5 % quantile or less its quarter, wider for texts
shorter than the sample's, and half of the n-grams or of the median at the least); ``identified`` drops what is below.
A language with a single landmark and no other row gives no bound.

Whole texts are scored. Only the training sample is bounded (``sample_per_lang`` texts of
at most ``sample_chars`` characters for each language, picked by a hash of their id).

Null text, and text without a letter, is ``und`` with score 0; so is every text when no
row can be learnt from. Repeated rows get equal results, languages that tie take the first
in alphabetical order, extra columns are kept and an empty table stays empty.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _shared, _text

MAX_N = 4
UNKNOWN = "und"


@functools.cache
def _fold() -> np.ndarray:
    """Code point to lower case; what isn't a letter becomes a blank. All code points are taken as one text."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 32
    text = points.tobytes().decode("utf-32-le")
    letter = np.fromiter((unicodedata.category(c)[0] == "L" for c in text), bool, len(text))
    low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text), np.uint32, len(text))
    return np.where(letter, low, np.uint32(32))


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # code point -> symbol, 0 where no landmark has it
    grams: list[np.ndarray]  # for each n, the sorted n-gram codes of the landmarks
    presence: np.ndarray  # n-grams x landmarks, 0 or 1
    norms: np.ndarray  # root of k(l, l) of each landmark
    fold: np.ndarray  # landmarks x languages
    held: np.ndarray | None = None  # n-grams x languages: how many landmarks have it
    least: np.ndarray | None = None  # languages x (median share, distance to its 5 % quantile, median count of n-grams)

    def bound(self, lang: int, count: int) -> float:
        """The least share of known n-grams for a text of ``count`` n-grams in this language."""
        middle, spread, usual = self.least[lang]
        return max(middle - max(4 * spread, middle / 4) * max(1.0, np.sqrt(usual / max(count, 1))), min(0.5, middle / 2))


def _symbols(texts: list[str]) -> np.ndarray:
    seen = np.unique(np.concatenate([_codes(t) for t in texts]))
    table = np.zeros(0x110000, np.uint16)
    table[seen] = np.arange(1, len(seen) + 1, dtype=np.uint16)[: len(seen)]
    return table


def _codes(text: str) -> np.ndarray:
    folded = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return folded[keep]


def _grams(symbols: np.ndarray) -> list[np.ndarray]:
    """Codes of all n-grams for n = 1 ... MAX_N; those with an unknown symbol are left out."""
    out, code, known = [], np.zeros(len(symbols), np.uint64), np.ones(len(symbols), bool)
    for n in range(1, MAX_N + 1):
        if n > 1:
            code, known = code[:-1], known[:-1]
        tail = symbols[n - 1 :]
        code = (code << np.uint64(16)) | tail.astype(np.uint64)
        known = known & (tail > 0)
        out.append(code[known])
        if not len(tail):
            break
    return out + [np.zeros(0, np.uint64)] * (MAX_N - len(out))


class _Lookup:
    """Presence rows over the landmarks' n-grams; lookups go through a hashed table of codes."""

    def __init__(self, model: Model):
        self.model = model
        codes = [np.asarray(g, np.uint64) for g in model.grams]
        self.base = np.cumsum([0, *(len(g) for g in codes)])
        self.bits = max(10, int(self.base[-1]).bit_length() + 3)
        self.tables = []
        for g in codes:
            slot = self.slot(g)
            first = np.full(1 << self.bits, -1, np.int32)
            first[slot[::-1]] = np.arange(len(g) - 1, -1, -1, dtype=np.int32)
            clash = np.flatnonzero(first[slot] != np.arange(len(g)))
            self.tables.append((g, first, np.sort(g[clash])))
        self.known = np.ascontiguousarray((model.held >= 1).T) if model.held is not None else None

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Columns of the n-grams that a text has, with repeats."""
        found = []
        for n, ((g, first, clash), code) in enumerate(zip(self.tables, _grams(symbols), strict=True)):
            if not len(g) or not len(code):
                continue
            at = first[self.slot(code)]
            hit = (at >= 0) & (g[at] == code)
            found.append(at[hit] + self.base[n])
            if len(clash):  # n-grams that share their slot with another
                rest = code[~hit & (at >= 0)]
                rest = rest[np.isin(rest, clash)]
                found.append(np.searchsorted(g, rest) + self.base[n])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def shares(self, text: str, need: int = 1) -> tuple[np.ndarray, int]:
        """For each language, the share of the text's n-grams that ``need`` landmarks have, and how many n-grams there are."""
        codes = _codes(text)
        total = sum(max(0, len(codes) - n) for n in range(MAX_N))
        return (self.model.held[self.columns(self.model.symbols[codes])] >= need).sum(axis=0) / max(total, 1), total

    def rows(self, texts: list[str]) -> np.ndarray:
        return self.presence([self.columns(self.model.symbols[_codes(t)]) for t in texts])

    def presence(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(found), int(self.base[-1])), np.float32)
        for i, columns in enumerate(found):
            out[i, columns] = 1
        return out

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel values of texts against landmarks."""
        return self.values(self.rows(texts))

    def values(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(x.sum(axis=1, keepdims=True))
        return (x @ self.model.presence) / np.maximum(norm * self.model.norms, 1e-9)


def train(rows: list[tuple[str, str]], landmarks_per_lang: int = 16, ridge: float = 1e-3) -> Model:
    """A model of (text, lang) rows; landmarks are the first rows of each language."""
    rows = [(t, g) for t, g in rows if t and np.any(_codes(t) != 32)]
    langs = sorted({g for _, g in rows})
    marks = [t for g in langs for t in [t for t, h in rows if h == g][:landmarks_per_lang]]
    if not marks:
        return Model([], np.zeros(0x110000, np.uint16), [np.zeros(0, np.uint64)] * MAX_N, np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    symbols = _symbols(marks)
    each = [_grams(symbols[_codes(t)]) for t in marks]
    grams = [np.unique(np.concatenate([e[n] for e in each])) for n in range(MAX_N)]
    model = Model(langs, symbols, grams, np.zeros((sum(map(len, grams)), 0), np.float32), np.ones(len(marks), np.float32), np.zeros((len(marks), len(langs))))
    look = _Lookup(model)
    presence = look.rows(marks)
    model.presence = np.ascontiguousarray(presence.T)
    model.norms = np.sqrt(presence.sum(axis=1)).astype(np.float32)
    kmm = (presence @ presence.T / np.outer(model.norms, model.norms)).astype(np.float64)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.concatenate([look.kernel([t for t, _ in rows[i : i + 256]]) for i in range(0, len(rows), 256)]).astype(np.float64) @ root
    target = np.where(np.array([g for _, g in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = np.array([1.0 / sum(h == g for _, h in rows) for _, g in rows])[:, None] * len(rows) / len(langs)
    w = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ (weight * target))
    model.fold = (root @ w).astype(np.float32)
    owner = [i for i, g in enumerate(langs) for _ in range(min(landmarks_per_lang, sum(h == g for _, h in rows)))]
    model.held = np.stack([presence[[o == i for o in owner]].sum(axis=0) for i in range(len(langs))], axis=1).astype(np.uint16)
    least = []
    for i, g in enumerate(langs):
        own = [t for t, h in rows if h == g]
        # a landmark is judged by the others, like a text that isn't one
        got = [look.shares(t, 2 if k < landmarks_per_lang else 1) for k, t in enumerate(own)]
        share, count = np.array([x[i] for x, _ in got]), np.array([n for _, n in got])
        middle = np.median(share)
        least.append((middle, middle - np.quantile(share, 0.05), np.median(count)))
    model.least = np.array(least)
    return model


#: Texts in one matrix product.
BATCH = 64


def predict(model: Model, look: _Lookup, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages, and scores: the ridge output of the language moved to 0 ... 1."""
    lang, score, _ = _judged(model, look, texts, False)
    return lang, score


def _judged(model: Model, look: _Lookup, texts: list[str | None], evidence: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and with ``evidence`` whether enough of the text's n-grams are known in that language."""
    lang, score, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    # any letter at all: a fold that leaves something besides blanks
    codes = {i: c for i, t in enumerate(texts) if t and np.any((c := _codes(t)) != 32)}
    some = list(codes)
    for k in range(0, len(some) if model.langs else 0, BATCH):
        part = some[k : k + BATCH]
        found = [look.columns(model.symbols[codes[i]]) for i in part]
        out = look.values(look.presence(found)) @ model.fold
        best = out.argmax(axis=1)
        for i, b, o, columns in zip(part, best, out, found, strict=True):
            lang[i] = model.langs[b]
            score[i] = min(1.0, max(0.0, (float(o[b]) + 1) / 2))
            if evidence:
                count = sum(max(0, len(codes[i]) - n) for n in range(MAX_N))
                known[i] = np.count_nonzero(look.known[b][columns]) / max(count, 1) >= model.bound(b, count)
    return lang, score, known


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_per_lang: int = 160, sample_chars: int = 20_000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learns from rows that aren't held out; the sample's size per language bounds what the driver gets."""
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & (F.length(text) <= sample_chars)).select(F.col(text).alias("t"), F.col(lang).alias("g"), F.xxhash64(F.col(key), F.lit(1)).alias("h"))
    counts = {r["g"]: r["n"] for r in known.groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row per language
    # twice the share that is needed of each language, then exactly the least hashes
    share = {g: min(1.0, 2.0 * sample_per_lang / n + 20.0 / n) for g, n in counts.items()}
    limit = F.lit(None).cast("long")
    for g, s in sorted(share.items()):
        limit = F.when(F.col("g") == g, F.lit(int(-(2**63) + s * (2**64 - 1)) if s < 1 else 2**63 - 1)).otherwise(limit)
    rows = known.where(F.col("h") <= limit).collect()
    out, have = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        if have[r["g"]] < sample_per_lang:
            have[r["g"]] += 1
            out.append((r["t"], r["g"]))
    return train(out)


@_shared.sheltered
def classify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds (or replaces) ``lang_pred`` and ``score``, and with a third name whether the evidence is enough; the model is broadcast, its size set by the landmarks."""
    spark = docs.sparkSession
    session.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    schema = schema.add(names[2], "boolean") if len(names) > 2 else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(shared.value)
        for batch in batches:
            _, offsets = _text.buffers(batch.column(len(kept)))
            for lo, hi in _text.row_slices(offsets, 2 << 20, 2048):
                part = batch.slice(lo, hi - lo)
                lang, score, known = _judged(shared.value, look, part.column(len(kept)).to_pylist(), len(names) > 2)
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known)][: len(names)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=[*kept, *names])

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(run, schema)


@_shared.sheltered
def identified(docs: DataFrame, min_score: float = 0.25) -> DataFrame:
    """The documents whose language is known: those that the model accepts on enough evidence, with their own columns."""
    rows = classify(docs, fit(docs), names=("__lang", "__score", "__known"))
    return rows.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score) & F.col("__known")).select(*docs.columns)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs)).drop("text")
