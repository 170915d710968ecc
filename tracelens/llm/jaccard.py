"""N-gram Jaccard join with a token-group matrix.

Every document is the set of its five-word shingles. Documents of which over a fifth of
the shingles occur nowhere else can't reach a similarity of 0.8 and link with nothing.
The others collapse to one row per equal set and are partitioned into groups of similar
sets (same least token, large groups split into bounded ones). A group stores its members'
token union. A set that links into a group must share with it one of its rarest fifth of
tokens, so only groups whose unions meet there are paired; in a pair, members whose
overlap with the other group's union is under 0.8 of their size are left out, and only
what remains is opened: overlaps of all remaining members come from one matrix product
over the tokens that both unions hold.

Links within groups come first, then each group against one hub per token, then whatever
groups are still in different components: members that already are connected are never
paired again, so a large group of copies costs a chain and not its square. Every link
between different components is found; no candidate is capped.

Null or wordless text has no shingles and links with nothing; fewer than five words are
one shingle. Equal sets are one vertex, so repeated rows and ties share their component.
A null doc_id sorts after all others. Extra columns are ignored or kept by the caller.
An empty table gives an empty result. A very long text is one set; its shingles take some 8 bytes each
where it is read and where its group is opened.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.llm import _shared, _text

WORDS = 5
PERCENT = 80
#: A group's most members and tokens.
GROUP_ROWS = 256
GROUP_TOKENS = 200_000
#: Columns of one matrix product.
COLUMNS = 4096

_STEP = np.array([pow(0xD1B54A32D192ED03, k, 1 << 64) for k in range(WORDS)], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the five-word shingles, and their rows."""
    data = _text.LOWER[data]
    start, end, at = _text.words(data, offsets)
    word = _text.spans(_text.prefix(_text.BYTE_VALUES[data]), start, end)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    tokens, rows = [], []
    if len(word) >= WORDS:
        inside = row[: len(row) - WORDS + 1] == row[WORDS - 1 :]
        h = np.zeros(len(inside), np.uint64)
        for k in range(WORDS):
            h += word[k : k + len(inside)] * _STEP[k]
        tokens.append(_text.mix(h[inside]))
        rows.append(row[: len(inside)][inside])
    count = np.diff(at)
    for k in range(1, WORDS):
        few = np.flatnonzero(count == k)
        h = np.full(len(few), k, np.uint64)
        for j in range(k):
            h += word[at[few] + j] * _STEP[j + 1 if j + 1 < WORDS else 0]
        tokens.append(_text.mix(h))
        rows.append(few)
    return np.concatenate(tokens) >> np.uint64(16), np.concatenate(rows)


class _Sets:
    """Members with their tokens side by side."""

    def __init__(self, n, size, token):
        self.n, self.size = np.asarray(n, np.int64), np.asarray(size, np.int64)
        self.end = np.cumsum(self.size)
        self.token = token
        self.row = np.repeat(np.arange(len(self.n)), self.size)


def _overlaps(a: _Sets, b: _Sets) -> np.ndarray:
    """Sizes of all intersections; rows that can't reach the threshold stay 0."""
    out = np.zeros((len(a.n), len(b.n)), np.int64)
    both = np.intersect1d(np.unique(a.token), np.unique(b.token), assume_unique=True)
    if not len(both):
        return out
    sides = []
    for s in (a, b):
        column = np.minimum(np.searchsorted(both, s.token), len(both) - 1)
        hit = both[column] == s.token
        bound = np.bincount(s.row[hit], minlength=len(s.n))  # overlap with the other side's union
        open_ = bound * 100 >= PERCENT * s.n
        hit &= open_[s.row]
        member = np.flatnonzero(open_)
        place = np.zeros(len(s.n), np.int64)
        place[member] = np.arange(len(member))
        row, column = place[s.row[hit]], column[hit]
        order = np.argsort(column, kind="stable")
        sides.append((member, row[order], column[order]))
    (ma, ra, ca), (mb, rb, cb) = sides
    total = np.zeros((len(ma), len(mb)), np.float32)
    if len(ma) and len(mb):
        for at in range(0, len(both), COLUMNS):
            width = min(COLUMNS, len(both) - at)
            dense = []
            for member, row, column in sides:
                lo, hi = np.searchsorted(column, [at, at + width])
                x = np.zeros((len(member), width), np.float32)
                x[row[lo:hi], column[lo:hi] - at] = 1
                dense.append(x)
            total += dense[0] @ dense[1].T
    out[np.ix_(ma, mb)] = total.astype(np.int64)
    return out


def _linked(a: _Sets, b: _Sets) -> np.ndarray:
    both = _overlaps(a, b)
    return (both > 0) & (100 * both >= PERCENT * (a.n[:, None] + b.n[None, :] - both))


def _labels(link: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _rarest(n: int, token: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The shared tokens among the n - ceil(0.8 n) + 1 rarest of a set; those that it shares with none come first."""
    wanted = n - (PERCENT * n + 99) // 100 + 1 - (n - len(token))
    return token if wanted >= len(token) else token[np.lexsort((token, freq))[: max(wanted, 0)]]


GROUP = "grp long, fp binary, n binary, size binary, token binary, label binary, index array<long>"


def _group(table: pa.Table) -> pa.Table:
    """One row for a group: members, labels of the components that its own links make, index tokens."""
    table = table.sort_by("fp")
    fp, n = table.column("fp").to_numpy(), table.column("n").to_numpy()
    raw, freqs = table.column("tokens").to_pylist(), table.column("freqs").to_pylist()
    tokens = [np.frombuffer(t, np.uint64) for t in raw]
    sets = _Sets(n, [len(t) for t in tokens], np.concatenate(tokens))
    label = _labels(_linked(sets, sets)) if len(n) > 1 else np.zeros(len(n), np.int64)
    index = np.unique(np.concatenate([_rarest(int(k), t, np.frombuffer(f, np.uint16)) for k, t, f in zip(n, tokens, freqs, strict=True)]))
    row = {"grp": [table.column("grp")[0].as_py()], "fp": [fp.astype("<i8").tobytes()], "n": [sets.n.tobytes()], "size": [sets.size.tobytes()], "token": [sets.token.tobytes()], "label": [fp[label].astype("<i8").tobytes()]}
    kinds = {"grp": pa.int64()} | dict.fromkeys(("fp", "n", "size", "token", "label"), pa.binary())
    return pa.table({k: pa.array(v, kinds[k]) for k, v in row.items()} | {"index": pa.array([index.astype(np.int64)], pa.list_(pa.int64()))})


def _pair(table: pa.Table) -> pa.Table:
    """Links between the two groups of a pair: edges between the labels of their members' components."""
    u, v = [], []
    if table.num_rows == 2:
        rows = table.select(["n", "size", "token", "label"]).to_pylist()
        sets = [_Sets(np.frombuffer(r["n"], np.int64), np.frombuffer(r["size"], np.int64), np.frombuffer(r["token"], np.uint64)) for r in rows]
        la, lb = (np.frombuffer(r["label"], "<i8") for r in rows)
        i, j = np.nonzero(_linked(*sets))
        if len(i):
            edge = np.unique(np.stack([la[i], lb[j]]), axis=1)
            edge = edge[:, edge[0] != edge[1]]
            u, v = edge.max(axis=0), edge.min(axis=0)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """Stars (u, v) with v the least vertex of u's component, by alternating large and small stars."""
    spark = edges.sparkSession
    e, before = session.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return e
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        old, e = e, session.materialize(small.distinct(), "edges")
        session.drop_table(old)
        session.release(spark)


def _edges(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Opens the groups of each pair (a, b) and gives the edges between them."""
    sides = pairs.select(F.col("a").alias("grp"), "a", "b").unionByName(pairs.select(F.col("b").alias("grp"), "a", "b"))
    return sides.join(groups.select("grp", "n", "size", "token", "label"), "grp").groupBy("a", "b").applyInArrow(_pair, "u long, v long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_shingles, component_id (the least key reachable by links)."""
    spark = docs.sparkSession
    last = (1 << 63) - 1
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(last)).alias("id"), F.col(text).alias("text"))
    sets = _shared.shared_tokens(rows, shingles, "shingles", PERCENT)
    session.release(spark)

    def print_(batches):
        for batch in batches:
            ids, n, tokens = (c.to_pylist() for c in batch.columns[:3])
            marks, least = [], []
            for i, k, t in zip(ids, n, tokens, strict=True):
                if t is None:
                    marks.append(None)
                    least.append(None)
                    continue
                own = b"" if len(t) == 8 * k else i.to_bytes(8, "little", signed=True)  # only wholly shared sets can be equal
                marks.append(int.from_bytes(hashlib.blake2b(t + own, digest_size=8).digest(), "little", signed=True))
                least.append(int.from_bytes(t[:8], "little"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64()), pa.array(least, pa.int64())], names=["id", "n", "tokens", "freqs", "fp", "least"])

    marked = sets.mapInArrow(print_, "id long, n long, tokens binary, freqs binary, fp long, least long")
    vertices = marked.where("fp IS NOT NULL").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "freqs", "least")), F.count("*").alias("copies"))
    vertices = session.materialize(vertices, "sets")
    linked = vertices.agg(F.sum("copies")).first()[0] or 0
    often = session.materialize(vertices.where(F.col("copies") * _shared.HOT >= linked).select("fp"), "often")  # at most HOT
    session.release(spark)
    size = (F.octet_length("tokens") / 8).cast("long")
    hot = vertices.groupBy("least").agg(F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum(size) / GROUP_TOKENS)).alias("parts")).where("parts > 1")
    dealt = vertices.join(hot, "least", "left").withColumn("grp", F.xxhash64("least", F.pmod("fp", F.coalesce("parts", F.lit(1)))))
    groups = session.materialize(dealt.select("grp", "fp", "n", "tokens", "freqs").groupBy("grp").applyInArrow(_group, GROUP), "groups")
    session.drop_table(vertices)
    session.release(spark)

    index = groups.select("grp", F.explode("index").alias("token"))
    hubs = index.groupBy("token").agg(F.min("grp").alias("hub"), F.count("*").alias("k")).where("k > 1")
    met = session.materialize(index.join(hubs.select("token", "hub"), "token"), "index")
    pairs = met.where("grp <> hub").select(F.col("hub").alias("a"), F.col("grp").alias("b")).distinct()
    first = session.materialize(_edges(groups, pairs), "links")
    stars = components(first)

    def members(batches):
        for batch in batches:
            fp, label = (np.concatenate([np.frombuffer(x, "<i8") for x in batch.column(i).to_pylist()]) for i in (1, 2))
            count = [len(x) // 8 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), count)), pa.array(fp), pa.array(label)], names=["grp", "fp", "label"])

    member = session.materialize(groups.select("grp", "fp", "label").mapInArrow(members, "grp long, fp long, label long"), "members")

    def rooted(stars):
        return member.join(stars.select(F.col("u").alias("label"), F.col("v").alias("root")), "label", "left").withColumn("root", F.coalesce("root", "label"))

    # groups that meet in a token and aren't wholly one component with each other yet
    kind = rooted(stars).groupBy("grp").agg(F.min("root").alias("root"), F.max("root").alias("top")).select("grp", F.when(F.col("root") == F.col("top"), F.col("root")).alias("root"))
    entry = met.where("grp <> hub").select("token", "grp").join(kind, "grp")
    entry = entry.unionByName(met.select("token", F.col("hub").alias("grp")).distinct().join(kind, "grp"))
    mixed = entry.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("root").isNull().cast("int")).alias("open")).where("lo <> hi OR open > 0")
    entry = entry.join(mixed.select("token"), "token")
    left, right = entry.select("token", F.col("grp").alias("a"), F.col("root").alias("ra")), entry.select("token", F.col("grp").alias("b"), F.col("root").alias("rb"))
    rest = left.join(right, "token").where("a < b AND (ra IS NULL OR rb IS NULL OR ra <> rb)").select("a", "b").distinct()
    rest = rest.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    second = session.materialize(_edges(groups, rest), "links")
    stars = components(first.unionByName(second))

    root = rooted(stars).select("fp", "root").join(F.broadcast(often.withColumn("hot", F.lit(True))), "fp", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    known = session.materialize(_shared.met(marked.select("id", "n", "fp"), session.materialize(root, "roots"), "fp", "root"), "known")
    label = known.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("rows"))
    label = session.materialize(label.withColumn("hot", F.col("rows") * _shared.HOT >= linked), "labels")
    out = _shared.met(known, label, "root", "component_id")
    null = lambda c: F.when(c != last, c)
    return out.select(null(F.col("id")).alias(key), F.col("n").alias("n_shingles"), null(F.coalesce("component_id", "id")).alias("component_id"))


@_shared.sheltered
def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key is their component's: one of each group of near-duplicates."""
    kept = join(docs, key, text).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__id")).distinct()
    rows = docs.join(kept, docs[key].eqNullSafe(kept["__id"]), "left_semi")
    return rows.withColumn("__h", F.xxhash64(text)).dropDuplicates([key, "__h"]).drop("__h")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM word),
one AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS t FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM one a JOIN one b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 80 * (na + nb - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id
"""
