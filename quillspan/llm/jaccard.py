"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed five-word shingles (fewer words: one shingle of all). Texts with one set
are one class of copies and are compared once. Classes that agree in all MinHash rows of a band are
tied to the least of that band's bucket, and the ties are followed to clusters; only members of one
cluster can be partners. Within a cluster MinHash values are compared ROUND at a time; with a uniform
prior, P(similarity >= THRESHOLD | matches so far) is a binomial tail, and pairs fall out as soon as it
is below TOLERANCE. What is left is verified exactly on the sets.

Clusters are dealt out in pairs of blocks of about BLOCK members and BLOCK_BYTES, by a hash of each
member, so none must fit into one task, and tasks return counts and a spanning forest of their links,
not the links themselves. A cluster of m members costs m * m / 2 comparisons of signatures.

A row is told by (doc_id, hash of its text), so reused and null ids lose nothing.

Cases: a null text or one without words has no shingles, no links and is its own class; repeated rows
are copies of each other; a null doc_id names a class only if none of the class has one; an empty table
gives no rows; other columns are ignored, whatever their names. Very long texts are hashed in pieces for
their signatures; a task holds the sets of the texts that it verifies.
"""

from __future__ import annotations

from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .store import cut, discard, release, written

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, ROUND, SEED = 24, 5, 20, 5
VALUES = BANDS * ROWS
BLOCK, BLOCK_BYTES, SALTS = 256, 16 << 20, 64
#: Pairs to verify from which on sets are compared by matrix products instead of one by one.
MANY = 2000

_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += 32
_IN = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_rng = np.random.default_rng(SEED)
_POW = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes (unsigned 64 bits)."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    inside = _IN[b]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
    weight = _POW[place & 1023]
    if place.max() > 1023:
        weight += (place >> 10).astype(np.uint64) * _STEP[-1]
    letters = np.where(inside, (_LOW[b] + np.uint64(1)) * weight, np.uint64(0))
    w = _mix(np.add.reduceat(letters, starts))
    n = min(WORDS, len(w))
    s = sum((w[j : len(w) - n + 1 + j] * _STEP[j] for j in range(1, n)), w[: len(w) - n + 1] * _STEP[0])
    return np.unique(_mix(s + np.uint64(n)))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        h = s[at : at + 2048, None] * _A + _B
        out = np.minimum(out, (h >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def least_matches() -> list[tuple[int, int]]:
    """(compared, least matches to go on) after each round."""
    out = []
    for n in range(ROUND, VALUES + 1, ROUND):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= TOLERANCE:
                break
            m += 1
        out.append((n, m))
    return out


_LEAST = least_matches()


def likely(left: np.ndarray, right: np.ndarray, same: bool):
    """(i, j) index arrays of the pairs of signatures that stay likely to reach THRESHOLD; same: i < j only."""
    i, j = np.triu_indices(len(left), 1) if same else (x.ravel() for x in np.indices((len(left), len(right))))
    agree = np.zeros(len(i), np.int64)
    done = 0
    for n, m in _LEAST:
        agree += (left[i, done:n] == right[j, done:n]).sum(axis=1)
        keep = agree >= m
        i, j, agree, done = i[keep], j[keep], agree[keep], n
    return i, j


def common(lefts: list[np.ndarray], rights: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sets."""
    sizes = [len(s) for s in [*lefts, *rights]]
    values, at = np.unique(np.concatenate([*lefts, *rights]), return_inverse=True)
    sets = np.split(at, np.cumsum(sizes)[:-1])
    lefts, rights = sets[: len(lefts)], sets[len(lefts) :]
    if len(i) < MANY:
        mark, out = np.zeros(len(values), bool), np.zeros(len(i), np.int64)
        for a in np.unique(i):
            mark[lefts[a]] = True
            for p in np.flatnonzero(i == a):
                out[p] = mark[rights[j[p]]].sum()
            mark[lefts[a]] = False
        return out
    out = np.zeros((len(lefts), len(rights)), np.float32)  # whole numbers below 2**24 are exact
    for lo in range(0, len(values), 4096):
        a, b = (np.zeros((len(side), 4096), np.float32) for side in (lefts, rights))
        for held, side in ((a, lefts), (b, rights)):
            for k, x in enumerate(side):
                held[k, x[np.searchsorted(x, lo) : np.searchsorted(x, lo + 4096)] - lo] = 1
        out += a @ b.T
    return out[i, j].astype(np.int64)


def links_between(left, right, left_sig: np.ndarray, right_sig: np.ndarray, same: bool):
    """(i, j) index arrays of the pairs of texts with similarity THRESHOLD or more; same: i < j only."""
    i, j = likely(left_sig, right_sig, same)
    if not len(i):
        return i, j
    here, there = np.unique(i), np.unique(j)
    lefts, rights = [shingles(left[k]) for k in here], [shingles(right[k]) for k in there]
    p, q = np.searchsorted(here, i), np.searchsorted(there, j)
    both = common(lefts, rights, p, q)
    total = np.array([len(s) for s in lefts])[p] + np.array([len(s) for s in rights])[q]
    # In whole numbers: both / union >= 4 / 5.
    good = 5 * both >= 4 * (total - both)
    return i[good], j[good]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (least node of its component).

    Each node points to its least neighbour, the pointers are followed to their ends, and the edges are
    carried over to these; what is left is at most half of the nodes, and edges within them go."""
    names = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    left = written(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x <> y").distinct())
    label = cut(names.select("node", F.col("node").alias("root")))
    while not left.isEmpty():
        both = left.union(left.select("y", "x"))
        up = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")))
        while True:
            further = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nexts = cut(up.join(further, "root").select("node", "root", "top"))
            up = nexts.select("node", F.col("top").alias("root"))
            if nexts.filter("top <> root").isEmpty():
                break
        ends = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_"))
        moved = left.join(ends("x"), "x").join(ends("y"), "y").select(F.greatest("x_", "y_").alias("x"), F.least("x_", "y_").alias("y"))
        fewer = written(moved.filter("x <> y").distinct())
        discard(left)
        left = fewer
        label = cut(label.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    discard(left)
    return label


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))


def _signed(batches):
    for b in batches:
        for lo in range(0, len(b), 1000):
            rows, part = [], b.iloc[lo : lo + 1000]
            for doc, th, text in zip(part["doc_id"], part["__th"], part["text"]):
                s = shingles(text)
                own = blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                rows.append((doc, th, own, signature(s).astype("<u4").tobytes() if len(s) else None, len(text or "")))
            out = pd.DataFrame(rows, columns=["doc_id", "th", "copy", "sig", "chars"])
            yield out.astype({"doc_id": "Int64"})


def _signatures(side: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(side["sig"]), "<u4").reshape(len(side), VALUES)


def _compared(g: pd.DataFrame) -> pd.DataFrame:
    """Of a pair of blocks: counts of links of each member, and a spanning forest of them."""
    g = g.drop_duplicates("copy").sort_values("copy")
    lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
    left, right = g[g["block"] == lo], g[g["block"] == hi]
    i, j = links_between(left["text"].tolist(), right["text"].tolist(), _signatures(left), _signatures(right), lo == hi) if len(left) and len(right) else (np.zeros(0, int), np.zeros(0, int))
    names = [*left["copy"], *right["copy"]] if lo != hi else [*left["copy"]]
    weight = np.array([*left["n"], *right["n"]] if lo != hi else [*left["n"]])
    j = j + (len(left) if lo != hi else 0)
    texts, docs = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for p, q in ((i, j), (j, i)):
        np.add.at(texts, p, 1)
        np.add.at(docs, p, weight[q])
    root = list(range(len(names)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, q in zip(i, j):
        p, q = top(p), top(q)
        root[max(p, q)] = min(p, q)
    out = [(names[x], names[top(x)], int(texts[x]), int(docs[x])) for x in range(len(names)) if texts[x]]
    return pd.DataFrame(out, columns=["copy", "root", "n_texts", "n_docs"])


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, named): the rows as doc_id, th, copy; of each copy its root, n, n_docs and n_texts (links to
    documents and texts of other sets), and ``stays``, the (doc_id, th) that stands for the root's class."""
    docs = _keyed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = written(docs.mapInPandas(_signed, "doc_id long, th long, copy binary, sig binary, chars long"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    copies = base.filter("copy is not null").groupBy("copy").agg(F.count("*").alias("n"), F.min(who).alias("who"), F.first("sig").alias("sig"), F.first("chars").alias("chars"))
    copies = written(copies)
    bands = copies.select("copy", "sig", F.explode_outer(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    buckets = written(bands.select("copy", F.xxhash64("band", F.substring("sig", F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket")))
    least = buckets.groupBy("bucket").agg(F.min("copy").alias("first"), F.count("*").alias("n")).filter("n > 1").select("bucket", "first")
    # At most BANDS ties a copy: it goes to the least of them, and that one is tied to the others.
    tied = written(buckets.join(least, "bucket").groupBy("copy").agg(F.min("first").alias("head"), F.collect_set("first").alias("firsts")))
    discard(buckets)
    heads = components(tied.select("head", F.explode("firsts").alias("first")), "head", "first")
    clusters = tied.select("copy", "head").join(heads.select(F.col("node").alias("head"), F.col("root").alias("cluster")), "head")
    members = written(clusters.join(copies, "copy").select("copy", "n", "who", "sig", "chars", "cluster"))

    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_BYTES)).cast("int")
    large = members.groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1")
    # Many rows may have one cluster: they meet as many copies of its row.
    salted = large.select("cluster", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("copy"), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "salt"], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("copy", F.lit(1)), "blocks").cast("int"))
    dealt = dealt.select("copy", "n", "sig", "cluster", "block", "blocks", F.col("who.doc_id").alias("__d"), F.col("who.th").alias("__t"))
    texts = docs.join(dealt, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")))
    pairs = texts.select("copy", "n", "sig", "text", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("copy", "n", "sig", "text", "cluster", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = written(pairs.groupBy("cluster", "lo", "hi").applyInPandas(_compared, "copy binary, root binary, n_texts long, n_docs long"))
    discard(members, tied)
    release(documents.sparkSession)

    counts = found.groupBy("copy").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    named = copies.select("copy", "n", "who").join(counts, "copy", "left").join(components(found, "copy", "root"), F.col("copy") == F.col("node"), "left").withColumn("root", F.coalesce("root", "copy"))
    stays = named.groupBy("root").agg(F.min("who").alias("stays"))
    zero = F.lit(0).cast("long")
    named = written(named.join(stays, "root").select("copy", "n", F.coalesce("n_texts", zero).alias("n_texts"), F.coalesce("n_docs", zero).alias("n_docs"), "stays"))
    discard(copies, found)
    return base.select("doc_id", "th", "copy"), named


def join(documents: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (least doc_id that its links lead to), n_links (other
    documents with similarity THRESHOLD or more, copies included), n_texts (those of another set)."""
    base, named = _classes(documents)
    zero = F.lit(0).cast("long")
    links = named.select("copy", F.col("stays.doc_id").alias("class_id"), (F.col("n") - 1 + F.col("n_docs")).alias("n_links"), "n_texts")
    return base.join(links, "copy", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each class: that of the least doc_id (null last), then the least hash of its text; of
    rows that repeat both, the one whose other columns have the least hash. Rows without words stay."""
    base, named = _classes(documents)
    rows = base.join(named, "copy")
    here = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("th") == F.col("stays.th"))
    marks = rows.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.count("*").alias("__n"), F.max(here).alias("__stays"))
    marks = written(marks.filter("__n > 1 or not __stays"))
    keyed, same = _keyed(documents), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t"))
    out = keyed.join(marks.select("__d", "__t"), same, "left_anti").select(*documents.columns)
    again = marks.filter("__stays")
    if again.isEmpty():
        return out
    others = [c for c in documents.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("__d", "__t").orderBy(F.xxhash64(*others) if others else F.lit(0))
    repeats = keyed.join(again, same).withColumn("__k", F.row_number().over(order)).filter("__k = 1")
    return out.unionByName(repeats.select(*documents.columns))
