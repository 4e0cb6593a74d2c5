"""Removal of repeated byte strings by a distributed difference-cover suffix order.

A byte goes if a string of SPAN bytes that covers it also starts earlier in the corpus.

1. Reduction, without loss. The anchor of a window of SPAN bytes is the least hash of its GRAM-byte
   strings (leftmost of equals); windows that follow one another with one anchor are a run. Equal
   windows have equal anchors, so an anchor that occurs once needs no more work, and of runs with the
   same bytes (by BLAKE2, 128 bits) all but the first are removed whole. Where an anchor has runs of
   several texts, each text's first run is open: it is sorted among its anchor's by what stands right
   and left of the anchor, and windows that reach beyond what it shares with a neighbour in either
   order have no equal. What is left of it is a stretch; equal stretches are treated as equal runs are.
2. The suffixes of the stretches that are still open are ordered as far as SPAN bytes with the
   difference cover {1, 2} mod 3. Triples of characters (eight bytes each) of the sampled suffixes are
   sorted and named by rank; names are again tripled, sorted and named, when they stand for 72 bytes;
   any two suffixes are then ordered by at most two bytes, two such names and at most two bytes.
3. Neighbours in that order are compared, over the ends of partitions too: a suffix whose predecessor
   has the same prefix of SPAN bytes starts a removed window. Ties stand in corpus order.

A suffix order of every byte would shuffle each many times; the reduction leaves the method the ends
of repeated passages, where the text decides byte by byte.

No group is collected: counts and minima are combined before a shuffle, orders are range sorts whose
ties are split, and the two sides of each join on an anchor or name can be split where they are skewed.
Long texts are cut into pieces for the anchors.

Cases: a null or short text loses nothing; earlier means (doc_id, null first; then the text's hash;
then start); rows that repeat both doc_id and text are one document and get the same result; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import discard, release, written

#: A shorter GRAM gives longer and so fewer runs; it changes no result.
SPAN, GRAM = 100, 24
WINDOW = SPAN - GRAM + 1
#: Bytes of two rounds of triples, and where the second name of a suffix starts (multiples of 3 apart).
CHAR, STEP = 8, 24
NAMED = 3 * STEP
_PIECE, _GROUP = 1 << 20, 1 << 17
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PLACE = np.uint64((1 << 22) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _longs(b: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on as one number."""
    n = len(b) - 7
    out = np.empty(max(n, 0), np.uint64)
    raw = b.tobytes()
    for k in range(min(8, max(n, 0))):
        out[k::8] = np.frombuffer(raw, f"{order}u8", (n - k + 7) // 8, k)
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of size numbers, for each pair in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _anchors(b: np.ndarray):
    """(hash of each GRAM-byte string, place of the anchor of each window)."""
    w, n = _longs(b), len(b) - GRAM + 1
    gram = w[:n] * _ODD[0]
    for k in range(1, GRAM // 8):
        gram ^= (w[8 * k : 8 * k + n] ^ (gram >> np.uint64(31))) * _ODD[k]
    gram = _mix(gram)
    low = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        low, span = np.minimum(low[:-step], low[step:]), span + step
    return gram.view(np.int64), (low & _PLACE).astype(np.int64)


def runs(texts: list[bytes]):
    """Arrays (text's number, anchor, start, windows, left) of the runs; left: bytes before the anchor."""
    out, group, size = [], [], 0

    def flush():
        nonlocal group, size
        if group:
            b = np.frombuffer(b"".join(t for _, t in group), np.uint8)
            ends = np.cumsum([len(t) for _, t in group])
            starts = ends - [len(t) for _, t in group]
            gram, anchor = _anchors(b)
            fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            fresh[starts] = True
            first = np.flatnonzero(fresh)
            which = np.searchsorted(ends, first, "right")
            last = np.minimum(np.append(first[1:], len(anchor)), ends[which] - SPAN + 1)
            keep = first < last
            first, last, which = first[keep], last[keep], which[keep]
            at = anchor[first]
            out.append((np.array([i for i, _ in group])[which], gram[at], first - starts[which], last - first, at - first))
        group, size = [], 0

    for i, t in enumerate(texts):
        if len(t) < SPAN:
            continue
        if len(t) > _PIECE:
            at = 0
            while at < len(t) - SPAN + 1:
                gram, anchor = _anchors(np.frombuffer(t[at : at + _PIECE + SPAN - 1], np.uint8))
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                last = np.append(first[1:], len(anchor))
                # A run that the piece's end may cut is taken up again from its start.
                done = at + len(anchor) >= len(t) - SPAN + 1
                end = len(anchor) if done or len(first) < 2 else int(first[-1])
                keep = first < end
                s, e = first[keep], np.minimum(last[keep], end)
                out.append((np.full(len(s), i), gram[anchor[s]], s + at, e - s, anchor[s] - s))
                at += end
            continue
        group.append((i, t))
        size += len(t)
        if size > _GROUP:
            flush()
    flush()
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _pos(start, windows, left):
    return start << 14 | windows << 7 | left


def _parts(pos):
    """(start, windows, left) of what _pos gives."""
    return pos >> 14, pos >> 7 & 127, pos & 127


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _all_runs(batches):
    for b in batches:
        d, th = (b.column(c).to_numpy() for c in ("d", "th"))
        for lo in range(0, b.num_rows, 1024):
            i, anchor, start, windows, left = runs(b.column("data").slice(lo, 1024).to_pylist())
            i = i + lo
            yield _batch(anchor=anchor, d=d[i], th=th[i], pos=_pos(start, windows, left))


def _lists(b: pa.RecordBatch, name: str):
    """(row of each element, struct array of the elements) of a column of arrays of structs."""
    x = b.column(name)
    return np.repeat(np.arange(b.num_rows), x.value_lengths().to_numpy(zero_copy_only=False)), x.flatten()


def _bytes_of(b: pa.RecordBatch):
    """(row, struct array, bytes) of each run that a batch of texts has listed; the bytes one by one."""
    row, x = _lists(b, "runs")
    texts = b.column("data").to_pylist()
    start, windows, _ = _parts(x.field("pos").to_numpy(zero_copy_only=False))
    return row, x, (texts[r][s : s + w + SPAN - 1] for r, s, w in zip(row.tolist(), start.tolist(), windows.tolist()))


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _digests(batches):
    for b in batches:
        row, x, data = _bytes_of(b)
        yield _batch(anchor=x.field("anchor"), digest=pa.array([_digest(t) for t in data], pa.binary()), d=b.column("d").take(pa.array(row)), th=b.column("th").take(pa.array(row)), pos=x.field("pos"))


def _right(batches):
    """Open runs with their bytes, those from the anchor on (right) and those before it, read backwards (left)."""
    for b in batches:
        row, x, data = _bytes_of(b)
        data, split = list(data), (x.field("pos").to_numpy(zero_copy_only=False) & 127).tolist()
        yield _batch(anchor=x.field("anchor"), d=b.column("d").take(pa.array(row)), th=b.column("th").take(pa.array(row)), pos=x.field("pos"), right=pa.array([t[k:] for t, k in zip(data, split)], pa.binary()), left=pa.array([t[:k][::-1] for t, k in zip(data, split)], pa.binary()))


def _shared(anchor: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Of each of some sorted texts, the bytes that it shares at its start with the one before or after
    it of its anchor. The outermost have neighbours that are not seen, and count as sharing all."""
    n = len(texts)
    if n < 2:
        return np.array([len(t) for t in texts], np.int64)
    size = np.array([len(t) for t in texts])
    width = int(size.max()) + 1
    m = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width)
    same = (m[1:] == m[:-1]).argmin(axis=1)
    same = np.where((m[1:] == m[:-1]).all(axis=1), width, same)
    same = np.minimum(np.minimum(same, size[1:]), size[:-1]) * (anchor[1:] == anchor[:-1])
    return np.maximum(np.append(same, size[-1]), np.append(size[0], same))


def _with_reach(name: str, of: str):
    def made(batches):
        for b in batches:
            got = [_shared(b.column("anchor").slice(lo, 4096).to_numpy(), b.column(of).slice(lo, 4096).to_pylist()) for lo in range(0, b.num_rows, 4096)]
            yield b.append_column(name, pa.array(np.concatenate([np.zeros(0, np.int64), *got]), pa.int64()))

    return made


def _stretches(batches):
    """Of each open run the windows whose two ends both lie within what it shares."""
    for batch in _with_reach("reach_left", "left")(batches):
        pos = batch.column("pos").to_numpy()
        start, windows, left = _parts(pos)
        # Window j has left - j bytes before the anchor, and SPAN less that from it on.
        lo = np.maximum(0, left - batch.column("reach_left").to_numpy())
        hi = np.minimum(windows, batch.column("reach_right").to_numpy() + left - SPAN + 1)
        keep = np.flatnonzero(lo < hi)
        rights, lefts = batch.column("right").to_pylist(), batch.column("left").to_pylist()
        data = [(lefts[i][::-1] + rights[i])[lo[i] : hi[i] + SPAN - 1] for i in keep.tolist()]
        take = lambda c: batch.column(c).take(pa.array(keep))
        yield _batch(anchor=take("anchor"), digest=pa.array([_digest(t) for t in data], pa.binary()), d=take("d"), th=take("th"), start=(start + lo)[keep], windows=(hi - lo)[keep], data=pa.array(data, pa.binary()))


def _sampled(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the places from 1 to n - 1 that the difference cover holds, for each n in turn."""
    row, at = np.repeat(np.arange(len(n)), n), _spread(np.zeros(len(n), np.int64), n)
    keep = at % 3 > 0
    return row[keep], at[keep]


def _first_triples(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            texts = part.column("data").to_pylist()
            size = np.array([len(t) for t in texts])
            w = _longs(np.frombuffer(b"".join(texts), np.uint8), ">")
            w = (w ^ np.uint64(1 << 63)).view(np.int64)  # in the order of the bytes
            row, at = _sampled(size - STEP + 1)
            i = (np.cumsum(size) - size)[row] + at
            yield _batch(run=part.column("run").to_numpy()[row], at=at, a=w[i], b=w[i + CHAR], c=w[i + 2 * CHAR])


def _named(df: DataFrame) -> DataFrame:
    """run, at, name: the rank of its triple (a, b, c) among all distinct ones, with gaps."""
    cols = ["a", "b", "c"]
    ranks = written(df.select(*cols).distinct().repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()))
    return df.join(ranks, cols).select("run", "at", "name")


def _by_place(b: pa.RecordBatch):
    """(row's number, names by place) of each row; places that are not sampled hold nothing."""
    if not b.num_rows:
        return
    row, x = _lists(b, "names")
    at, name = (x.field(c).to_numpy(zero_copy_only=False) for c in ("at", "name"))
    cut = np.flatnonzero(np.diff(row)) + 1
    for i, (p, q) in enumerate(zip(np.split(at, cut), np.split(name, cut))):
        out = np.zeros(int(p.max()) + 1, np.int64)
        out[p] = q
        yield i, out


def _second_triples(batches):
    for b in batches:
        run, rows = b.column("run").to_numpy(), []
        for i, name in _by_place(b):
            at = np.arange(len(name) - 2 * STEP)
            at = at[at % 3 > 0]
            rows.append((np.full(len(at), run[i]), at, name[at], name[at + STEP], name[at + 2 * STEP]))
        if rows:
            yield _batch(**dict(zip(("run", "at", "a", "b", "c"), map(np.concatenate, zip(*rows)))))


KEY = ["way", "lead", "m", "n", "tail"]
PLACE = ["d", "th", "at"]


def _merged(batches):
    """The keys by which suffixes of two residues are ordered: where both, shifted alike, are sampled."""
    for b in batches:
        d, th, start, texts = (b.column(c).to_pylist() for c in ("d", "th", "start", "data"))
        rows = []
        for i, name in _by_place(b):
            x = np.frombuffer(texts[i], np.uint8).astype(np.int64)
            every = np.arange(len(x) - SPAN + 1)
            for way, second in enumerate((27, 28, 26)):
                p = every[(every + way) % 3 > 0]
                none = np.zeros(len(p), np.int64)
                lead = (none, x[p], x[p] << 8 | x[p + 1])[way]
                tail = (x[p + SPAN - 1], none, x[p + SPAN - 2] << 8 | x[p + SPAN - 1])[way]
                rows.append((none + way, lead, name[p + way], name[p + second], tail, none + d[i], none + th[i], p + start[i]))
        if rows:
            yield _batch(**dict(zip(KEY + PLACE, map(np.concatenate, zip(*rows)))))


def _neighbours(batches):
    """Of sorted keys: those that equal the one before (edge 0), and the first (1) and the last (2) of all."""
    from pyspark import TaskContext

    part, before, last = TaskContext.get().partitionId(), None, None
    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([b.column(c).to_numpy() for c in KEY])
        later = np.concatenate([[False], (x[:, 1:] == x[:, :-1]).all(axis=0)])
        later[0] = before is not None and bool((x[:, 0] == before).all())
        take = np.flatnonzero(later)
        edge = np.zeros(len(take), np.int64)
        if before is None:
            take, edge = np.append(take, 0), np.append(edge, 1)
        before, last = x[:, -1], b.slice(b.num_rows - 1)
        yield _batch(**{c: b.column(c).take(pa.array(take)) for c in KEY + PLACE}, edge=edge, part=np.full(len(take), part))
    if last is not None:
        yield _batch(**{c: last.column(c) for c in KEY + PLACE}, edge=np.array([2]), part=np.array([part]))


def _later_suffixes(opened: DataFrame) -> DataFrame:
    """d, th, at: the suffixes of the stretches whose first SPAN bytes an earlier one has too. opened: run, d, th, start, data."""
    triple = "run long, at long, a long, b long, c long"
    names = lambda df: df.groupBy("run").agg(F.collect_list(F.struct("at", "name")).alias("names"))
    first = written(names(_named(written(opened.select("run", "data").mapInArrow(_first_triples, triple)))))
    second = _named(written(first.mapInArrow(_second_triples, triple)))
    keys = opened.join(names(second), "run").select("d", "th", "start", "data", "names")
    schema = ", ".join(f"{c} long" for c in KEY + PLACE)
    keys = written(keys.mapInArrow(_merged, schema))
    discard(first)
    release(opened.sparkSession)
    found = keys.repartitionByRange(*KEY, *PLACE).sortWithinPartitions(*KEY, *PLACE).mapInArrow(_neighbours, f"{schema}, edge long, part long")
    found = written(found)
    discard(keys)
    # Two rows a partition: a bounded table, and the only window without a key.
    order = Window.orderBy("part", "edge")
    ends = found.filter("edge > 0").select("*", *[F.lag(c).over(order).alias(f"{c}_") for c in KEY])
    same = F.lit(True)
    for c in KEY:
        same = same & (F.col(c) == F.col(f"{c}_"))
    return found.filter("edge = 0").select(*PLACE).unionByName(ends.filter((F.col("edge") == 1) & same).select(*PLACE))


def _later_copies(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first, later): of rows with one (anchor, digest) the first place, and the rows at others."""
    first = written(rows.groupBy("anchor", "digest").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")))
    again = first.filter("n > 1").select("anchor", "digest", "first")
    later = rows.join(again, ["anchor", "digest"]).filter(F.struct(*place) != F.col("first"))
    return first.select("anchor", "digest", "first.*"), later


def _several(first: DataFrame) -> DataFrame:
    """Of the first ones, those whose anchor has others."""
    return first.join(first.groupBy("anchor").agg(F.count("*").alias("_n")).filter("_n > 1").select("anchor"), "anchor")


def repeated(docs: DataFrame) -> DataFrame:
    """d, th, start, end: spans to remove (they may overlap); docs: as _keyed gives."""
    spark = docs.sparkSession
    texts = docs.select("d", "th", "data").filter(F.length("data") >= SPAN)
    every = written(texts.mapInArrow(_all_runs, "anchor long, d long, th long, pos long"))
    twice = written(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    release(spark)
    # A set: repeated rows of one document name their runs once.
    listed = lambda rows: rows.groupBy("d", "th").agg(F.collect_set(F.struct("anchor", "pos")).alias("runs"))
    marked = written(every.join(twice, "anchor"))
    discard(every, twice)
    release(spark)
    told = written(texts.join(listed(marked), ["d", "th"]).mapInArrow(_digests, "anchor long, digest binary, d long, th long, pos long"))
    discard(marked)
    release(spark)
    first, later = _later_copies(told, ["d", "th", "pos"])
    start, windows = F.shiftright("pos", 14), F.shiftright("pos", 7).bitwiseAND(F.lit(127))
    whole = written(later.select("d", "th", start.alias("start"), (start + windows + SPAN - 1).alias("end")))
    open_runs = written(_several(first).select("anchor", "d", "th", "pos"))
    discard(told)
    release(spark)
    schema = "anchor long, d long, th long, pos long, right binary, left binary"
    sides = written(texts.join(listed(open_runs), ["d", "th"]).mapInArrow(_right, schema).dropDuplicates(["anchor", "d", "th", "pos"]))
    release(spark)
    sides = sides.repartitionByRange("anchor", "right").sortWithinPartitions("anchor", "right").mapInArrow(_with_reach("reach_right", "right"), f"{schema}, reach_right long")
    sides = written(sides.filter(F.col("reach_right") >= GRAM))
    stretches = sides.repartitionByRange("anchor", "left").sortWithinPartitions("anchor", "left").mapInArrow(_stretches, "anchor long, digest binary, d long, th long, start long, windows long, data binary")
    stretches = written(stretches)
    discard(sides)
    release(spark)
    first, later = _later_copies(stretches.drop("data"), ["d", "th", "start"])
    parts = written(later.select("d", "th", "start", (F.col("start") + F.col("windows") + SPAN - 1).alias("end")))
    opened = stretches.join(_several(first).select("anchor", "d", "th", "start"), ["anchor", "d", "th", "start"])
    opened = written(opened.select(F.monotonically_increasing_id().alias("run"), "d", "th", "start", "data"))
    discard(stretches)
    release(spark)
    suffixes = written(_later_suffixes(opened).select("d", "th", F.col("at").alias("start"), (F.col("at") + SPAN).alias("end")))
    discard(opened)
    release(spark)
    return whole.unionByName(parts).unionByName(suffixes)


def _judged(batches):
    for b in batches:
        lists = b.column("spans")
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x, end = lists.flatten(), np.cumsum(n)
        start, stop = (x.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        out = []
        for data, lo, hi in zip(b.column("data").to_pylist(), (end - n).tolist(), end.tolist()):
            if lo == hi:
                out.append((len(data), 0, 0, sha256(data).hexdigest()))
                continue
            edge = np.bincount(start[lo:hi], minlength=len(data) + 1) - np.bincount(stop[lo:hi], minlength=len(data) + 1)
            gone = np.cumsum(edge)[: len(data)] > 0
            begins = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
            out.append((len(data), int(gone.sum()), begins, sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
        n_bytes, n_removed, n_spans, kept = zip(*out) if out else ((), (), (), ())
        yield _batch(doc_id=b.column("doc_id"), n_bytes=pa.array(n_bytes, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), n_spans=pa.array(n_spans, pa.int64()), kept_sha256=pa.array(kept, pa.string()))


def remove_repeated(documents: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = _keyed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated(docs).groupBy("d", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans, ["d", "th"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(_judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
