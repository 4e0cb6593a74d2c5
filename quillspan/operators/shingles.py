"""Sets of word 3-shingles as hashes, in Arrow batches. A shingle's hash is made of those of its words, so no shingle is
ever spelt out; what comes in is (id, w), w the hashes of a text's words in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from ..functions import text as T

#: Odd factors of a shingle's words and, for texts of fewer words, what is added for their number.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SHORT = np.array([0, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Cells of the table of counts that tells frequent shingles from rare ones.
CELLS = 1 << 19


def word_hashes(text) -> Column:
    """The hashes of the words of the matching form."""
    return F.transform(F.split(T.normalize_for_match(text), " "), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """row, hash of each shingle of a column of words' hashes, each once a row, in order; a text of fewer words is one shingle."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    w, first = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(size) - size
    rows = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(w)) + 2 < (first + size)[rows])
    h, row = w[at] * FACTORS[0] + w[at + 1] * FACTORS[1] + w[at + 2] * FACTORS[2] if len(at) else np.zeros(0, np.uint64), rows[at]
    for n in (1, 2):
        short = np.flatnonzero(size == n)
        h = np.concatenate([h, w[first[short]] * FACTORS[0] + (w[first[short] + 1] * FACTORS[1] if n == 2 else np.uint64(0)) + SHORT[n]])
        row = np.concatenate([row, short])
    h = mixed(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def whole(batches):
    """id, s: the sets."""
    for b in batches:
        row, h = sets(b.column("w"))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["id", "s"])


def tallied(batches):
    """cell, id, n, f, g: of each set its size and 128 bits that tell it, without cell; and of each cell how many shingles fall in it."""
    total, kind = np.zeros(CELLS, np.int64), None
    for b in batches:
        row, h = sets(b.column("w"))
        total += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        n, kind = np.bincount(row, minlength=b.num_rows), b.column("id").type
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        f, g = (np.add.reduceat(mixed(h ^ x), starts).view(np.int64) if len(some) else np.zeros(0, np.int64) for x in SHORT[1:])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int32()), b.column("id").take(pa.array(some)), pa.array(n[some]), pa.array(f), pa.array(g)], names=["cell", "id", "n", "f", "g"])
    used = np.flatnonzero(total)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.nulls(len(used), kind), pa.array(total[used]), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64())], names=["cell", "id", "n", "f", "g"])


def prefix_size(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def prefixes(counts, threshold: float):
    """id, n, h: of each set the first shingles, rare ones first; counts: a broadcast array of the cells' counts."""

    def run(batches):
        for b in batches:
            row, h = sets(b.column("w"))
            order = np.lexsort((h, counts.value[(h & np.uint64(CELLS - 1)).astype(np.int64)], row))
            n = np.bincount(row, minlength=b.num_rows)
            keep = np.arange(len(h)) - (np.cumsum(n) - n)[row] < prefix_size(n, threshold)[row]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[keep])), pa.array(n[row[keep]]), pa.array(h[order][keep].view(np.int64))], names=["id", "n", "h"])

    return run


def minhash(values: int):
    """Of a column of words' hashes the least hash of the sets under each of ``values`` seeds; null without words."""

    @F.arrow_udf("array<long>")
    def run(words: pa.Array) -> pa.Array:
        row, h = sets(words)
        n = np.bincount(row, minlength=len(words))
        some = np.flatnonzero(n)
        out = np.zeros((len(some), values), np.int64)
        for k in range(values if len(some) else 0):
            out[:, k] = np.minimum.reduceat(mixed(h + mixed(np.array([k + 1], np.uint64))[0]).view(np.int64), (np.cumsum(n) - n)[some])
        offsets = np.concatenate([[0], np.cumsum((n > 0) * values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(n == 0))

    return run
