"""Brute-force versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(AZ))


def op1(docs, bench):
    """docs, bench: (id, text) rows."""
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    lengths = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= x
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def op8_laws(rows, shards):
    """Asserts the law of contiguous shards: rows of (doc_id, size, crc, shard, slot)."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    for s, x in by.items():
        assert 0 <= s < shards and sorted(r[4] for r in x) == list(range(len(x)))
    order = [r for s in sorted(by) for r in sorted(by[s], key=lambda r: r[4])]
    assert [r[0] for r in order] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    total, most = sum(r[1] for r in rows), max((r[1] for r in rows), default=0)
    for s in by:
        assert abs(sum(r[1] for r in by[s]) - total / shards) <= most


def crc(t):
    return zlib.crc32((t or "").encode())
