import hashlib
import random

import numpy as np

from quillspan.llm import suffixes


def brute(rows):
    """rows: (doc_id, bytes), in corpus order."""
    seen, out = set(), []
    for d, x in rows:
        gone = [False] * len(x)
        for i in range(len(x) - 99):
            w = x[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, data int")
    return sorted((tuple(r) for r in suffixes.remove_repeated(d).collect()), key=repr)


def test_pieces_and_groups_of_texts(monkeypatch):
    r = random.Random(2)
    texts = [bytes(r.choices(b"abcd ", k=n)) for n in (5000, 99, 100, 0, 350, 1200)]
    whole = [suffixes.runs([t]) for t in texts]
    for piece, group in ((1 << 20, 1 << 17), (300, 1 << 17), (1 << 20, 50), (300, 50)):
        monkeypatch.setattr(suffixes, "_PIECE", piece)
        monkeypatch.setattr(suffixes, "_GROUP", group)
        i, *got = suffixes.runs(texts)
        for k in range(len(texts)):
            assert all((x[i == k] == y).all() for x, y in zip(got, whole[k][1:]))
    assert sum(whole[0][3]) == 5000 - 99


def test_against_brute_force(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    a, b = text(700), text(160)
    rows = [(None, text(120)), (1, a), (2, None), (3, ""), (4, a), (5, a[:300] + "x" + a[301:]), (6, text(40) + b + text(30)), (7, b), (8, text(33) + b[3:140] + text(200)), (9, "z" * 400), (10, "z" * 99), (11, "ab" * 200), (12, b[:100] + b[:100]), *((20 + k, text(k) + b[10:] + text(9)) for k in range(6))]
    assert got(spark, rows) == brute([(i, (t or "").encode()) for i, t in rows])


def test_empty(spark):
    assert suffixes.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    assert sorted((tuple(r) for r in suffixes.remove_repeated(docs).collect()), key=repr) == brute(rows)


def test_runs_are_few_and_hold_every_window():
    data = np.random.default_rng(4).integers(0, 256, 400_000, np.uint8).tobytes()
    which, _, start, windows, left = suffixes.runs([data])
    assert len(which) * 37 < len(data) and windows.max() < 128 and left.max() < 128
    assert (start[1:] == (start + windows)[:-1]).all() and start[0] == 0 and windows.sum() == len(data) - suffixes.SPAN + 1
    # Each window of a run holds the whole anchor.
    assert (left >= windows - 1).all() and (left + suffixes.GRAM <= suffixes.SPAN).all()
