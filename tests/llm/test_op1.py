from tests.llm import brute
from quillspan.llm import decontaminate as D, queries as Q

DOC = "doc_id long, text string, item_id string, n string"


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, __import__("hashlib").sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in df.collect())


def fixture():
    w = [f"wörd{i % 7}" if i % 3 else f"X{i}" for i in range(60)]
    bench = [(1, " ".join(w[:25])), (2, "Short ITEM here"), (2, "Short ITEM here"), (3, None), (4, ""), (5, "..."), (10, " ".join(w[8:19])), (None, "lone null item"), (6, "a a a a a a a a a a a a a"), (7, "É été")]
    docs = [
        (1, " ".join(w)), (2, "so, short item HERE; again short item here!"), (3, None), (4, ""), (5, "?!"), (6, " ".join(w[5:16]) + " zz " + " ".join(w[:9])),
        (7, "a " * 30), (8, "lone null item"), (8, "lone null item"), (9, "é été É été"), (10, "clean text of nothing"), (11, ("fill er " * 9000) + " ".join(w[3:20])), (None, " ".join(w[:12]).upper()),
    ]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = fixture()
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id int")
    want = sorted(brute.op1(docs, bench), key=lambda r: (r[0] is not None, r))
    for limit in (10**6, 0):  # broadcast, then by shuffles
        have = D.contamination(d, b, broadcast_windows=limit)
        rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, __import__("hashlib").sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in have.collect()]
        assert sorted(rows, key=lambda r: (r[0] is not None, r)) == want


def test_empty_tables(spark):
    docs, bench = fixture()
    d = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in D.contamination(d, b).collect())
    assert D.contamination(d.limit(0), b).count() == 0
    assert D.without_contaminated(d, b).count() == len(docs)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r) for r in Q.op1_decontamination(spark, sf).collect()) == sorted(brute.op1(docs, bench))


def test_rows_told_by_id_and_text(spark):
    bad, clean = "one two three four five six seven eight nine ten", "nothing of the kind here"
    rows = [(None, bad), (None, clean), (3, bad), (3, clean), (4, clean), (4, clean), (5, None), (None, None), (6, "x " + bad)]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, th int, start string")
    got = D.without_contaminated(d, spark.createDataFrame([(1, bad)], "item_id long, text string"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted((r for r in rows if not r[1] or bad not in r[1]), key=key)
