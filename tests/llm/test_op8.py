from tests.llm import brute
from quillspan.llm import queries as Q, sharding


def test_fixture(spark):
    docs = [(None, "x"), (5, None), (5, None), (1, ""), (2, "é" * 50), *((7, "same") for _ in range(40)), *((100 + i, "t" * (i % 9)) for i in range(200))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, size int").repartition(5)
    rows = [tuple(r) for r in sharding.shard_by_bytes(d, 16).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted((r[:3] for r in rows), key=key) == sorted(((i, len((t or "").encode()) + 1, brute.crc(t)) for i, t in docs), key=key)
    brute.op8_laws(rows, 16)


def test_empty(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0


def test_whole_query(spark):
    rows = [tuple(r) for r in Q.op8_sharding(spark, "/root/testdata/sf0.01").select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert len(rows) == 1000
    brute.op8_laws(rows, 16)
