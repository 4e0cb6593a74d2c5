"""Each stage of the pipeline on its own input, against brute force."""

import corpus_pipeline as P
from quillspan.llm import packing, quality
from quillspan.llm.store import table, written
from tests.llm import brute
from tests.llm.test_op_small import similar

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for _, stage in P.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns
        seen.append((before, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    (a, b), (_, c), (_, d), (_, e) = seen
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    want = {r.doc_id for r in quality.scored(table(spark, SF, "documents"), model).collect() if r.score >= quality.THRESHOLD}
    assert {i for i, _ in b} == want and set(b) <= set(a)
    own = dict(b)
    for i, t in c:
        lines = iter(own[i].split("\n"))
        assert i in own and (t == "" or all(any(x == y for y in lines) for x in t.split("\n")))
    assert {i for i, _ in c} == set(own)
    assert sorted(i for i, _ in d) == sorted({k for _, k, _ in similar(c)})
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(i for i, _ in e) == sorted(r[0] for r in brute.op1(d, bench) if not r[5])
    ids = packing.ids_of(P.tokenizer_path())
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(ids([t or ""])[0]) for i, t in e}
