"""Queries that cover what their forms with SQL leave out."""

from collections import Counter, defaultdict

from quillspan.functions import text as T
from quillspan.plans import catalog
from quillspan.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_answer_f1_of_every_turn(spark):
    said = defaultdict(list)
    for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", T.tokenize_lower("text").alias("w")).collect():
        said[r.conv_id].append((r.turn, r.role, r.w))
    want = {}
    for conv, rows in said.items():
        last = None
        for turn, role, w in sorted(rows):
            if role == "assistant" and last is not None:
                hit = sum((Counter(last) & Counter(w)).values())
                want[conv, turn] = (round(2 * hit / (len(last) + len(w)), 6) if last or w else 1.0, last == w)
            last = w if role == "user" else last
    got = catalog.QUERIES["answer_f1_turns"](spark, SF).collect()
    assert {(r.conv_id, r.turn): (r.f1, r.em) for r in got} == want and len(got) == len(want) and max(t for _, t in want) > 1


def test_bm25_grid_of_16(spark):
    got = {(r.k1, r.b): r for r in catalog.QUERIES["bm25_tuning_grid"](spark, SF).collect()}
    assert set(got) == {(k, b) for k in (0.9, 1.2, 1.5, 2.0) for b in (0.3, 0.5, 0.75, 0.9)}
    assert all(got[r.k1, r.b].hits_5 == r.hits_5 for r in catalog.QUERIES["bm25_tuning"](spark, SF).collect())
    assert got[1.2, 0.75].mrr_10 == round(catalog.QUERIES["bm25_metrics"](spark, SF).first().mrr_10, 6)
    assert [k for k in got if got[k].best] == [min(got, key=lambda k: (-got[k].hits_5, k))]


def test_topic_clusters_of_all_k(spark):
    assert {r.k for r in catalog.QUERIES["topic_clusters"](spark, SF).collect()} == {5, 8, 12, 16, 20}
