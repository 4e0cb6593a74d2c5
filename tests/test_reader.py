"""The reader's operators on passages with known answers."""

import math

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import metrics as M, reader as R

PASSAGE = "The river Elm rises in the hills. It is 120 km long, and it ends in a lake. Boats sail on it, because the water is deep. The Elm is old."


def hits(spark, kind="THING"):
    rows = [("q", "p", 1, 0.9, PASSAGE, "How long is the river Elm?", kind), ("q", "r", 2, 0.5, "Nothing of the kind. Just a few words here.", "How long is the river Elm?", kind)]
    return spark.createDataFrame(rows, "qid string, pid string, passage_rank int, passage_score double, text string, question string, kind string")


def test_candidates_are_slices(spark):
    h = hits(spark, "REASON")
    top = R.top_sentences(h)
    assert top.groupBy("pid").count().agg(F.max("count")).first()[0] <= 3
    for r in top.collect():
        text = PASSAGE if r.pid == "p" else "Nothing of the kind. Just a few words here."
        assert text[r.s_start : r.s_end] == r.sentence
    found = R.candidates(top).collect()
    texts = [(r.pid, r.text.lower()) for r in found]
    assert len(set(texts)) == len(texts) and all((PASSAGE if r.pid == "p" else "Nothing of the kind. Just a few words here.")[r.start : r.end] == r.text for r in found)
    assert any(len(r.text.split()) > 12 or r.text.endswith(".") for r in found)  # whole clauses
    assert all(len(r.text.split()) >= 3 for r in found)
    number = [r.text for r in R.candidates(R.top_sentences(hits(spark, "NUMBER"))).collect()]
    assert "120 km" in number and "120" in number and "km" in number and "river" not in number


def test_features_and_gold(spark):
    top = R.top_sentences(hits(spark, "NUMBER"))
    found = R.features(R.candidates(top), top)
    assert set(R.FEATURES) <= set(found.columns) and len(R.FEATURES) == 31
    r = found.filter("text = '120 km'").first()
    assert (r.span_tokens, r.is_numeral, r.has_digit, r.is_unit_bearing, r.class_match, r.class_is_number) == (2, 0, 1, 1, 1, 1)
    assert abs(r.type_prior_len - math.exp(-0.5 / 1.5)) < 1e-9 and r.passage_rank_inv == 0.5
    gold = spark.createDataFrame([("q", "p", r.start, r.end)], "qid string, pid string, start int, end int")
    marked = R.gold_rows(found, gold)
    assert marked.filter("is_gold").count() == 1
    assert R.sampled_negatives(marked, 3).groupBy("is_gold").count().collect().__len__() == 2


def test_min_distance(spark):
    rows = [(["a", "b", "c", "d"], ["d"], ["a"], 1 / 4), (["a", "b"], ["b"], [], 0.0), (["a", "b"], ["z"], ["a"], 0.0), (["a", "b", "a"], ["b"], ["a"], 0.5), (["a"], [], ["a"], 0.0)]
    df = spark.createDataFrame(rows, "s array<string>, p array<string>, m array<string>, want double")
    assert all(abs(r.got - r.want) < 1e-12 for r in df.select("want", R.min_distance(F.col("s"), F.col("p"), F.col("m")).alias("got")).collect())


def test_clauses_and_truncation(spark):
    df = spark.createDataFrame([("one thing here, another thing there; x",), ("short",)], "t string")
    got = [r.c for r in df.select(T.clauses("t").alias("c")).collect()]
    assert got == [["one thing here, another thing there; x", "one thing here,", "another thing there;"], ["short"]]
    assert [tuple(r.v) for r in df.select(T.truncated("t", 5).alias("v")).collect()] == [("one t", True), ("short", False)]


def test_soft_f1_is_gated(spark):
    classes = F.create_map(F.lit("quick"), F.lit("fast"), F.lit("fast"), F.lit("fast"))
    df = spark.createDataFrame([(["a", "quick"], ["a", "fast"], False, 1.0), (["a", "quick"], ["a", "fast"], True, 0.5)], "p array<string>, g array<string>, v boolean, want double")
    assert all(r.got == r.want for r in df.select("want", M.soft_f1(F.col("p"), F.col("g"), F.col("v"), classes).alias("got")).collect())


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 4 == 0).cast("double").alias("v"))
    r = M.bootstrap_interval(df, "v", "id", resamples=300).first()
    assert r.mean == 0.25 and 0.19 < r.low < 0.25 < r.high < 0.31
