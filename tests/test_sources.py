"""Scans, sinks and bookkeeping, on files of their own."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.sources import tables as S


def test_refusal_of_another_digest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert S.refused_unless(spark, str(tmp_path / "a.bin"), good).first().digest == good
    with pytest.raises(Exception, match="sha256 mismatch"):
        S.refused_unless(spark, str(tmp_path / "a.bin"), "0" * 64).collect()


def test_zipped_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("class 6/one.jsonl", '{"class": "6", "text": "a"}\n\n{"class": \nnot json\n')
        z.writestr("class 7/two.jsonl", '{"class": "9-10", "text": "b"}')
        z.writestr("readme.txt", "no")
    rows = S.zipped_lines(spark, str(tmp_path / "x.zip"), "class string, text string")
    got = [(r.member, r.row.text if not r.bad else "", r.bad) for r in rows.collect()]
    assert sorted(got) == [("class 6/one.jsonl", "", True), ("class 6/one.jsonl", "", True), ("class 6/one.jsonl", "a", False), ("class 7/two.jsonl", "b", False)]
    grades = rows.select(S.folder_grade("member", {"class 6": 6, "class 7": 7}).alias("g")).distinct().collect()
    assert {r.g for r in grades} == {6, 7}


def test_tables_and_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\"b, ক"), (2, None)], "k long, text string")
    S.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(map(tuple, S.json_lines(spark, str(tmp_path / "j"), "k long, text string").select("k", "text").collect())) == [(1, "a\"b, ক"), (2, None)]
    h = T.config_hash({"b": 1, "a": "ক"})
    assert h == hashlib.sha256(json.dumps({"a": "ক", "b": 1}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
    S.write_table(df, str(tmp_path / "c"), h, 7)
    assert {r.config_hash for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {h}
    (tmp_path / "q.csv").write_text('id,text\n1,"one, two"\n2,three\n')
    assert [r.text for r in S.csv_column(spark, str(tmp_path / "q.csv"), "text").collect()] == ["one, two", "three"]
    (tmp_path / "l.tsv").write_text("# note\na\tb\t1\n")
    assert [tuple(r) for r in S.tsv(spark, str(tmp_path / "l.tsv"), "a string, b string, ok string").collect()] == [("a", "b", "1")]


def test_nested_questions(spark, tmp_path):
    qa = lambda i: {"question_id": i, "question_text": "q?", "is_answerable": "True", "question_type": "factoid", "answers": {"answer_text": ["x"], "answer_type": ["single span"]}}
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"passage_id": "p", "context": "c", "title": "t", "qas": [qa("a"), qa("b")]}, {"passage_id": "r", "context": "d", "title": "u", "qas": [qa("a")]}]}))
    got = S.nested_qa(spark, str(tmp_path / "s.json")).collect()
    assert sorted(r.qid for r in got) == ["a", "a#2", "b"] and all(r.is_answerable for r in got)


def test_suffix_tiers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# about\n[case]\nের # of\nকে\n\n[plural]\nরা\n")
    got = S.suffix_tiers(spark, str(tmp_path / "s.txt")).orderBy("line").collect()
    assert [(r.tier, r.suffix) for r in got] == [("case", "ের"), ("case", "কে"), ("plural", "রা")]


def test_index_scan(spark):
    manifest = spark.createDataFrame([(2, "b", 1), (2, "a", 2), (1, "b", 1)], "size int, pid string, pos int")
    passages = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "pid string, text string")
    assert [r.pid for r in S.index_scan(manifest, passages, 2).collect()] == ["b", "a"]


def test_model_of_other_features_is_refused(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(spark.createDataFrame([(1.0, 2.0)], "a double, b double"))
    S.save_model(model, str(tmp_path / "m"), ["a", "b"])
    assert S.load_model(spark, str(tmp_path / "m"), ["a", "b"]).transform(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).count() == 1
    with pytest.raises(ValueError, match="fitted on"):
        S.load_model(spark, str(tmp_path / "m"), ["b", "a"])


def test_result_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    S.log_result(spark, path, "s", "k1", {"v": 1}, "old", 7)
    S.log_result(spark, path, "s", "k2", {"v": 1}, "old", 7)
    S.log_result(spark, path, "s", "k1", {"v": 2}, "new", 7)
    ledger = spark.read.parquet(path)
    assert [tuple(r) for r in S.stale_results(ledger, "new").collect()] == [("s", "k2")]
    assert [(r.key, json.loads(r.payload)) for r in S.pruned_results(ledger, "new").collect()] == [("k1", {"v": 2})]


def test_receipts_with_all_checks(spark, tmp_path):
    from quillspan.operators import spans as P

    passages = spark.createDataFrame([("p", "the cat sat on a mat"), ("q", "short")], "pid string, text string")
    issued = P.receipts(passages, spark.createDataFrame([("p", 4, 7), ("q", 0, 5)], "pid string, start int, end int")).withColumns({"qid": F.lit("a#2"), "evidence_sentence": F.when(F.col("pid") == "p", F.lit("the cat sat")).otherwise("elsewhere"), "config_hash": F.lit("h")})
    S.write_receipts(issued, str(tmp_path / "r"))
    held = spark.read.json(str(tmp_path / "r"))
    assert {r.name for r in held.collect()} == {"a_dup2"}
    got = {r.pid: r for r in P.check_receipts(held, passages, "other").collect()}
    assert got["p"].ok and not got["p"].same_config and not got["q"].in_evidence and not got["q"].ok
    gone = P.check_receipts(held, passages.withColumn("text", F.left("text", F.lit(3)))).collect()
    assert all(r.found and not r.in_range and not r.ok for r in gone)
