"""Steps whose work must follow the input: the same results as plainer forms, without the plans that grew faster."""

import random

from pyspark.sql import functions as F

from quillspan.functions import text as T, veto as V
from quillspan.operators import contrast, corpus as C, retrieval as R
from quillspan.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(spark, n, seed=3):
    r = random.Random(seed)
    words = ["aa", "ab", "ba", "abc", "bca", "12", "1.5", "কখ", "zz", "aab"]
    return spark.createDataFrame([(f"d{i:03}", [r.choice(words) for _ in range(r.randint(0, 7))]) for i in range(n)] + [("none", None)], "doc_id string, tokens array<string>")


def test_best_documents_as_by_all_scores(spark, tmp_path):
    docs, asked = drawn(spark, 300), drawn(spark, 12, 5)
    held = R.Index.build(docs.repartition(5), str(tmp_path / "i"))
    points = ((0.9, 0.3), (1.2, 0.75))
    rows = lambda df: sorted((r.k1, r.b, r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = R.top_k(held.bm25(asked, points).withColumn("score", F.round("score", 9)), 4, ["k1", "b", "qid"])
    assert rows(held.top_bm25(asked, 4, points)) == rows(want)  # many ties
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(held.top_cosine(asked, 4)) == rows(R.top_k(held.cosine(asked).withColumn("score", F.round("score", 9)), 4))


def test_grams_of_words_as_an_index_of_grams(spark, tmp_path):
    grams = F.flatten(F.transform("tokens", lambda t: F.flatten(F.array(*[T._substrings(F.concat(F.lit("<"), t, F.lit(">")), n) for n in (3, 4, 5)]))))
    docs, asked = drawn(spark, 200), drawn(spark, 9, 5).withColumn("tokens", grams)
    words, chars = R.Index.build(docs.repartition(3), str(tmp_path / "w")), R.Index.build(docs.withColumn("tokens", grams), str(tmp_path / "c"))
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows(words.top_cosine(asked, 5, (3, 5))) == rows(R.top_k(chars.cosine(asked).withColumn("score", F.round("score", 9)), 5))


def test_no_pair_of_query_and_document_is_shuffled(spark, tmp_path):
    held, asked = R.Index.build(drawn(spark, 300).repartition(2), str(tmp_path / "i")), drawn(spark, 12, 5)
    for df in (held.top_bm25(asked, 4), held.top_cosine(asked, 4), held.top_cosine(asked, 4, (3, 5))):
        assert "MapInArrow" in plan(df)


def test_bm25_tuning_has_all_points(spark):
    assert {(r.k1, r.b) for r in catalog.QUERIES["bm25_tuning"](spark, SF).collect()} == {(k, b) for k in (0.9, 1.2, 1.5, 2.0) for b in (0.3, 0.5, 0.75, 0.9)}


def test_normal_forms_of_odd_texts(spark):
    rows = [("a  ,b", "a,b"), (" 1 ,5​0 ", "1,50"), ("x\t\n\n\n\n y", "x \n\n y"), ("( কো ০)", "(কো 0)"), ("é ", "é"), ("“q” …", '"q" ...'), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", T.normalize("t").alias("got"), T.normalize_for_match("t").alias("m"))
    assert all(r.got == r.want for r in got.collect())
    assert [r.m for r in got.collect()] == ["a b", "1 50", "x y", "কো 0", "", "q", "", None]


def test_normal_text_passes_few_replacements(spark):
    # A pass that few texts need is taken only by these.
    assert "CASE WHEN" in plan(spark.createDataFrame([("a",)], "t string").select(T.normalize("t")))


def near_texts(spark):
    r = random.Random(11)
    rows = []
    for k in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(60)]
        for c in range(4):
            words = list(base)
            for _ in range(c // 2 * r.randint(0, 2)):
                words[r.randint(0, 59)] = f"x{r.randint(0, 9)}"
            rows.append(" ".join(words + ["all rights of this text are reserved by those who wrote it"]))
    rows += ["", "", "one", "one two", "one, two!", None, "one two three"]
    order = list(range(len(rows)))
    r.shuffle(order)
    return spark.createDataFrame([(order[i], t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)


def test_near_pairs_and_survivors_by_brute_force(spark):
    docs = near_texts(spark)
    sets = {}
    for r in docs.filter("text is not null").select("doc_id", F.split(T.normalize_for_match("text"), " ").alias("w")).collect():
        sets[r.doc_id] = {tuple(r.w[i : i + 3]) for i in range(max(1, len(r.w) - 2))}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: v for k, v in want.items() if v >= 0.85}
    assert {(r.a, r.b): r.jaccard for r in C.near_pairs(docs).collect()} == want and any(v < 1 for v in want.values())
    alive = []
    for d in sorted(r.doc_id for r in docs.select("doc_id").collect()):
        if not any((x, d) in want for x in alive):
            alive.append(d)
    assert sorted(r.doc_id for r in C.near_dedup(docs).collect()) == alive


def test_signatures_need_no_spelt_shingles(spark):
    df = near_texts(spark).select("doc_id", C.minhash("text").alias("m"))
    assert "ArrowEvalPython" in plan(df)
    got = {r.doc_id: r.m for r in df.collect()}
    texts = {r.doc_id: r.text for r in near_texts(spark).collect()}
    assert all((got[d] is None) == (t is None) for d, t in texts.items()) and all(len(m) == 64 for m in got.values() if m)
    one, two = ([d for d, t in texts.items() if t == x][0] for x in ("one two", "one, two!"))
    assert got[one] == got[two]
    # Shares of equal values estimate the likeness of sets.
    for r in C.near_pairs(near_texts(spark)).collect():
        assert abs(sum(x == y for x, y in zip(got[r.a], got[r.b])) / 64 - r.jaccard) < 0.25


def test_numbers_do_not_tokenise_a_text_again(spark):
    df = spark.createDataFrame([("in 1999 and 12",)], "t string")
    assert plan(df.select(V.years(T.tokenize("t")).alias("y"))).split("Project", 1)[1].count("regexp_extract_all") == 1
    assert [r.value for r in contrast.pool(df, "date", "t").collect()] == ["1999"] and [r.value for r in contrast.pool(df, "numeral", "t").collect()] == ["12"]


def test_sparse_frequencies_as_by_all_counts(spark):
    rows = [(1, "উদ্ভিদের উদ্ভিদ এবং tree the 12"), (2, "উদ্ভিদ tree tree পাতার"), (3, "পাতা পাতা না"), (4, None), (5, "")]
    d = spark.createDataFrame(rows, "doc_id int, t string").select("doc_id", F.split("t", " ").alias("tokens"))
    want = R.sparse_counts(d, R.corpus_vocabulary(d)).groupBy("term").agg(F.count("*").alias("df"))
    got = R.sparse_df(d)
    assert sorted((r.term, r.df) for r in got.collect()) == sorted((r.term, r.df) for r in want.collect())


def test_candidates_are_told_apart_in_their_row(spark):
    from quillspan.operators import reader

    rows = [("q", "p", 1, 0.9, "Où est le Café Bleu, près de l'Élan? Le café bleu ferme à 18 h. The ক খ 12 km.", "où est le café bleu", "REASON")]
    h = spark.createDataFrame(rows, "qid string, pid string, passage_rank int, passage_score double, text string, question string, kind string")
    found = reader.candidates(reader.top_sentences(h))
    assert "MapInArrow" in plan(found)
    got = found.collect()
    assert len({r.text.lower() for r in got}) == len(got) > 5 and all(rows[0][4][r.start : r.end] == r.text for r in got)
    assert all(r.tokens >= 3 for r in got)
