"""Queries over the text kernel."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from . import sqltext as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, md5({S.norm('text')}) AS digest, CAST(length({S.norm('text')}) AS BIGINT) AS n FROM documents")
def normalize_documents(spark, sf):
    t = T.normalize("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query(f"SELECT doc_id, sha1({S.match('text')}) AS digest FROM documents")
def match_form(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(T.normalize_for_match("text")).alias("digest"))


@query("SELECT * FROM (VALUES ('a', 1.0), ('b', 0.0), ('c', 0.5), ('d', 0.0)) v(k, ratio)")
def script_ratio(spark, sf):
    rows = spark.createDataFrame([("a", "উদ্ভিদ"), ("b", "abc"), ("c", "ab কখ"), ("d", "")], "k string, t string")
    return rows.select("k", T.bengali_ratio("t").alias("ratio"))


@query(f"SELECT doc_id, CAST(len({S.tokens('text')}) AS BIGINT) AS n, md5(array_to_string({S.tokens_lower('text')}, ' ')) AS digest FROM documents")
def tokenize_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokenize("text")).cast("long").alias("n"), F.md5(F.concat_ws(" ", T.tokenize_lower("text"))).alias("digest"))


@query(f"""WITH n AS (SELECT item_id, {S.norm('text')} AS t FROM benchmark),
k AS (SELECT item_id, t, regexp_extract_all(t, '{S.TOKEN}') AS w, regexp_split_to_array(t, '{S.TOKEN}') AS g FROM n),
e AS (SELECT item_id, w, g, unnest(range(1, len(w) + 1)) AS i FROM k)
SELECT item_id, CAST(i - 1 AS INT) AS pos, w[i] AS token,
 CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS INT) AS start_,
 CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))) AS INT) AS end_ FROM e""")
def token_spans_benchmark(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", T.normalize("text").alias("t"))
    rows = rows.select("item_id", F.posexplode_outer(T.token_spans("t")).alias("pos", "s")).filter("s is not null")
    return rows.select("item_id", "pos", F.col("s.token").alias("token"), F.col("s.start").alias("start_"), F.col("s.end").alias("end_"))


@query(f"""WITH t AS (SELECT item_id, '<' || unnest({S.tokens_lower('text')}) || '>' AS w FROM benchmark),
g AS (SELECT item_id, substr(w, i, n) AS g FROM t, (VALUES (3), (4), (5)) v(n), LATERAL (SELECT unnest(range(1, CAST(length(w) - n + 2 AS BIGINT))) AS i) r)
SELECT g AS gram, count(*) AS n FROM g GROUP BY g""")
def char_ngram_counts(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode_outer(T.char_ngrams("text")).alias("gram")).filter("gram is not null").groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT doc_id, trim(unnest(string_split_regex(regexp_replace({S.norm('text')}, '([।?!])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'))) AS s FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM s WHERE length(s) >= 2 GROUP BY doc_id""")
def sentence_counts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode_outer(T.sentences("text")).alias("s")).filter("s is not null")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("chars"))


_TRI = "list_distinct(list_transform(range(1, CAST(length({0}) - 1 AS BIGINT)), lambda i: substr({0}, i, 3)))"


@query(f"""WITH t AS (SELECT item_id, ' ' || lower({S.norm('text')}) || ' ' AS t FROM benchmark), s AS (SELECT item_id, {_TRI.format('t')} AS g FROM t)
SELECT a.item_id, round(len(list_intersect(a.g, b.g)) / sqrt(CAST(len(a.g) AS DOUBLE) * len(b.g)), 6) AS cosine FROM s a JOIN s b ON b.item_id = a.item_id + 1""")
def trigram_cosine_neighbours(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(T.trigram_cosine("text", "other"), 6).alias("cosine"))


@query(f"WITH m AS (SELECT doc_id, {S.match('text')} AS m FROM documents) SELECT doc_id, CAST(len({S.shingles('m')}) AS BIGINT) AS n FROM m")
def word_shingle_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.word_shingles("text")).cast("long").alias("n"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def text_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("SELECT * FROM (VALUES ('9', 9, 9, '9'), ('9-10', 9, 10, '9-10'), ('৬–৮', 6, 8, '6-8'), ('class 7', 7, 7, '7'), ('none', NULL, NULL, NULL)) v(raw, low, high, label)")
def parse_grades(spark, sf):
    rows = spark.createDataFrame([("9",), ("9-10",), ("৬–৮",), ("class 7",), ("none",)], "raw string")
    return rows.select("raw", T.parse_grade("raw").alias("g")).select("raw", "g.low", "g.high", "g.label")


@query(f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({S.norm('text')}, '[0-9]+(?:[.,][0-9]+)*')) AS x FROM documents) SELECT doc_id, count(*) AS n, min(x) AS least FROM t GROUP BY doc_id")
def numbers_in_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode_outer(T.numbers("text")).alias("x")).filter("x is not null")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("x").alias("least"))


@query("SELECT * FROM (VALUES ('2026 সালে', '২০২৬ সালে')) v(plain, bengali)")
def bengali_digits(spark, sf):
    rows = spark.createDataFrame([("২০২৬ সালে",)], "t string").select(T.normalize("t").alias("plain"))
    return rows.select("plain", T.to_bengali_digits("plain").alias("bengali"))
