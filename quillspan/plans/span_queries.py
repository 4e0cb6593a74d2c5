"""Queries over spans, receipts, chunks, models and the stream."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M, models as D, spans as P
from ..sources.tables import table
from ..streaming import ingest
from . import sqltext as S
from .corpus_queries import _scored

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH n AS (SELECT item_id, CAST(len({S.tokens('text')}) AS BIGINT) AS n FROM benchmark) SELECT item_id, CAST(sum(greatest(n - k + 1, 0)) AS BIGINT) AS spans, CAST(sum(k * greatest(n - k + 1, 0)) AS BIGINT) AS tokens FROM n, range(1, 13) r(k) GROUP BY item_id""")
def candidate_spans(spark, sf):
    s = table(spark, sf, "benchmark").select("item_id", T.normalize("text").alias("sentence"))
    return P.candidates(s, ["item_id"]).groupBy("item_id").agg(F.count("*").alias("spans"), F.sum("tokens").cast("long").alias("tokens"))


@query(f"WITH t AS (SELECT source AS qid, doc_id, list_distinct({S.tokens_lower('text')}) AS w FROM documents), n AS (SELECT qid, count(*) AS n FROM t GROUP BY 1), d AS (SELECT qid, term, count(*) AS df FROM (SELECT qid, unnest(w) AS term FROM t) GROUP BY ALL) SELECT qid, term, round(ln(1 + (n + 0.5) / (df + 0.5)), 6) AS idf FROM d JOIN n USING (qid)")
def working_set_idf(spark, sf):
    h = table(spark, sf, "documents").select(F.col("source").alias("qid"), "doc_id", T.tokenize_lower("text").alias("tokens"))
    return P.working_idf(h).select("qid", "term", F.round("idf", 6).alias("idf"))


@query("WITH s AS (SELECT lang, doc_id, n_chars / 1000.0 AS score FROM documents), e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY lang)) AS x FROM s), h AS (SELECT *, x / sum(x) OVER (PARTITION BY lang) AS share FROM e), r AS (SELECT *, row_number() OVER w AS rank, share - coalesce(lead(share) OVER w, 0) AS margin FROM h WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id)) SELECT lang, doc_id, CAST(rank AS INT) AS rank, round(share, 6) AS share, round(margin, 6) AS margin FROM r")
def softmax_margins(spark, sf):
    s = table(spark, sf, "documents").select("lang", "doc_id", (F.col("n_chars") / 1000).alias("score"))
    return P.ranked(s, "lang", ["doc_id"]).select("lang", "doc_id", "rank", F.round("share", 6).alias("share"), F.round("margin", 6).alias("margin"))


@query("SELECT * FROM (VALUES (1, 2, 0), (2, 1, 10)) v(k, n_kept, first_start)")
def non_overlapping_spans(spark, sf):
    rows = spark.createDataFrame([(1, [(0.9, 0, 5), (0.8, 3, 9), (0.7, 5, 9)]), (2, [(0.5, 10, 20), (0.4, 12, 13)])], "k int, s array<struct<score:double,start:int,end:int>>")
    return rows.select("k", P.without_overlaps(F.col("s")).alias("s")).select("k", F.size("s").alias("n_kept"), F.col("s")[0]["start"].alias("first_start"))


@query("SELECT k, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM (VALUES (1, 4, 19), (2, NULL, NULL), (3, 10, 26), (4, NULL, NULL)) v(k, s, e)")
def fuzzy_alignment(spark, sf):
    rows = [(1, "the quick brown fox jumps", "quick brovn fox"), (2, "nothing here", "quick brown fox"), (3, "no quick, quick brown foxes", "quick brownfoxes"), (4, "abc", "abd")]
    r = spark.createDataFrame(rows, "k int, p string, a string")
    return r.select("k", P.align_fuzzy("p", "a").alias("r")).select("k", F.col("r.start").alias("s"), F.col("r.end").alias("e"))


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(len(w) - 31, 0) // 120 + 1 AS BIGINT))) AS k FROM w WHERE w[1] <> ''), s AS (SELECT doc_id, k, w[k * 120 + 1 : k * 120 + 150] AS c FROM c)
SELECT doc_id, CAST(k AS BIGINT) AS chunk, CAST(len(c) AS INT) AS n_tokens, md5(array_to_string(c, ' ')) AS digest FROM s""")
def overlapping_chunks(spark, sf):
    return P.chunks(table(spark, sf, "documents")).withColumn("chunk", F.col("chunk").cast("long"))


@query("SELECT item_id AS pid, item_id % 5 > 0 AND item_id % 3 > 0 AS ok, item_id % 5 > 0 AS found FROM benchmark")
def receipt_checks(spark, sf):
    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("pid"), "text")
    issued = P.receipts(p, p.select("pid", F.lit(3).alias("start"), F.lit(15).alias("end")))
    today = P.overlay(p, p.filter("pid % 3 = 0").select("pid", F.concat(F.lit("x"), "text").alias("text"))).filter("pid % 5 > 0")
    return P.check_receipts(issued, today).select("pid", "ok", "found")


@query("SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def event_window_counts(spark, sf):
    return ingest.run_once(ingest.windowed_counts(ingest.event_stream(spark, f"{sf}/events.parquet")), "quillspan_event_counts")


def _half(spark, sf):
    s = _scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("len")), "doc_id")
    return s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1")


@query()
def fusion_models(spark, sf):
    a, b = (h.withColumnRenamed("p", "f1") for h in _half(spark, sf))
    rows = None
    for kind in ("logreg", "nb", "gbdt"):
        one = M.auroc(D.fusion(a, b, ["f1", "len"], kind).withColumn("model", F.lit(kind)), ["model"])
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query()
def calibrators(spark, sf):
    a, b = _half(spark, sf)
    t = D.temperature(a, spark)
    tempered = b.join(F.broadcast(t)).withColumn("p", 1 / (1 + F.exp(-D.logit("p") / F.col("t"))))
    arms = {"none": b, "temperature": tempered, "isotonic": D.isotonic(a, b).withColumn("p", F.col("q")), "platt": D.platt(a, b).withColumn("p", F.col("q"))}
    rows = None
    for name, arm in arms.items():
        one = M.ece(arm).select(F.lit(name).alias("method"), F.col("gap").alias("ece"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query()
def topic_clusters(spark, sf):
    return D.clusters(table(spark, sf, "embeddings"), (5, 8, 12, 16, 20))
