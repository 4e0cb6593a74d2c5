"""Queries over sentences, candidates, alignment, corpus builders and bookkeeping."""

from pyspark.sql import functions as F

from ..functions import text as T, veto as V
from ..operators import corpus as C, reader as R, spans as P
from ..sources.tables import counted_rows, query_set, table
from . import sqltext as S
from .veto_queries import _turns

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sentences(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(regexp_replace({c}, '([।?!])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda t: trim(t)), lambda t: length(t) >= 2)"


@query(f"WITH n AS (SELECT doc_id, {_sentences(S.norm('text'))} AS s FROM documents) SELECT doc_id, len(s) AS n, CAST(coalesce(list_sum(list_transform(s, lambda t: length(t))), 0) AS BIGINT) AS chars, true AS in_place FROM n")
def sentence_offsets(spark, sf):
    """Sentences with their offsets; in_place: whether each is the slice that its offsets name."""
    s = table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("x")).withColumn("s", T.sentence_spans("x"))
    same = F.forall("s", lambda v: F.substring(F.col("x"), v["start"] + 1, v["end"] - v["start"]) == v["sentence"])
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a + F.length(v["sentence"]))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), chars.alias("chars"), same.alias("in_place"))


@query(f"""WITH w AS (SELECT conv_id, turn, role, text AS x, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y FROM conversations),
n AS (SELECT conv_id, turn, y, {_sentences(S.norm('y'))} AS s, list_distinct(list_filter({S.tokens('x')}, lambda t: length(t) > 1)) AS c FROM w WHERE role = 'assistant' AND y IS NOT NULL),
u AS (SELECT conv_id, turn, unnest(s) AS t, unnest(range(0, len(s))) AS i, c FROM n), o AS (SELECT conv_id, turn, t, i, len(list_filter(c, lambda v: list_contains({S.tokens('t')}, v))) / len(c) AS o FROM u WHERE len(c) > 0),
b AS (SELECT conv_id, turn, arg_min(t, (-o, i)) AS t FROM o GROUP BY ALL) SELECT conv_id, turn, CASE WHEN len(s) <= 1 OR len(c) = 0 THEN md5(y) ELSE md5(t) END AS evidence FROM n LEFT JOIN b USING (conv_id, turn)""")
def best_evidence(spark, sf):
    t = _turns(spark, sf).withColumn("k", F.concat_ws("-", "conv_id", "turn"))
    best = P.best_evidence(t.select("k", F.col("answer").alias("claim")), t.select("k", F.col("evidence").alias("text")), "k")
    return t.select("k", "conv_id", "turn").join(best, "k").select("conv_id", "turn", F.md5("evidence").alias("evidence"))


def _hits(spark, sf):
    """Users' turns as questions, the assistant's turns of the conversation as the passages read."""
    c = table(spark, sf, "conversations")
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    p = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("pid"), T.normalize("text").alias("text"))
    h = q.join(p, "conv_id").select(F.col("conv_id").alias("qid"), "pid", "question", "text", (F.col("pid") + 1).cast("int").alias("passage_rank"), (1 / (1 + F.col("pid"))).alias("passage_score"))
    return h.withColumn("kind", F.when(F.col("qid") % 2 == 0, "REASON").otherwise("THING"))


@query()
def top_sentences(spark, sf):
    return R.top_sentences(_hits(spark, sf)).select("qid", "pid", "sentence_rank", F.round("sentence_score", 6).alias("score"), F.md5("sentence").alias("sentence"))


@query()
def reader_candidates(spark, sf):
    found = R.candidates(R.top_sentences(_hits(spark, sf)))
    low = F.lower("text")
    told = F.count_distinct(F.xxhash64(low), F.xxhash64(F.lit(1), low))  # 128 bits in place of the texts
    return found.groupBy("qid", "pid").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), told.alias("texts"))


@query()
def reader_features(spark, sf):
    """Means of the 31 features over all candidates."""
    s = R.top_sentences(_hits(spark, sf))
    f = R.features(R.candidates(s), s)
    return f.agg(*[F.round(F.avg(c), 6).alias(c) for c in R.FEATURES])


ALIGNED = (
    ("verbatim", "the cat sat on a mat", "cat sat", 4, 11, "exact"), ("first of two", "aa bb aa", "aa", 0, 2, "exact"), ("digits", "2026 সালে", "২০২৬", 0, 4, "normalized"), ("quotes", "he said \"go\" twice", "“go”", 8, 12, "normalized"),
    ("line end", "head\n\ntail a\nb c", "a b", 11, 14, "whitespace"), ("special signs", "a (b.\nc) d", "(b. c)", 2, 8, "whitespace"), ("absent", "x y z", "yy", None, None, None), ("empty answer", "x y z", "", None, None, None), ("empty passage", "", "x", None, None, None),
)


def answer_alignment(spark, sf):
    rows = spark.createDataFrame([r[:3] for r in ALIGNED], "name string, p string, a string")
    return rows.select("name", P.align("p", "a").alias("r")).select("name", F.col("r.start").alias("s"), F.col("r.end").alias("e"), "r.method")


def _literal(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


QUERIES["answer_alignment"] = answer_alignment
ORACLES["answer_alignment"] = "SELECT name, CAST(s AS INT) AS s, CAST(e AS INT) AS e, method FROM (VALUES " + ", ".join(f"({_literal(r[0])}, {_literal(r[3])}, {_literal(r[4])}, {_literal(r[5])})" for r in ALIGNED) + ") v(name, s, e, method)"


@query(f"""WITH t AS (SELECT doc_id, list_slice({S.tokens('text')}, 3, 5) AS w, {S.norm('text')} AS x FROM documents), a AS (SELECT doc_id, x, array_to_string(w, ' ') AS a FROM t WHERE len(w) = 3),
f AS (SELECT doc_id, CASE WHEN contains(x, a) THEN 'strict' END AS f FROM a) SELECT doc_id % 7 AS k, count(*) AS n, count(f) AS strict FROM f GROUP BY 1""")
def alignment_counts(spark, sf):
    """Three tokens of each document, looked for in its text."""
    d = table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("text"), F.slice(T.tokenize("text"), 3, 3).alias("w")).filter("size(w) = 3")
    rows = d.select("doc_id", "text", F.array_join("w", " ").alias("answer"), F.lit("single").alias("answer_type"))
    c = P.alignment_counts(P.align_parts(rows).withColumn("k", F.col("doc_id") % 7), "k")
    return c.select("k", "n", "strict")


@query("SELECT * FROM (VALUES (1, 0, 'red fox', 4, 11, 'exact'), (1, 1, 'blue bird', 16, 25, 'exact'), (2, 0, 'red; blue', NULL, NULL, NULL), (3, 0, 'a\nb', 2, 5, 'whitespace')) v(k, part, text_, start, \"end\", method)")
def multi_span_answers(spark, sf):
    rows = [(1, "the red fox and blue bird", "red fox; blue bird;", "multiple spans"), (2, "the red fox", "red; blue", "single span"), (3, "x a\nb y", "a b", "multiple spans"), (4, "x", " ; ", "multiple spans")]
    r = P.align_parts(spark.createDataFrame(rows, "k int, text string, answer string, answer_type string"))
    return r.filter("k < 4").select("k", "part", "text_", "start", "end", "method")


@query("WITH e AS (SELECT DISTINCT md5(text) AS m, min(doc_id) OVER (PARTITION BY md5(text)) AS doc_id FROM documents), d AS (SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM e) AS a, doc_id IN (SELECT doc_id FROM e) AND doc_id % 3 > 0 AS b FROM documents) SELECT lang, count(*) AS seen, count(*) FILTER (NOT a) AS exact_duplicate, count(*) FILTER (a AND NOT b) AS near_duplicate, count(*) FILTER (a AND b) AS kept FROM d GROUP BY lang")
def dedup_counters(spark, sf):
    d = table(spark, sf, "documents")
    exact = d.groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return C.dedup_counts(d, exact, exact.filter("doc_id % 3 > 0"), "lang")


@query("WITH i AS (SELECT size, doc_id FROM documents, (VALUES (100), (400)) v(size) WHERE doc_id < size AND (size = 400 OR doc_id % 50 > 0 OR doc_id = 50)), g AS (SELECT DISTINCT doc_id FROM labels) SELECT CAST(size AS INT) AS size, count(*) AS n, count(g.doc_id) AS gold FROM i LEFT JOIN g USING (doc_id) GROUP BY size")
def gold_coverage(spark, sf):
    return C.gold_coverage(_sizes(spark, sf), table(spark, sf, "labels"))


def _sizes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(100), F.lit(400))).alias("size"))
    return d.filter("doc_id < size and (size = 400 or doc_id % 50 > 0 or doc_id = 50)")


@query("SELECT CAST(100 AS INT) AS size, count(*) AS n, CAST(0 AS BIGINT) AS missing FROM documents WHERE doc_id < 100 AND (doc_id % 50 > 0 OR doc_id = 50)")
def index_nesting(spark, sf):
    return C.nesting(_sizes(spark, sf))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(k > n // 2 AS INT) AS half FROM r")
def position_halves(spark, sf):
    return C.halves(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query()
def seeded_samples(spark, sf):
    return C.seeded(table(spark, sf, "documents").select("doc_id", "source"), ["source"], 20)


@query()
def held_out_items(spark, sf):
    return C.hold_out(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id", "lang"]).groupBy("held_out").agg(F.count("*").alias("n"))


@query()
def bagged_rows(spark, sf):
    return C.bags(table(spark, sf, "documents").select("doc_id"), "doc_id", 5).groupBy("bag").agg(F.count("*").alias("rows"), F.sum("times").alias("drawn"))


@query("WITH n AS (SELECT label, vec_id % 3 AS source, count(*) AS n FROM embeddings GROUP BY ALL) SELECT label, CAST(sum(n) AS BIGINT) AS size, arg_min(source, (-n, source)) AS dominant_source, round(100 * max(n) / sum(n), 1) AS dominant_pct FROM n GROUP BY label")
def cluster_profile(spark, sf):
    return C.cluster_profile(table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3).alias("source")), "label", "source")


@query("WITH s AS (SELECT lang AS arm, avg(n_chars) FILTER (doc_id < 400) AS a, avg(n_chars) AS b FROM documents GROUP BY lang) SELECT arm, round(a, 6) AS small, round(b, 6) AS large, round(b - a, 6) AS delta, round(-(b - a) / a, 6) AS relative_drop FROM s")
def size_deltas(spark, sf):
    d = table(spark, sf, "documents")
    s = d.filter("doc_id < 400").groupBy(F.col("lang").alias("arm")).agg(F.lit(1).alias("size"), F.avg("n_chars").alias("value")).unionByName(d.groupBy(F.col("lang").alias("arm")).agg(F.lit(2).alias("size"), F.avg("n_chars").alias("value")))
    return C.size_delta(s, 1, 2).select("arm", *[F.round(c, 6).alias(c) for c in ("small", "large", "delta", "relative_drop")])


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND contains(text, 'the') ORDER BY doc_id LIMIT 50")
def corpus_explorer(spark, sf):
    return C.explore(table(spark, sf, "documents"), {"lang": "en"}, "the").select("doc_id", "lang")


GRADES = (("9-10", True), ("5", False), ("৬", True), ("10–12", True), ("11-12", False), ("1-5", False), ("class 8", True), ("none", False))


def grade_filter(spark, sf):
    g = spark.createDataFrame([x[:1] for x in GRADES], "grade string")
    return C.overlapping_grades(g, (6, 7, 8, 9, 10))


QUERIES["grade_filter"] = grade_filter
ORACLES["grade_filter"] = "SELECT * FROM (VALUES " + ", ".join(f"('{g}')" for g, ok in GRADES if ok) + ") v(grade)"


@query("SELECT doc_id, md5(substr(text, 1, 2000)) AS t, length(text) > 2000 AS cut FROM documents")
def truncated_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncated("text").alias("v")).select("doc_id", F.md5("v.text").alias("t"), F.col("v.cut").alias("cut"))


@query("SELECT page_id, 'page_' || regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS pid FROM pages")
def page_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug_pid("page", "url").alias("pid"))


@query("SELECT item_id, CASE WHEN length(text) >= 9 THEN substr(text, 1, 3) || '**' || substr(text, 4, 6) || '**' || substr(text, 10) ELSE text END AS shown FROM benchmark")
def highlights(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.highlight("text", F.lit(3), F.lit(9)).alias("shown"))


@query("SELECT doc_id AS pid, doc_id % 3 > 0 AS citable, CASE WHEN doc_id % 3 > 0 THEN lang || ', ' || source || ', ' || doc_id % 7 || ', ch ' || doc_id % 5 || ', ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS line FROM documents")
def citations(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), F.col("lang").alias("grade_label"), F.col("source").alias("subject"), (F.col("doc_id") % 7).alias("chapter_no"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("ch "), (F.col("doc_id") % 5).cast("string"))).alias("chapter_title"))
    return C.citation(d)


PAIRS = (("car", "auto", True), ("auto", "motor", True), ("fast", "quick", True), ("quick", "rapid", True), ("rapid", "swift", True), ("car", "bike", False), ("the", "a", False))


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "a string, b string, reviewed boolean")


@query("SELECT * FROM (VALUES ('auto', 'auto'), ('car', 'auto'), ('motor', 'auto'), ('fast', 'fast'), ('quick', 'fast'), ('rapid', 'fast'), ('swift', 'fast')) v(term, class)")
def synonym_classes(spark, sf):
    return C.synonym_classes(_pairs(spark))


@query("SELECT * FROM (VALUES (7, 5, 2, 7, 2)) v(pairs_total, pairs_reviewed, pairs_unreviewed, terms_in_classes, classes)")
def synonym_stats(spark, sf):
    return C.synonym_stats(_pairs(spark))


@query("SELECT * FROM (VALUES (1, 'a fast car quick rapid auto motor', 4), (2, 'nothing here', 0), (3, 'quick rapid fast', 1)) v(qid, text, added)")
def query_expansion(spark, sf):
    q = spark.createDataFrame([(1, "a fast car"), (2, "nothing here"), (3, "quick rapid")], "qid int, text string")
    # 3: quick adds fast (rapid is there), rapid would add fast again and has quick there.
    return C.expanded(q, C.synonym_classes(_pairs(spark)))


@query("SELECT * FROM (VALUES (3, 2, 66.67, 2.5)) v(queries, expanded_queries, expanded_pct, added_terms_per_expanded_query)".replace("SELECT *", "SELECT queries, expanded_queries, CAST(expanded_pct AS DOUBLE) AS expanded_pct, CAST(added_terms_per_expanded_query AS DOUBLE) AS added_terms_per_expanded_query"))
def expansion_coverage(spark, sf):
    return C.expansion_coverage(query_expansion(spark, sf))


@query("WITH t AS (SELECT DISTINCT trim(source || ' ' || lang) AS t FROM documents), n AS (SELECT t AS name FROM t WHERE length(t) > 2 UNION SELECT unnest(string_split_regex(t, '\\s+')) FROM t WHERE length(t) > 2) SELECT DISTINCT name FROM n WHERE length(name) > 3 OR name IN (SELECT t FROM t)")
def title_gazetteer(spark, sf):
    return C.gazetteer(table(spark, sf, "documents").select(F.concat_ws(" ", "source", "lang").alias("title")))


@query("SELECT source AS name, CAST(CASE WHEN source LIKE '%a%' THEN count(*) ELSE -1 END AS BIGINT) AS rows FROM documents GROUP BY source")
def ledger_rows(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("rows"))
    return counted_rows(d.select("name", F.lit(-1).cast("long").alias("rows")), d.filter("name like '%a%'"))


@query("SELECT doc_id AS qid FROM documents WHERE lang = 'en' AND doc_id % 3 > 0 ORDER BY doc_id LIMIT 25")
def query_sets(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("split"), (F.col("doc_id") % 3 > 0).alias("is_answerable"))
    return query_set(q, "en", 25).select("qid")


@query("WITH s AS (SELECT label AS qid, ((vec_id * 37 + 11) % 101) / CAST(100 AS DOUBLE) AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS k FROM s) SELECT qid, max(score) AS best, coalesce(max(score) FILTER (k = 2), 0) AS second, round(max(score) - coalesce(max(score) FILTER (k = 2), 0), 6) AS margin, round(max(score) - median(score), 6) AS null_margin FROM r GROUP BY qid")
def answer_margins(spark, sf):
    s = table(spark, sf, "embeddings").select(F.col("label").alias("qid"), (((F.col("vec_id") * 37 + 11) % 101) / 100).alias("score"))
    return R.margins(s).select("qid", "best", "second", F.round("margin", 6).alias("margin"), F.round("null_margin", 6).alias("null_margin"))


@query("WITH a AS (SELECT doc_id % 50 AS pid, n_chars % 90 AS s, n_chars % 90 + 5 AS e FROM documents), b AS (SELECT doc_id % 50 AS pid, doc_id % 60 AS s, doc_id % 60 + 40 AS e FROM documents WHERE doc_id < 500) SELECT a.pid, a.s AS start, count(*) AS n FROM a JOIN b ON a.pid = b.pid AND b.s <= a.s AND a.e <= b.e GROUP BY ALL")
def contained_spans(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select((F.col("doc_id") % 50).alias("pid"), (F.col("n_chars") % 90).alias("start"), (F.col("n_chars") % 90 + 5).alias("end"))
    b = d.filter("doc_id < 500").select((F.col("doc_id") % 50).alias("pid"), F.lit("s").alias("sentence"), (F.col("doc_id") % 60).alias("s_start"), (F.col("doc_id") % 60 + 40).alias("s_end"))
    return R.contained(a, b).groupBy("pid", "start").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT text) AS texts, true AS same FROM documents")
def minhash_signatures(spark, sf):
    """Distinct texts, and whether equal ones have one signature of 64 values."""
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text"), C.minhash("text").alias("m")).select("text", F.xxhash64("m").alias("x"), F.xxhash64(F.lit(1), "m").alias("y"), F.size("m").alias("n"))
    one = d.groupBy("text").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y", "n")])
    alike = [F.col(f"min_{c}") == F.col(f"max_{c}") for c in ("x", "y")]
    return one.filter("text is not null").agg(F.count("*").alias("texts"), F.bool_and(alike[0] & alike[1] & (F.col("min_n") == 64) & (F.col("max_n") == 64)).alias("same"))
