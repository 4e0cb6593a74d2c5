"""Queries over answers: signals, decisions, the metric ladder, risk curves, contrast sets."""

from pyspark.sql import functions as F

from ..functions import text as T, veto as V
from ..operators import contrast as C, metrics as M, signals as G, spans as P
from ..sources.tables import table
from . import sqltext as S
from .corpus_queries import _P, _f1_sql, _scored
from .veto_queries import _SIDES, _turns

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


_CURVE = f"""s AS (SELECT doc_id, y, CAST(p AS DOUBLE) AS p FROM ({_P})), r AS (SELECT row_number() OVER (ORDER BY p DESC, doc_id) AS k, sum(1 - y) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS err, count(*) OVER () AS n FROM s),
g AS (SELECT CAST(i AS INT) AS point, greatest(CAST(round_even((100 + i * ((SELECT count(*) FROM s) - 1)) / 100.0, 0) AS BIGINT), 1) AS k FROM range(0, 101) t(i)), c AS (SELECT point, g.k, round(g.k / n, 4) AS coverage, round(err / g.k, 4) AS risk FROM g JOIN r ON g.k = r.k)"""


@query(f"WITH {_CURVE} SELECT * FROM c")
def risk_curve(spark, sf):
    return M.risk_curve(_scored(spark, sf))


_SUMMARY = "SELECT sum((coverage - px) * (risk + py) / 2) AS rc_auc, max_by(risk, point) AS risk_at_full, min_by(risk, point) FILTER (coverage >= 0.5) AS risk_at_50, min_by(risk, point) FILTER (coverage >= 0.8) AS risk_at_80 FROM (SELECT *, lag(coverage) OVER (ORDER BY point) AS px, lag(risk) OVER (ORDER BY point) AS py FROM c)"


@query(f"""WITH {_CURVE}, a AS ({_SUMMARY}), s2 AS (SELECT doc_id, y, CASE WHEN doc_id % 5 = 0 THEN least(CAST(p AS DOUBLE), 0.15) ELSE CAST(p AS DOUBLE) END AS p FROM ({_P})), r2 AS (SELECT row_number() OVER (ORDER BY p DESC, doc_id) AS k, sum(1 - y) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS err, count(*) OVER () AS n FROM s2),
c2 AS (SELECT point, g.k, round(g.k / n, 4) AS coverage, round(err / g.k, 4) AS risk FROM g JOIN r2 ON g.k = r2.k), b AS ({_SUMMARY.replace('FROM c)', 'FROM c2)')}) SELECT 'confidence' AS policy, round(rc_auc, 4) AS rc_auc, risk_at_full, risk_at_50, risk_at_80 FROM a UNION ALL SELECT 'vetoed', round(rc_auc, 4), risk_at_full, risk_at_50, risk_at_80 FROM b""")
def policy_curves(spark, sf):
    s = _scored(spark, sf)
    capped = s.withColumn("p", F.when(F.col("doc_id") % 5 == 0, F.least("p", F.lit(V.CAP))).otherwise(F.col("p")))
    return M.compare_policies({"confidence": s, "vetoed": capped})


@query(f"""WITH s AS (SELECT y, CAST(p AS DOUBLE) AS p FROM ({_P})), t AS (SELECT tau, feasible, count(*) AS n_test, count(*) FILTER (p >= tau) AS answered, count(*) FILTER (p >= tau AND y = 0) AS errors FROM s, (VALUES (0.6::DOUBLE, true), (1.0::DOUBLE, false)) v(tau, feasible) GROUP BY ALL)
SELECT tau, n_test, answered, errors, round(answered / greatest(n_test, 1), 4) AS coverage, round(CASE WHEN answered > 0 THEN errors / answered ELSE 0 END, 4) AS risk, feasible AND answered > 0 AS guarantee_in_force, CASE WHEN answered > 0 THEN errors / answered <= 0.1 END AS bound_held, CASE WHEN feasible AND answered > 0 THEN 'with 90% confidence, at most 10% of answered questions are wrong' ELSE 'NOT IN FORCE' END AS claim FROM t""")
def conformal_verify(spark, sf):
    one = lambda tau, feasible: M.conformal_verify(_scored(spark, sf), tau, feasible).withColumn("tau", F.lit(tau))
    return one(0.6, True).unionByName(one(1.0, False))


_ARMS = f"SELECT doc_id % 3 AS arm, quality AS y, ((doc_id * 37 + 11) % 101) / CAST(100 AS DOUBLE) AS p FROM labels"


@query(f"""WITH s AS ({_ARMS}), d AS (SELECT arm, p, count(*) AS n, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY arm, p), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY arm ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(pos) OVER (PARTITION BY arm ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY arm ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS prec FROM d),
a AS (SELECT arm, sum(pos * (lo + neg / 2)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * prec) / sum(pos) AS auprc FROM w GROUP BY arm), b AS (SELECT arm, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy FROM s GROUP BY arm) SELECT arm, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy FROM a JOIN b USING (arm)""")
def fusion_comparison(spark, sf):
    s = _scored(spark, sf).withColumn("arm", F.col("doc_id") % 3)
    return _rounded(M.fusion_row(s, ["arm"]), "auroc", "auprc", "brier", "accuracy")


@query()
def bootstrap_interval(spark, sf):
    return M.bootstrap_interval(_scored(spark, sf), "y", "doc_id")


_TURN = "SELECT conv_id, turn, text AS x, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y, role FROM conversations"
_TIERS = f"w AS ({_TURN}), l AS (SELECT conv_id, turn, {S.tokens_lower('y')} AS a, {S.tokens_lower('x')} AS b FROM w WHERE role = 'assistant' AND y IS NOT NULL), t AS (SELECT conv_id, turn, {_f1_sql('a', 'b')} AS f1, a = b AS em, len(b) % 4 > 0 AS is_answerable, len(b) % 3 = 0 AS abstained FROM l)"


def _tiers(spark, sf):
    t = _turns(spark, sf).select("conv_id", "turn", T.tokenize_lower("evidence").alias("a"), T.tokenize_lower("answer").alias("b"))
    return t.select("conv_id", "turn", M.token_f1(F.col("a"), F.col("b")).alias("f1"), (F.col("a") == F.col("b")).cast("double").alias("em"), (F.size("b") % 4 > 0).alias("is_answerable"), (F.size("b") % 3 == 0).alias("abstained"))


@query(f"WITH {_TIERS} SELECT count(*) AS n, round(avg(CAST(em AS DOUBLE)), 6) AS em, round(avg(f1), 6) AS f1, count(*) FILTER (is_answerable) AS n_hasans, round(avg(f1) FILTER (is_answerable), 6) AS hasans_f1, count(*) FILTER (NOT is_answerable) AS n_noans, round(avg(CAST(abstained AS DOUBLE)) FILTER (NOT is_answerable), 6) AS noans_f1, round(avg(CAST(abstained AS DOUBLE)), 6) AS abstention_rate FROM t")
def qa_aggregate(spark, sf):
    return _rounded(M.qa_aggregate(_tiers(spark, sf), ["em", "f1"], "f1"), "em", "f1", "hasans_f1", "noans_f1", "abstention_rate")


@query(f"WITH {_TIERS} SELECT conv_id, max(f1) >= 0.6 AS correct, round(max(f1), 6) AS best FROM t GROUP BY conv_id")
def best_answer(spark, sf):
    """The best of a conversation's answers against its first question, through best_over_golds, and whether it counts as correct."""
    t = _turns(spark, sf).select("conv_id", T.tokenize_lower("evidence").alias("a"), T.tokenize_lower("answer").alias("b"))
    best = t.withColumn("f", M.best_over_golds(M.token_f1, F.col("b"), F.array("a"))).groupBy("conv_id").agg(F.max("f").alias("best"))
    return best.select("conv_id", (F.col("best") >= G.CORRECT).alias("correct"), F.round("best", 6).alias("best"))


@query("SELECT * FROM (VALUES (1, 1.0), (2, 0.8), (3, 1.0), (4, 0.0), (5, 0.666667), (6, 0.5)) v(k, f)".replace("SELECT *", "SELECT k, CAST(f AS DOUBLE) AS f"))
def set_f1(spark, sf):
    rows = [(1, ["red", "blue"], ["blue", "red"]), (2, ["red", "blue", "green"], ["red", "blue"]), (3, [], []), (4, ["red"], []), (5, ["red", "red"], ["red"]), (6, ["old red", "sky"], ["red", "blue"])]
    r = spark.createDataFrame([(k, [x.split() for x in p], [x.split() for x in g]) for k, p, g in rows], "k int, p array<array<string>>, g array<array<string>>")
    # 6: "old red" takes "red" with 2/3, "sky" nothing: 2 * (2/3) / 4 = 1/3.
    return r.select("k", F.round(M.set_f1(F.col("p"), F.col("g")), 6).alias("f"))


ORACLES["set_f1"] = ORACLES["set_f1"].replace("(6, 0.5)", "(6, 0.333333)")

_TRI = "list_distinct(list_transform(range(1, CAST(length({0}) - 1 AS BIGINT)), lambda i: substr({0}, i, 3)))"
_GROUND = f"""{_SIDES}, lo AS (SELECT *, list_transform(a, lambda t: lower(t)) AS la, list_transform(e, lambda t: lower(t)) AS le, ' ' || lower(x) || ' ' AS sx, ' ' || lower(y) || ' ' AS sy FROM f),
gr AS (SELECT *, CASE WHEN len(list_filter(la, lambda t: length(t) > 1)) > 0 THEN list_filter(la, lambda t: length(t) > 1) ELSE la END AS own, {_TRI.format('sx')} AS tx, {_TRI.format('sy')} AS ty FROM lo),
g2 AS (SELECT *, CASE WHEN len(own) = 0 THEN 0 ELSE len(list_filter(own, lambda t: list_contains(le, t))) / len(own) END AS cont, CASE WHEN len(tx) = 0 OR len(ty) = 0 THEN 0 ELSE len(list_filter(tx, lambda t: list_contains(ty, t))) / sqrt(CAST(len(tx) AS DOUBLE) * len(ty)) END AS cosine, x <> '' AND contains(y, x) AS literal, f_date OR f_numeral OR f_unit OR f_entity AS vetoed FROM gr)"""


def _grounded(spark, sf):
    t = _turns(spark, sf).select("conv_id", "turn", T.normalize("answer").alias("x"), T.normalize("evidence").alias("y"))
    return t.select("conv_id", "turn", "x", "y", G.containment("x", "y").alias("containment"), T.trigram_cosine("x", "y").alias("cosine"), ((F.col("x") != "") & F.contains("y", F.col("x"))).alias("literal"), V.check("x", "y").alias("fired"))


@query(f"WITH {_GROUND} SELECT conv_id, turn, round(cont, 6) AS containment, round(cosine, 6) AS cosine, literal, CAST(round(CASE WHEN x = '' THEN 0 WHEN vetoed THEN 0.15 ELSE greatest(0, least(1, 0.6 * cont + 0.2 * cosine + 0.2 * CAST(literal AS INT))) END, 6) AS DOUBLE) AS s2 FROM g2")
def grounding_signals(spark, sf):
    g = _grounded(spark, sf).withColumn("s2", G.grounding(F.col("containment"), F.col("cosine"), F.col("literal"), F.col("fired"), F.col("x")))
    return _rounded(g, "containment", "cosine", "s2").select("conv_id", "turn", "containment", "cosine", "literal", "s2")


@query(f"""WITH w AS (SELECT conv_id, turn, lower(trim({S.norm('text')})) AS x FROM conversations WHERE role = 'assistant'), t AS (SELECT *, {_TRI.format("(' ' || x || ' ')")} AS s FROM w),
p AS (SELECT a.conv_id, a.turn, CASE WHEN a.x = b.x THEN 1 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_filter(a.s, lambda t: list_contains(b.s, t))) / sqrt(CAST(len(a.s) AS DOUBLE) * len(b.s)) END AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.x <> '' AND b.x <> ''), m AS (SELECT conv_id, turn, 0.6 * max(s) + 0.4 * avg(s) AS s4 FROM p GROUP BY ALL)
SELECT conv_id, turn, CAST(round(CASE WHEN s4 IS NULL THEN 0.5 ELSE greatest(0, least(1, s4)) END, 6) AS DOUBLE) AS s4 FROM t LEFT JOIN m USING (conv_id, turn)""")
def consistency_signals(spark, sf):
    a = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", T.normalize("text").alias("text"))
    return _rounded(G.consistency(a, ["conv_id"], "turn", "text"), "s4")


@query("SELECT c.doc_id AS qid, CAST(round(coalesce(avg(CASE WHEN b.doc_id IS NULL THEN NULL WHEN b.doc_id % 2 = c.doc_id % 2 AND b.n_chars % 3 = c.n_chars % 3 THEN 1.0 ELSE 0 END), 0.5), 6) AS DOUBLE) AS s5 FROM documents c LEFT JOIN documents b ON b.doc_id // 10 = c.doc_id // 10 AND c.doc_id % 4 > 0 GROUP BY c.doc_id")
def ensemble_signals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).alias("pid"), (F.col("n_chars") % 3).alias("start"))
    bags = d.withColumn("g", F.expr("doc_id div 10")).select("g", "pid", "start").join(d.filter("doc_id % 4 > 0").select(F.expr("doc_id div 10").alias("g"), F.col("doc_id").alias("qid")), "g").select("qid", "pid", "start")
    return _rounded(G.ensemble(d.withColumnRenamed("doc_id", "qid"), bags, "qid"), "s5")


@query("WITH s AS (SELECT doc_id, ((doc_id * 37 + 11) % 101) / CAST(100 AS DOUBLE) AS score, ((doc_id * 7) % 21 - 10) / CAST(10 AS DOUBLE) AS margin FROM documents) SELECT doc_id, round(greatest(0, least(1, 0.55 * score + 0.3 * greatest(margin, 0) + 0.15 * 0.5 * (1 + margin / (1 + abs(margin))))), 6) AS s1 FROM s")
def reader_signals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (((F.col("doc_id") * 37 + 11) % 101) / 100).alias("score"), (((F.col("doc_id") * 7) % 21 - 10) / 10).alias("margin"))
    return d.select("doc_id", F.round(G.reader(F.col("score"), F.col("margin"), F.col("margin"), F.lit("x")), 6).alias("s1"))


@query(f"""WITH {_GROUND}, q AS (SELECT conv_id, turn, vetoed, greatest(0, least(1, 0.55 * cosine + 0.3 * cont + 0.15 * 0.5 * (1 + cont / (1 + cont)))) AS s1, CASE WHEN x = '' THEN 0 WHEN vetoed THEN 0.15 ELSE greatest(0, least(1, 0.6 * cont + 0.2 * cosine + 0.2 * CAST(literal AS INT))) END AS s2, f_date, f_numeral, f_unit, f_entity FROM g2 WHERE x <> ''),
r AS (SELECT *, CASE WHEN vetoed THEN least(0.15, (s1 + s2 + 1.5) / 5) ELSE (s1 + s2 + 1.5) / 5 END AS confidence FROM q)
SELECT conv_id, turn, CAST(round(confidence, 6) AS DOUBLE) AS confidence, NOT vetoed AND confidence >= 0.4 AS answered, CASE WHEN vetoed THEN 'veto: ' || array_to_string(list_filter([CASE WHEN f_date THEN 'date' END, CASE WHEN f_numeral THEN 'numeral' END, CASE WHEN f_unit THEN 'unit' END, CASE WHEN f_entity THEN 'entity' END], lambda t: t IS NOT NULL), ',') WHEN confidence < 0.4 THEN 'below threshold' ELSE 'answered' END AS reason FROM r""")
def confidence_chain(spark, sf):
    """Signals of each answered turn, their mean under the cap, and the decision at 0.4."""
    g = _grounded(spark, sf).filter("x <> ''")
    s1 = G.reader(F.col("cosine"), F.col("containment"), F.col("containment"), F.col("x"))
    s2 = G.grounding(F.col("containment"), F.col("cosine"), F.col("literal"), F.col("fired"), F.col("x"))
    c = g.withColumn("confidence", G.confidence([s1, s2, F.lit(G.NEUTRAL), F.lit(G.NEUTRAL), F.lit(G.NEUTRAL)], F.col("fired")))
    return _rounded(c.select("conv_id", "turn", "confidence", G.decision(F.col("confidence"), F.lit(0.4), F.col("fired")).alias("d")).select("conv_id", "turn", "confidence", "d.*"), "confidence")


@query(f"WITH {_GROUND} SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'হ্যাঁ' END AS yes_no FROM g2")
def yes_no_answers(spark, sf):
    return _grounded(spark, sf).select("conv_id", "turn", G.yes_no(F.when(F.col("turn") % 2 == 1, "polarity").otherwise("span"), F.col("fired")).alias("yes_no"))


@query(f"""WITH {_GROUND} SELECT conv_id, turn, CAST(29 AS INT) AS n, round(cont + cosine + CAST(literal AS INT) + CAST(vetoed AS INT) + CAST(f_numeral AS INT) + CAST(f_date AS INT) + CAST(f_unit AS INT) + CAST(f_entity AS INT) + CAST(vetoed AS INT) + CAST(f_numeral AS INT) + CAST(f_date AS INT) + CAST(f_unit AS INT) + CAST(f_entity AS INT) + 1 + len(a) + len(e), 5) AS parts FROM g2""")
def fusion_features(spark, sf):
    """How many features a turn has, and the sum of those that text decides (without those of years and numbers)."""
    t = _turns(spark, sf).select("conv_id", "turn", T.normalize("answer").alias("x"), T.normalize("evidence").alias("y"))
    half = F.lit(0.5)
    f = t.select("conv_id", "turn", G.components("x", "y", half, half, half, half, F.lit(0), half, half, half).alias("f"))
    names = ["s2_containment", "s2_trigram_cos", "s2_literal", "s2_veto_fired", *[f"veto_{c}" for c in V.CATEGORIES], "veto_any", "veto_count", "polarity_match", "answer_tokens", "evidence_tokens"]
    return f.select("conv_id", "turn", F.lit(len(f.schema["f"].dataType.fields)).alias("n"), F.round(sum(F.col(f"f.{n}") for n in names), 5).alias("parts"))


_YEARS = "list_distinct(list_filter({0}, lambda t: regexp_full_match(t, '[0-9]{{4}}') AND t BETWEEN '1000' AND '2100'))"


@query(f"""WITH d AS (SELECT doc_id, {S.norm('text')} AS x, {S.tokens('text')} AS t FROM documents), y AS (SELECT *, {_YEARS.format('t')} AS y FROM d), n AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)*'), lambda v: NOT list_contains(y, v))) AS value FROM y),
a AS (SELECT DISTINCT unnest(y) AS value FROM y), u AS (SELECT DISTINCT unnest(list_filter(list_transform(t, lambda v: lower(v)), lambda v: list_contains(['m', 'km', 'cm', 'mm', 'kg', 'g', 'mg', 'l', 'ml', 's', 'hz', 'kw', 'mw'], v))) AS value FROM d)
SELECT 'date' AS kind, count(*) AS n, min(value) AS first, max(value) AS last FROM a UNION ALL SELECT 'numeral', count(*), min(value), max(value) FROM n UNION ALL SELECT 'unit', count(*), min(value), max(value) FROM u""")
def value_pools(spark, sf):
    d, out = table(spark, sf, "documents"), None
    for kind in ("date", "numeral", "unit"):
        one = C.pool(d, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "n", "first", "last")


@query()
def contrast_swaps(spark, sf):
    """Sentences of documents with one value changed, by generator."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("i", "statement")).select(F.concat_ws("-", "doc_id", "i").alias("id"), "statement")
    out = None
    for kind in ("date", "numeral", "unit"):
        one = C.swapped(d, C.pool(d, kind, "statement"), kind).withColumn("generator", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


#: statement, negated, turned around
TURNED = (("বাদুড় ডিম পাড়ে।", "বাদুড় ডিম পাড়ে না।", None), ("বাদুড় ডিম পাড়ে", "বাদুড় ডিম পাড়ে না", None), ("বাদুড় ডিম পাড়ে না।", "বাদুড় ডিম পাড়ে।", None), ("ডিম পাড়ে", None, None), ("মেঘ থেকে বৃষ্টি নামে", "মেঘ থেকে বৃষ্টি নামে না", "বৃষ্টি থেকে মেঘ নামে"), ("মেঘ থেকে মেঘ নামে", "মেঘ থেকে মেঘ নামে না", None), ("নদী হতে খাল কাটে", "নদী হতে খাল কাটে না", "খাল হতে নদী কাটে"))


def contrast_turns(spark, sf):
    s = spark.createDataFrame(TURNED, "statement string, a string, b string")
    return s.select("statement", C.negated("statement").alias("negated"), C.turned_around("statement").alias("turned"))


def _text_values(rows, names):
    one = lambda v: "NULL" if v is None else f"nfc_normalize('{v}')"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({', '.join(names)})"


QUERIES["contrast_turns"] = contrast_turns
ORACLES["contrast_turns"] = _text_values(TURNED, ("statement", "negated", "turned")).replace("SELECT *", "SELECT statement, negated, CAST(turned AS VARCHAR) AS turned")


@query("SELECT round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS car, round(count(*) FILTER (doc_id % 2 = 0 AND doc_id % 5 > 0) / count(*) FILTER (doc_id % 5 > 0), 6) AS aorr FROM documents")
def counterfactual_rates(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 3 == 0).alias("followed"), (F.col("doc_id") % 2 == 0).alias("kept"), (F.col("doc_id") % 5 > 0).alias("answered"))
    return _rounded(C.car_aorr(d), "car", "aorr")


@query()
def perturbed_passages(spark, sf):
    """Passages of documents whose first year or number gives way to another of the corpus."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text")
    answers = d.select("pid", F.regexp_extract(T.normalize("text"), "([0-9]+)", 1).alias("answer"))
    return C.perturbed(d, answers, {k: C.pool(d, k) for k in ("date", "numeral")}).select("pid", "original_answer", "tampered_answer", F.md5("text").alias("digest"))


@query()
def neutral_pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 80).alias("statement"), F.md5("text").alias("evidence"), F.col("doc_id").alias("pid"))
    return C.neutral_pairs(d, "doc_id", "statement", "evidence", "pid").select("doc_id", "pid")
