"""Contradiction, stemming and question rules on fixtures with known answers."""

from pyspark.sql import Window, functions as F

from ..functions import lexicon as L, text as T, veto as V
from ..sources.tables import table
from . import sqltext as S

QUERIES, ORACLES = {}, {}

#: name, answer, evidence, what fires
PAIRS = (
    ("date year", "নদীটি ১৯৮৮ সালে শুকায়", "নদীটি ১৯৯৮ সালে শুকায়", "date"),
    ("date same", "স্কুলটি ২০০১ সালে খোলে", "স্কুলটি ২০০১ সালে খোলে", ""),
    ("date absent", "স্কুলটি ২০০১ সালে খোলে", "স্কুলটি খোলে", ""),
    ("date by month", "মেলা বসে ৭ জুন", "মেলা বসে ৯ জুন", "date"),
    ("date among others", "১৯৮৮ সালে বন্যা হয়", "১৯৮৮ সালে ও ১৯৯৮ সালে বন্যা হয়", ""),
    ("date too early", "in 950 it fell", "in 951 it fell", "numeral"),
    ("date too late", "in 2150 it fell", "in 2160 it fell", "numeral"),
    ("numeral", "বাগানে 12 টি গাছ আছে", "বাগানে 14 টি গাছ আছে", "numeral"),
    ("numeral clock", "at 12:30 it rang", "at 12 30 it rang", ""),
    ("numeral grouped", "দাম 1,200 টাকা ছিল", "দাম 1,300 টাকা ছিল", "numeral"),
    ("numeral same", "দাম 3.5 টাকা ছিল", "দাম 3.5 টাকা ছিল", ""),
    ("numeral absent", "দাম 3 টাকা", "দাম কম ছিল", ""),
    ("unit bare", "গর্তটি মিটার হিসাবে মাপা", "গর্তটি ফুট হিসাবে মাপা", "unit,entity"),
    ("unit latin", "ওজন 5 kg ছিল", "ওজন 5 g ছিল", "unit"),
    ("unit case", "ওজন 5 KG ছিল", "ওজন 5 kg ছিল", ""),
    ("unit absent", "ওজন 5 kg ছিল", "ওজন বেশ ছিল", ""),
    ("name latin", "Newton found it", "Einstein found it", "entity"),
    ("name within", "Isaac Newton found it", "the law by Isaac Newton", ""),
    ("name absent", "Newton found it", "someone found it", ""),
    ("name before marker", "কুমিল্লা জেলা বড়", "যশোর জেলা বড়", "entity"),
    ("name in the text", "যশোর জেলা বড়", "যশোর একটি শহর এবং খুলনা জেলা", ""),
    ("name after title", "কবি সুকান্ত লেখেন", "কবি জসীম লেখেন", "entity"),
    ("name two markers", "শহর বন্দর দেখি", "শহর বন্দর দেখি", ""),
    ("name a number", "5 জেলা আছে", "7 জেলা আছে", "numeral"),
    ("swap", "গাছ আলো শোষণ করে রাতে", "গাছ পানি শোষণ করে রাতে", "entity"),
    ("swap of three", "লাল নীল সবুজ পাখি গাছে বসে", "কালো সাদা হলুদ পাখি গাছে বসে", ""),
    ("swap too short", "গাছ আলো নেয়", "গাছ পানি নেয়", ""),
    ("swap added only", "গাছ আলো শোষণ করে", "গাছ দিনে আলো শোষণ করে", ""),
    ("swap unlike", "রহিম বাজার থেকে মাছ কিনল", "করিম স্কুল থেকে বই আনল", ""),
    ("polarity", "বাদুড় ডিম পাড়ে না", "বাদুড় ডিম পাড়ে", "polarity"),
    ("polarity both", "বাদুড় ডিম পাড়ে না", "বাদুড় কখনো ডিম পাড়ে না", ""),
    ("polarity short", "না", "বাদুড় ডিম পাড়ে", ""),
    ("polarity without", "লবণ ছাড়া রান্না হয়", "লবণ দিয়ে রান্না হয়", "polarity"),
    ("order", "মেঘ থেকে বৃষ্টি নামে", "বৃষ্টি থেকে মেঘ নামে", "relation_order"),
    ("order other", "মেঘ থেকে বৃষ্টি নামে", "মেঘ থেকে শিলা নামে", "entity"),
    ("order than", "বাঘ চেয়ে সিংহ বড়", "সিংহ চেয়ে বাঘ বড়", "relation_order"),
    ("order same", "বাঘ চেয়ে সিংহ বড়", "বাঘ চেয়ে সিংহ বড়", ""),
    ("several", "১৯৮৮ সালে ঝড়ে 3 টি সেতু ভাঙে না", "১৯৯৮ সালে ঝড়ে 5 টি সেতু ভাঙে", "date,numeral,polarity"),
    ("empty answer", "", "গাছ আলো শোষণ করে", ""),
    ("empty evidence", "গাছ আলো শোষণ করে", "", ""),
)


def _pairs(spark):
    return spark.createDataFrame([p[:3] for p in PAIRS], "name string, a string, e string")


def _values(rows, names):
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({', '.join(names)})"


def veto_categories(spark, sf):
    return _pairs(spark).select("name", F.array_join(V.check("a", "e"), ",").alias("fired"))


def veto_cap(spark, sf):
    return _pairs(spark).select("name", V.capped(F.lit(0.99), V.check("a", "e")).alias("support"))


def stems(spark, sf):
    vocabulary = F.array(F.lit(L.words("উদ্ভিদ")[0]))
    rows = spark.createDataFrame([("উদ্ভিদের",), ("উদ্ভিদগুলোর",), ("পাতা",)], "t string")
    return rows.select("t", V.stem(T.nfc_bengali("t"), vocabulary).alias("stem"))


#: question, class, decoder
QUESTIONS = (
    ("কত সালে সেতু হয়", "TIME", "span"),
    ("সেতুটি কবে হয়", "TIME", "span"),
    ("কে গানটি লেখেন", "PERSON", "span"),
    ("কারা কারা খেলে", "PERSON", "list"),
    ("মেলা কোথায় বসে", "PLACE", "span"),
    ("মেলা কোন দেশে বসে", "PLACE", "span"),
    ("কেন মেঘ জমে", "REASON", "span"),
    ("কী কারণে মেঘ জমে", "REASON", "span"),
    ("কীভাবে নৌকা ভাসে", "PROCESS", "span"),
    ("ঝুড়িতে কত আম", "NUMBER", "span"),
    ("ঝুড়িতে কয়টি আম", "NUMBER", "list"),
    ("এটি কী", "POLARITY", "polarity"),
    ("বাদুড় কি", "POLARITY", "polarity"),
    ("কি", "THING", "span"),
    ("কি বাদুড় ডিম পাড়ে", "POLARITY", "polarity"),
    ("কি বাদুড়", "THING", "span"),
    ("কী কী ফল পাকে", "THING", "list"),
    ("কোন ফল মিষ্টি", "THING", "span"),
    ("ফলের তালিকা দাও", "UNKNOWN", "list"),
    ("লেখো", "UNKNOWN", "span"),
    ("", "UNKNOWN", "span"),
)


def question_classes(spark, sf):
    q = spark.createDataFrame(QUESTIONS, "q string, k string, r string").select("q", V.question_class("q").alias("kind"))
    return q.select("q", "kind", V.route(F.col("kind"), F.lit("factoid"), "q").alias("route"))


#: span, class, whether it can answer
SPANS = (("1988", "TIME", True), ("মেলা", "TIME", False), ("৭ জুন", "TIME", True), ("12 আম", "NUMBER", True), ("মিটার", "NUMBER", True), ("আম", "NUMBER", False), ("7", "PERSON", False), ("7 জন", "PERSON", True), ("7", "PLACE", False), ("যশোর জেলা", "PLACE", True), ("মেঘ জমে", "REASON", False), ("মেঘ জমে বলে", "REASON", True), ("দাঁড় টেনে", "PROCESS", False), ("আম", "THING", True), ("…", "THING", False))


def span_classes(spark, sf):
    s = spark.createDataFrame(SPANS, "span string, kind string, k boolean")
    return s.select("span", "kind", V.span_matches_class("span", F.col("kind")).alias("fits"))


def _turns(spark, sf):
    """Every assistant row with the last user row before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf, "conversations").withColumn("evidence", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))
    return c.filter("role = 'assistant' and evidence is not null").select("conv_id", "turn", F.col("text").alias("answer"), "evidence")


def veto_turns(spark, sf):
    said = V.swap(T.tokenize("answer"), T.tokenize("evidence"))
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(V.check("answer", "evidence"), ",").alias("fired"), said["said"].alias("said"), said["stands"].alias("stands"))


def veto_feature_turns(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", V.features("answer", "evidence").alias("f")).select("conv_id", "turn", "f.*")


_LATIN_UNITS = "['" + "', '".join(u for u in L.UNITS if u.isascii()) + "']"
#: The checks on text without Bengali: of those, polarity and order never fire and no stopword is met. RE2's \b knows
#: ASCII letters only, so other Latin letters are made word characters first.
_SIDES = rf"""w AS (SELECT conv_id, turn, role, text AS x, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y FROM conversations),
n AS (SELECT conv_id, turn, {S.norm('x')} AS x, {S.norm('y')} AS y, {S.tokens('x')} AS a, {S.tokens('y')} AS e FROM w WHERE role = 'assistant' AND y IS NOT NULL),
s AS (SELECT *, list_distinct(list_filter(a, lambda t: regexp_full_match(t, '[0-9]{{4}}') AND t BETWEEN '1000' AND '2100')) AS ya, list_distinct(list_filter(e, lambda t: regexp_full_match(t, '[0-9]{{4}}') AND t BETWEEN '1000' AND '2100')) AS ye,
list_distinct(regexp_extract_all(x, '[0-9]+(?:[.,][0-9]+)*')) AS na, list_distinct(regexp_extract_all(y, '[0-9]+(?:[.,][0-9]+)*')) AS ne,
list_filter(list_transform(a, lambda t: lower(t)), lambda t: list_contains({_LATIN_UNITS}, t)) AS ua, list_filter(list_transform(e, lambda t: lower(t)), lambda t: list_contains({_LATIN_UNITS}, t)) AS ue,
regexp_extract_all(regexp_replace(x, '[\x{{00C0}}-\x{{024F}}]', '_', 'g'), '\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\b') AS ma, regexp_extract_all(regexp_replace(y, '[\x{{00C0}}-\x{{024F}}]', '_', 'g'), '\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\b') AS me,
list_distinct(list_filter(a, lambda t: length(t) > 1)) AS ca, list_distinct(list_filter(e, lambda t: length(t) > 1)) AS ce FROM n),
o AS (SELECT *, len(list_filter(ca, lambda t: list_contains(ce, t))) AS shared, list_sort(list_filter(ca, lambda t: NOT list_contains(ce, t) AND NOT regexp_full_match(t, '[0-9]+([.,][0-9]+)*'))) AS oa, list_sort(list_filter(ce, lambda t: NOT list_contains(ca, t) AND NOT regexp_full_match(t, '[0-9]+([.,][0-9]+)*'))) AS oe FROM s),
c AS (SELECT *, len(a) >= 4 AND len(e) >= 4 AND shared >= 2 AND shared >= 0.6 * len(ca) AND len(oa) BETWEEN 1 AND 2 AND len(oe) >= 1 AS swapped FROM o),
f AS (SELECT *, len(ye) > 0 AND len(list_filter(ya, lambda t: NOT list_contains(ye, t))) > 0 AS f_date,
len(list_filter(ne, lambda t: NOT list_contains(ye, t))) > 0 AND len(list_filter(na, lambda t: NOT list_contains(ya, t) AND NOT (list_contains(ne, t) AND NOT list_contains(ye, t)))) > 0 AS f_numeral,
len(ue) > 0 AND len(list_filter(ua, lambda t: NOT list_contains(ue, t))) > 0 AS f_unit, swapped OR (len(me) > 0 AND len(list_filter(ma, lambda t: NOT contains(y, t))) > 0) AS f_entity FROM c)"""

QUERIES = {f.__name__: f for f in (veto_categories, veto_cap, stems, question_classes, span_classes, veto_turns, veto_feature_turns)}
ORACLES = {
    "veto_categories": _values([(p[0], p[3]) for p in PAIRS], ("name", "fired")),
    "veto_cap": _values([(p[0], 0.15 if p[3] else 0.99) for p in PAIRS], ("name", "support")).replace("SELECT *", "SELECT name, CAST(support AS DOUBLE) AS support"),
    "stems": _values([("উদ্ভিদের", "উদ্ভিদ"), ("উদ্ভিদগুলোর", "উদ্ভিদ"), ("পাতা", "পাতা")], ("t", "stem")),
    "question_classes": _values(QUESTIONS, ("q", "kind", "route")),
    "span_classes": _values([(s, k, "T" if f else "F") for s, k, f in SPANS], ("span", "kind", "fits")).replace("SELECT *", "SELECT span, kind, fits = 'T' AS fits"),
    "veto_turns": f"WITH {_SIDES} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN f_date THEN 'date' END, CASE WHEN f_numeral THEN 'numeral' END, CASE WHEN f_unit THEN 'unit' END, CASE WHEN f_entity THEN 'entity' END], lambda t: t IS NOT NULL), ',') AS fired, CASE WHEN swapped THEN oa[1] END AS said, CASE WHEN swapped THEN list_sort(list_filter(oe, lambda t: length(t) = list_max(list_transform(oe, lambda u: length(u)))))[1] END AS stands FROM f",
    "veto_feature_turns": f"WITH {_SIDES} SELECT conv_id, turn, CAST(f_numeral AS DOUBLE) AS veto_numeral, CAST(f_date AS DOUBLE) AS veto_date, CAST(f_unit AS DOUBLE) AS veto_unit, CAST(f_entity AS DOUBLE) AS veto_entity, CAST(0 AS DOUBLE) AS veto_polarity, CAST(0 AS DOUBLE) AS veto_relation_order, CAST(f_numeral OR f_date OR f_unit OR f_entity AS DOUBLE) AS veto_any, CAST(f_numeral AS DOUBLE) + CAST(f_date AS DOUBLE) + CAST(f_unit AS DOUBLE) + CAST(f_entity AS DOUBLE) AS veto_count, CAST(1 AS DOUBLE) AS polarity_match, CAST(len(ya) > 0 AND len(list_filter(ya, lambda t: NOT list_contains(ye, t))) = 0 AS DOUBLE) AS year_in_evidence, CAST(len(ya) > 0 AS DOUBLE) AS answer_has_year, CAST(len(na) > 0 AND len(list_filter(na, lambda t: NOT list_contains(ne, t))) = 0 AS DOUBLE) AS nums_in_evidence, CAST(len(na) > 0 AS DOUBLE) AS answer_has_number FROM f",
}
