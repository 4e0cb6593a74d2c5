"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its token count and its LEAD leading tokens (tokens with a digit are variable:
<*>) to a leaf. A leaf holds several templates. Two distinct texts of a leaf are similar if they have one
token in a share of SIMILAR or more of the positions beyond the leading ones; how often a text recurs
counts for nothing. In turns, each key that several texts share (_keys) is led by one of them; a text
that is similar to leads belongs to the template of the most similar. Turns end when two of them find
nothing more. Up to SHORT positions all texts of a key are similar; of longer lines, a text is compared
with one lead a key and turn, so one that shares its keys with many unlike texts can stay alone. Other
lines are templates of their own. A template in MIN_DOCS or more documents recurs; its lines are
dropped. With keep_first the first of them (least doc_id, then least line) stays, so that groups of
copies, whose every line recurs, do not lose their content.

Lines of fewer than LEAD + 1 tokens are counted by their exact masked text. Lines of fewer than
min_tokens tokens are kept: masked, one token makes all numbers one line. Only hashes and counts are
shuffled; texts are read again and filtered by line number.

Cases: a null text stays null, an empty one empty; repeated rows with one doc_id and text are one
document and get the same result; a null doc_id comes first; a document may end empty, but no row
is dropped; an empty table gives none. Very long texts and lines are split in one pass, and what they
lose is taken out in one more. Other columns stay as they are, whatever their names; where one is
called n_lines or n_dropped, that count is not added.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .store import discard, release, written

LEAD = 3
MIN_TOKENS = 2
MIN_DOCS = 3
SIMILAR = 0.6
SHORT = 7


def _lines(documents: DataFrame, min_tokens: int) -> DataFrame:
    """doc_id, th, line (number), masked: lines of min_tokens tokens or more, variable tokens masked."""
    # Cleaned and masked once a text, before it is cut into lines: no filter then repeats that work.
    # Most texts have nothing to clean or to mask, which is told without the costly pattern.
    spaced = F.lit(False)
    for c in ("\t", "\r", "\f", "  "):
        spaced = spaced | F.contains("text", F.lit(c))
    clean = F.when(spaced, F.regexp_replace("text", r"[ \t\r\f]+", " ")).otherwise(F.col("text"))
    masked = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace(clean, r"(?<![^ \n])[^ 0-9\n]*+[0-9][^ \n]*+", "<*>")).otherwise(clean)
    rows = documents.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode_outer(F.split(masked, "\n")).alias("line", "masked")).filter("masked is not null")
    rows = rows.withColumn("masked", F.trim("masked"))
    return rows.withColumn("n", F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "))) + 1).filter(F.col("n") >= min_tokens)


def _hashed(lines: DataFrame) -> DataFrame:
    """mh (the whole line), leaf, and toks: a hash of each token beyond the LEAD leading ones, null for lines that have too few of them to differ."""
    rows = lines.withColumns({"mh": F.xxhash64("masked"), "leaf": F.xxhash64("n", F.substring_index("masked", " ", LEAD))})
    toks = F.expr(f"transform(slice(split(masked, ' '), {LEAD + 1}, n - {LEAD}), w -> hash(w))")
    return rows.withColumn("toks", F.when(_asked(F.col("n") - LEAD) < F.col("n") - LEAD, toks))


def _asked(m: Column) -> Column:
    """The least number of m positions that is a share of SIMILAR."""
    return F.ceil(m * SIMILAR - 1e-9).cast("int")


def _keys(m: Column) -> Column:
    """What similar texts share: each choice of as many positions as are asked, or, of more than SHORT positions, stretches one more than may differ."""
    sets = F.array(*[F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(k), math.ceil(k * SIMILAR - 1e-9))]) for k in range(3, SHORT + 1)])
    chosen = F.transform(F.element_at(sets, m - 2), lambda c: F.xxhash64("leaf", c, F.transform(c, lambda i: F.get("toks", i))))

    def stretches(d: Column) -> Column:
        at = lambda k: F.floor(k * m / (d + 1)).cast("int")
        return F.transform(F.sequence(F.lit(0), d), lambda k: F.xxhash64("leaf", k, F.slice("toks", at(k) + 1, at(k + 1) - at(k))))

    return F.when(m <= SHORT, chosen).otherwise(stretches(m - _asked(m)))


def _templates(lines: DataFrame) -> DataFrame:
    """mh, template: the lines that belong to a template of more than one text."""
    full = lines.filter("toks is not null")
    # Leaves are told apart by counts alone; tokens are shuffled only for leaves that hold several texts.
    counted = full.groupBy("leaf", "mh").agg(F.count("*").alias("rows"))
    varied = counted.groupBy("leaf").agg(F.count("*").alias("texts"), F.sum("rows").alias("leaf_rows")).filter((F.col("texts") > 1) & (F.col("leaf_rows") >= MIN_DOCS)).select("leaf")
    texts = full.join(written(varied), "leaf").groupBy("leaf", "mh").agg(F.first("toks").alias("toks"))
    texts = written(texts.select("leaf", "mh", "toks", F.lit(False).alias("is_lead")))
    found, turn, quiet = texts.select("mh", F.col("mh").alias("template")).limit(0), 0, 0
    while quiet < 2:
        # Leads come first in every other turn; else the order is the turn's own, so that no text stands before others for good.
        order = F.xxhash64("mh", F.lit(turn)).bitwiseAND(F.lit((1 << 62) - 1))
        order = order if turn % 2 else F.when(F.col("is_lead"), -1 - order).otherwise(order)
        keys = texts.select("mh", "is_lead", order.alias("order"), F.explode(_keys(F.size("toks"))).alias("key"))
        heads = keys.groupBy("key").agg(F.count("*").alias("n"), F.min_by("mh", "order").alias("lead")).filter("n > 1").select("key", "lead")
        pairs = written(keys.join(heads, "key").groupBy("mh", "lead").agg(F.max("is_lead").alias("is_lead")))
        a, b = texts.select("mh", "toks"), texts.select(F.col("mh").alias("lead"), F.col("toks").alias("lead_toks"))
        alike = F.aggregate(F.zip_with("toks", "lead_toks", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        links = written(pairs.filter("mh <> lead and not is_lead").join(a, "mh").join(b, "lead").withColumn("alike", alike).filter(F.col("alike") >= _asked(F.size("toks"))).select("mh", "lead", "alike"))
        # A text that follows another leads none in this turn: its followers look again in the next.
        own = links.join(links.select(F.col("mh").alias("lead")).distinct(), "lead", "left_anti")
        new = own.groupBy("mh").agg(F.max(F.struct("alike", "lead")).alias("x")).select("mh", F.col("x.lead").alias("template"))
        # Of any chain of links, the texts at its end follow a lead that follows none.
        quiet, turn = quiet + 1 if links.isEmpty() else 0, turn + 1
        found = found.unionByName(new)
        leads = new.select(F.col("template").alias("mh"), F.lit(True).alias("now")).distinct()
        # A text that shares no key with another can follow none in a later turn.
        left = pairs.select("mh").distinct().join(new, "mh", "left_anti").join(leads, "mh", "left")
        texts = written(texts.join(left, "mh").select("leaf", "mh", "toks", (F.col("is_lead") | F.coalesce("now", F.lit(False))).alias("is_lead")))
        release(lines.sparkSession)
    return found.unionByName(found.select("template", "template").distinct().toDF("mh", "template"))


def recurring_lines(documents: DataFrame, keep_first: bool = False, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, th, drop: the numbers of the lines to drop in each document that has any."""
    lines = written(_hashed(_lines(documents, min_tokens)).select("doc_id", "th", "line", "mh", "leaf", "toks"))
    found = written(_templates(lines))
    release(documents.sparkSession)
    keyed = lines.join(found, "mh", "left").select("doc_id", "th", "line", F.coalesce("template", "mh").alias("template"))
    docs = keyed.groupBy("template", "doc_id", "th").agg(F.min("line").alias("line"))
    first = F.struct("doc_id", "th", "line")
    rec = docs.groupBy("template").agg(F.count("*").alias("docs"), F.min(first).alias("first")).filter(F.col("docs") >= MIN_DOCS)
    # Written, so that the join below has two dealt sides and a very common template can be split.
    rec = written(rec.select("template", "first"))
    gone = keyed.join(rec, "template")
    if keep_first:
        gone = gone.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("line") == F.col("first.line"))))
    out = written(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("drop")))
    discard(lines, found, rec)
    release(documents.sparkSession)
    return out


def drop_recurring(documents: DataFrame, keep_first: bool = False, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """documents with the recurring lines out of their texts; n_lines and n_dropped added."""
    # A merge join at every size: the list of lines to drop grows with the corpus.
    drop = recurring_lines(documents.select("doc_id", "text"), keep_first, min_tokens).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("drop").alias("__drop")).hint("merge")
    here = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    out = documents.join(drop, here, "left")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    lost = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")
    # The parts are an argument of the outer function, so they are split once a text.
    kept = F.transform(F.array(F.split("text", "\n")), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop")), lambda i: parts[i]), "\n"))[0]
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)
    added = [c.alias(n) for n, c in (("n_lines", count), ("n_dropped", lost)) if n not in documents.columns]
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in documents.columns], *added)
