"""Reader: top sentences of the passages read, candidate spans of these, their features.

hits: qid, pid, passage_rank, passage_score, text (normalised), question, kind (the class of the answer asked
for). All is by (qid, pid), and a passage is bounded, so no group grows with the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T, veto as V
from . import spans as P

TOP, LONGEST = 3, 12


def _weights(hits: DataFrame) -> DataFrame:
    """qid, q (content words of the question), idf (map of the working-set idf of all words read or asked)."""
    asked = hits.select("qid", "question").distinct().select("qid", F.array_distinct(F.filter(T.tokenize_lower("question"), lambda t: ~F.array_contains(V._among(sorted(set(L.STOPWORDS) - set(L.VETO_SAFE))), t) & (F.length(t) > 1))).alias("q"))
    read = hits.select("qid", F.col("pid").alias("doc_id"), T.tokenize_lower("text").alias("tokens"))
    n = read.groupBy("qid").agg(F.count("*").alias("n"))
    terms = asked.select("qid", F.explode("q").alias("term"))
    # The words of the passages read, which are bounded, and those of the question that none of them has.
    every = P.working_idf(read).join(terms, ["qid", "term"], "full").join(n, "qid")
    w = every.select("qid", F.struct("term", F.coalesce("idf", F.ln(1 + (F.col("n") + 0.5) / 0.5)).alias("idf")).alias("e")).groupBy("qid").agg(F.map_from_entries(F.collect_list("e")).alias("idf"))
    return asked.join(w, "qid", "left")


def _weight(words: Column, idf: Column) -> Column:
    return F.aggregate(F.array_sort(words), F.lit(0.0), lambda s, t: s + F.try_element_at(idf, t))


SENTENCE = ["qid", "pid", "s_start"]


def top_sentences(hits: DataFrame, top: int = TOP) -> DataFrame:
    """hits with q, idf, sentence, s_start, s_end, words (of the sentence), cos_q_sentence, sentence_score, sentence_rank: of each
    passage the ``top`` sentences with most of the question's weight and trigrams, earlier ones first among equals."""
    # Little data, much work a row: dealt out by number, else small partitions would be put together again.
    context = hits.sparkSession.sparkContext
    parts = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism)
    s = hits.join(_weights(hits), "qid").repartition(parts, "qid", "pid").select("*", F.posexplode(T.sentence_spans("text")).alias("_i", "s"))
    s = s.withColumns({"sentence": F.col("s.sentence"), "s_start": F.col("s.start"), "s_end": F.col("s.end"), "words": T.tokenize_lower("s.sentence")}).drop("s")
    all_q = _weight(F.col("q"), F.col("idf"))
    lexical = _weight(F.array_intersect("q", "words"), F.col("idf")) / F.when(all_q == 0, 1.0).otherwise(all_q)
    s = s.withColumns({"cos_q_sentence": T.trigram_cosine("question", "sentence"), "_l": F.coalesce(lexical, F.lit(0.0))}).withColumn("sentence_score", F.col("_l") + F.col("cos_q_sentence"))
    w = Window.partitionBy("qid", "pid").orderBy(F.desc(F.round("sentence_score", 9)), "_i")
    return s.withColumn("sentence_rank", F.row_number().over(w)).filter(F.col("sentence_rank") <= top).drop("_i", "_l")


def candidates(sentences: DataFrame, longest: int = LONGEST) -> DataFrame:
    """qid, pid, s_start, kind, start, end (in the passage), tokens, text: runs of 1 to ``longest`` tokens that are not stopwords
    only and fit the class, and for reasons and processes whole clauses; of equal texts in a passage the first by sentence,
    clauses first, then start, then length."""
    stop = V._among(sorted(set(L.STOPWORDS) - set(L.VETO_SAFE)))
    clauses = F.when(F.col("kind").isin("REASON", "PROCESS"), F.transform(T.clauses("sentence"), lambda c: F.struct(F.size(T.tokenize(c)).alias("tokens"), c.alias("text"))))
    # A passage has its sentences in one row, so that its candidates are told apart where they are made.
    rows = sentences.groupBy("qid", "pid").agg(F.sort_array(F.collect_list(F.struct("sentence_rank", "s_start", "kind", "sentence", clauses.alias("clauses")))).alias("s"))
    ids = ", ".join(f"{c} {sentences.schema[c].dataType.simpleString()}" for c in ("qid", "pid"))
    one = rows.mapInArrow(_spans(longest, set(L.STOPWORDS) - set(L.VETO_SAFE)), f"{ids}, s_start int, kind string, start int, end int, tokens int, text string, _a boolean")
    alive = F.exists(T.tokenize_lower("text"), lambda t: ~F.array_contains(stop, t)) & V.span_matches_class("text", F.col("kind"))
    # Judged once a text: what does not fit goes after the texts are told apart, since equal ones fare alike.
    return one.filter(F.when(F.col("_a").isNotNull(), F.col("_a")).otherwise(alive)).drop("_a")


def _spans(longest: int, stop: set):
    """Candidates of passages, with _a: whether they fit, null where that takes a closer look (a class that asks for more than
    length, or letters whose normal form a part of the sentence may have otherwise)."""
    import re

    token, odd = re.compile(T.TOKEN), re.compile("[^\\x00-\u08ff]|[\xa0\u0130]")

    def made(passage: list[dict]) -> dict:
        best = {}
        for s in passage:
            text, at, kind = s["sentence"], s["s_start"], s["kind"]
            for start, tokens, part in sorted((text.find(c["text"]), c["tokens"], c["text"]) for c in s["clauses"] or ()):
                best.setdefault(part.lower(), (at, kind, at + start, at + start + len(part), tokens, part, True))
            found = [m.span() for m in token.finditer(text)]
            live = [text[a:b].lower() not in stop for a, b in found]
            plain = kind not in ("TIME", "NUMBER", "PERSON", "PLACE") and not odd.search(text)
            least = 3 if kind in ("REASON", "PROCESS") else 1
            low = text.lower()
            low = low if len(low) == len(text) else None
            for i, (a, _) in enumerate(found):
                some = False
                for k, (_, b) in enumerate(found[i : i + longest]):
                    some = some or live[i + k]
                    name = low[a:b] if plain and low else text[a:b].lower()
                    if name not in best:
                        best[name] = (at, kind, at + a, at + b, k + 1, text[a:b], some and k + 1 >= least if plain else None)
        return best

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        names = ["qid", "pid", "s_start", "kind", "start", "end", "tokens", "text", "_a"]
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [list(made(p).values()) for p in part.column(2).to_pylist()]
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                flat = list(zip(*[x for f in found for x in f])) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *[pa.array(c, t) for c, t in zip(flat, kinds)]], names=names)

    return run


def gold_rows(found: DataFrame, gold: DataFrame) -> DataFrame:
    """found with is_gold: whether (qid, pid, start, end) is that of a gold span; by offsets, not by text."""
    g = gold.select("qid", "pid", "start", "end").distinct().withColumn("_g", F.lit(True))
    return found.join(g, ["qid", "pid", "start", "end"], "left").withColumn("is_gold", F.coalesce("_g", F.lit(False))).drop("_g")


def sampled_negatives(rows: DataFrame, most: int = 40, seed: int = 7) -> DataFrame:
    """All gold rows, and of each question ``most`` others by a hash."""
    w = Window.partitionBy("qid", "is_gold").orderBy(F.xxhash64(F.lit(seed), "qid", "pid", "start", "end"), "pid", "start", "end")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("is_gold") | (F.col("_n") <= most)).drop("_n")


def min_distance(sentence: Column, span: Column, matched: Column) -> Column:
    """1 / (1 + tokens from the span's first token, where it first occurs, to the nearest matched word); 0 without either."""

    def near(v: Column) -> Column:
        at = F.array_position(v["s"], F.get(v["p"], F.lit(0))) - 1
        gaps = F.filter(F.transform(v["s"], lambda t, i: F.when(F.array_contains(v["m"], t), F.abs(i - at))), lambda g: g.isNotNull())
        return F.when((F.size(v["p"]) == 0) | (at < 0) | (F.size(gaps) == 0), 0.0).otherwise(1 / (1 + F.array_min(gaps)))

    return T.let(F.struct(sentence.alias("s"), span.alias("p"), matched.alias("m")), near)


def type_prior(question_type: Column, kind: Column, tokens: Column) -> Column:
    """How well a span's length fits what such a question is usually answered with."""
    usual = F.when(question_type == "confirmation", 1.0).when(question_type == "list", 3.0).when(question_type == "causal", 8.0).otherwise(2.5)
    fits = F.when(kind.isin("REASON", "PROCESS"), F.greatest(usual, F.lit(8.0))).when(kind.isin("TIME", "NUMBER"), 1.5).when(kind.isin("PERSON", "PLACE", "THING"), 2.5).otherwise(usual)
    return F.exp(-F.abs(tokens - fits) / F.greatest(fits, F.lit(1.0)))


def features(found: DataFrame, sentences: DataFrame, question_type: str = "factoid") -> DataFrame:
    """found with the 31 numbers that a span ranker learns from. What a sentence decides is computed once for it."""
    one = lambda c: c.cast("double")
    stop = V._among(sorted(set(L.STOPWORDS) - set(L.VETO_SAFE)))
    all_q, m = _weight(F.col("q"), F.col("idf")), F.array_intersect("q", "words")
    s = sentences.withColumns({"_m": m, "_a": T.tokenize_lower("question"), "_t": T.char_trigrams("question"), "_w": F.when(all_q == 0, 1.0).otherwise(all_q)}).select(
        *SENTENCE, "sentence", "idf", "words", "_m", "_a", "_t", "cos_q_sentence", (1 / (1 + F.col("passage_rank"))).alias("passage_rank_inv"), one(F.col("passage_score")).alias("passage_score_f"), (1 / (1 + F.col("sentence_rank"))).alias("sentence_rank_inv"),
        F.coalesce(_weight(F.col("_m"), F.col("idf")) / F.col("_w"), F.lit(0.0)).alias("sent_idf_overlap"), (F.size("_m") / F.greatest(F.size(F.array_distinct("words")), F.lit(1))).alias("sent_overlap_frac"), (F.size("_m") / F.greatest(F.size("q"), F.lit(1))).alias("q_content_matched_frac"), one(F.arrays_overlap("words", V._among(L.DIRECTION[:3]))).alias("relation_order_flag"),
    )
    f = found.join(s, SENTENCE).withColumn("_p", T.tokenize_lower("text"))
    idf = lambda t: F.coalesce(F.try_element_at("idf", t), F.lit(0.0))
    n = F.size("_p")
    inside = F.left(F.col("sentence"), F.greatest(F.col("start") - F.col("s_start"), F.lit(0)))
    count = lambda ch: F.length(inside) - F.length(F.replace(inside, F.lit(ch)))
    kinds = (("time", ("TIME",)), ("number", ("NUMBER",)), ("person", ("PERSON",)), ("place", ("PLACE",)), ("clause", ("REASON", "PROCESS")))
    cosine = T.let(F.struct(F.col("_t").alias("x"), T.char_trigrams("text").alias("y")), lambda v: F.when((F.size(v["x"]) == 0) | (F.size(v["y"]) == 0), 0.0).otherwise(F.size(F.array_intersect(v["x"], v["y"])) / F.sqrt(F.size(v["x"]).cast("double") * F.size(v["y"]))))
    made = {
        "min_dist_to_match": min_distance(F.col("words"), F.col("_p"), F.col("_m")), "span_tokens": one(n), "span_chars": one(F.length("text")), "span_idf_mean": F.aggregate("_p", F.lit(0.0), lambda s, t: s + idf(t)) / F.greatest(n, F.lit(1)), "span_idf_max": F.coalesce(F.array_max(F.transform("_p", idf)), F.lit(0.0)),
        "is_numeral": one((n > 0) & F.forall("_p", V.is_number)), "is_year": one(F.size(V.years(F.col("_p"))) > 0), "has_latin": one(F.col("text").rlike("[A-Za-z]")), "has_digit": one(F.col("text").rlike("[0-9]")),
        "in_parentheses": one(count("(") > count(")")), "is_unit_bearing": one(F.arrays_overlap("_p", V._among(L.UNITS))), "class_match": one(V.span_matches_class("text", F.col("kind"))), **{f"class_is_{k}": one(F.col("kind").isin(*v)) for k, v in kinds},
        "type_prior_len": type_prior(F.lit(question_type), F.col("kind"), n), "cos_q_span": cosine, "span_pos_frac": (F.col("start") - F.col("s_start")) / F.greatest(F.length("sentence"), F.lit(1)),
        "span_in_question": one((n > 0) & (F.size(F.array_except("_p", "_a")) == 0)), "stopword_frac": F.size(F.filter("_p", lambda t: F.array_contains(stop, t))) / F.greatest(n, F.lit(1)), "starts_with_stopword": one(F.coalesce(F.array_contains(stop, F.get("_p", F.lit(0))), F.lit(False))),
    }
    return f.withColumns(made).drop("_p", "_a", "_m", "_t", "idf", "words")


FEATURES = ("sent_idf_overlap", "sent_overlap_frac", "q_content_matched_frac", "min_dist_to_match", "span_tokens", "span_chars", "span_idf_mean", "span_idf_max", "is_numeral", "is_year", "has_latin", "has_digit", "in_parentheses", "is_unit_bearing", "class_match", "class_is_time", "class_is_number", "class_is_person", "class_is_place", "class_is_clause", "type_prior_len", "cos_q_span", "cos_q_sentence", "passage_rank_inv", "passage_score_f", "sentence_rank_inv", "span_pos_frac", "relation_order_flag", "span_in_question", "stopword_frac", "starts_with_stopword")


def contained(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Spans (pid, start, end) with the sentence (pid, s_start, s_end) that contains them: a range join within a passage."""
    s, t = spans.alias("a"), sentences.alias("b")
    return s.join(t, (F.col("a.pid") == F.col("b.pid")) & (F.col("b.s_start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.s_end"))).select("a.*", "b.sentence", "b.s_start", "b.s_end")


def margins(scored: DataFrame, key: str = "qid") -> DataFrame:
    """key, best, second, margin, null_margin (the best over the median); scored: key, score."""
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    r = scored.select(key, "score", F.row_number().over(w).alias("_r"))
    a = r.groupBy(key).agg(F.max("score").alias("best"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"), F.median("score").alias("_m"))
    return a.select(key, "best", F.coalesce("second", F.lit(0.0)).alias("second"), (F.col("best") - F.coalesce("second", F.lit(0.0))).alias("margin"), (F.col("best") - F.col("_m")).alias("null_margin"))
