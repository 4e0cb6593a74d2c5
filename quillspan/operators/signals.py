"""Signals of support for an answer, their features, and the chain from signals to a decision.

All are column expressions over one row an answer, but for consistency and ensemble, which compare an
answer with the other answers to its question (as many as passages or bags are read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as L, text as T, veto as V

SIGNALS = ("s1_reader", "s2_grounding", "s3_support", "s4_consistency", "s5_ensemble")
NEUTRAL = 0.5
#: Passed to the reader as what is correct enough (tier 2 of the metric ladder).
CORRECT = 0.6


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def squash(c: Column) -> Column:
    """A signed margin in 0 to 1, one half at 0."""
    return 0.5 * (1 + c / (1 + F.abs(c)))


def reader(score: Column, margin: Column, null_margin: Column, text: Column) -> Column:
    """S1; 0 without an answer."""
    s = clip(0.55 * score + 0.30 * F.greatest(margin, F.lit(0.0)) + 0.15 * squash(null_margin))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(s)


def containment(answer, evidence, classes: Column | None = None) -> Column:
    """Share of the answer's content words (of all its words, if it has none) that the evidence has, as they
    are, by their stems, or through a map from words to the class of their synonyms."""
    v = F.struct(T.tokenize_lower(answer).alias("a"), T.tokenize_lower(evidence).alias("e"))
    stop = V._among(sorted(set(L.STOPWORDS) - set(L.VETO_SAFE)))

    def share(v: Column) -> Column:
        own = F.filter(v["a"], lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1))
        forms = F.struct(F.when(F.size(own) > 0, own).otherwise(v["a"]).alias("a"), v["e"].alias("e"), F.transform(v["e"], lambda t: V.stem(t)).alias("s"))

        def hits(f: Column) -> Column:
            known = lambda t: F.array_contains(f["e"], t) | F.array_contains(f["s"], V.stem(t))
            if classes is not None:
                kinds = F.transform(f["e"], lambda t: F.try_element_at(classes, t))
                plain = known
                known = lambda t: plain(t) | F.coalesce(F.array_contains(kinds, F.try_element_at(classes, t)), F.lit(False))
            return F.when(F.size(f["a"]) == 0, 0.0).otherwise(F.size(F.filter(f["a"], known)) / F.size(f["a"]))

        return T.let(forms, hits)

    return T.let(v, share)


def grounding(contained: Column, cosine: Column, literal: Column, fired: Column, text: Column) -> Column:
    """S2: a weighted overlap, but the cap where a check fires and 0 without an answer."""
    s = clip(0.6 * contained + 0.2 * cosine + 0.2 * literal.cast("double"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(F.size(fired) > 0, V.CAP).otherwise(s)


def agreement(a, b) -> Column:
    """1 for texts that are equal but for case and outer blanks, else their trigram cosine."""
    x, y = F.lower(F.trim(T.col(a))), F.lower(F.trim(T.col(b)))
    return F.when(x == y, 1.0).otherwise(T.trigram_cosine(x, y))


def consistency(answers: DataFrame, key: list[str], pid: str, text: str) -> DataFrame:
    """key, pid, s4: agreement of each answer with those that other passages gave to its question, 0.6 of the best
    and 0.4 of the mean; NEUTRAL without others. One answer a passage, so as many pairs as passages were read."""
    a = answers.select(*key, pid, F.coalesce(text, F.lit("")).alias("_x"))
    b = answers.select(*key, F.col(pid).alias("_p"), F.coalesce(text, F.lit("")).alias("_y")).filter("_y <> ''")
    pairs = a.filter("_x <> ''").join(b, key).filter(F.col(pid) != F.col("_p")).withColumn("_s", agreement("_x", "_y"))
    s = pairs.groupBy(*key, pid).agg(clip(0.6 * F.max("_s") + 0.4 * F.avg("_s")).alias("s4"))
    return a.select(*key, pid).join(s, [*key, pid], "left").select(*key, pid, F.coalesce("s4", F.lit(NEUTRAL)).alias("s4"))


def ensemble(chosen: DataFrame, bags: DataFrame, key: str) -> DataFrame:
    """key, s5: share of the bags that chose the pid and start that the answer has; NEUTRAL without bags."""
    both = chosen.select(key, F.col("pid").alias("_p"), F.col("start").alias("_s")).join(bags.select(key, "pid", "start"), key, "left")
    same = F.avg(((F.col("pid") == F.col("_p")) & (F.col("start") == F.col("_s"))).cast("double"))
    return both.groupBy(key).agg(F.coalesce(same, F.lit(NEUTRAL)).alias("s5"))


def components(answer, evidence, score: Column, margin: Column, null_margin: Column, passage_score: Column, passage_rank: Column, s3: Column, s4: Column, s5: Column) -> Column:
    """struct of the 29 features of the fusion: signals, their parts, the checks' flags, and lengths."""
    a, e = T.col(answer), T.col(evidence)
    parts = F.struct(V.check(a, e).alias("f"), containment(a, e).alias("c"), T.trigram_cosine(a, e).alias("t"), ((a != "") & F.contains(e, a)).alias("l"), V.features(a, e).alias("v"), F.size(T.tokenize_lower(a)).cast("double").alias("na"), F.size(T.tokenize_lower(e)).cast("double").alias("ne"))

    def made(p: Column) -> Column:
        names = [*[f"veto_{c}" for c in V.CATEGORIES], "veto_any", "veto_count", "polarity_match", "year_in_evidence", "answer_has_year", "nums_in_evidence", "answer_has_number"]
        return F.struct(
            reader(score, margin, null_margin, a).alias("s1_reader"), grounding(p["c"], p["t"], p["l"], p["f"], a).alias("s2_grounding"), s3.alias("s3_support"), s4.alias("s4_consistency"), s5.alias("s5_ensemble"),
            score.alias("s1_score"), margin.alias("s1_margin"), null_margin.alias("s1_null_margin"), passage_score.alias("s1_passage_score"), (1 / (1 + passage_rank)).alias("s1_passage_rank_inv"),
            p["c"].alias("s2_containment"), p["t"].alias("s2_trigram_cos"), p["l"].cast("double").alias("s2_literal"), (F.size(p["f"]) > 0).cast("double").alias("s2_veto_fired"),
            *[p["v"][n].alias(n) for n in names], p["na"].alias("answer_tokens"), p["ne"].alias("evidence_tokens"),
        )

    return T.let(parts, made)


def confidence(signals: list[Column], fired: Column, fused: Column | None = None, calibrated=None) -> Column:
    """Fused (the mean of the signals without a model), then calibrated, then capped, in this order."""
    raw = sum(signals[1:], signals[0]) / len(signals) if fused is None else fused
    return V.capped(calibrated(raw) if calibrated else raw, fired)


def yes_no(route: Column, fired: Column) -> Column:
    """Of yes/no questions: no where the polarity of answer and evidence conflict, else yes; null for others."""
    return F.when(route == "polarity", F.when(F.array_contains(fired, "polarity"), L.NO).otherwise(L.YES))


def decision(confidence: Column, tau: Column, fired: Column, policy: str = "fused_veto", feasible: Column | None = None) -> Column:
    """struct(answered, reason) of one of the four policies; no passage (null confidence) abstains in each."""
    bar = tau if policy != "conformal" or feasible is None else F.when(feasible, tau).otherwise(NEUTRAL)
    vetoed = (F.size(fired) > 0) if policy in ("fused_veto", "conformal") else F.lit(False)
    low = F.lit(False) if policy == "always" else confidence < bar
    reason = F.when(confidence.isNull(), "no passages").when(vetoed, F.concat(F.lit("veto: "), F.array_join(fired, ","))).when(low, "below threshold").otherwise("answered")
    return F.struct((reason == "answered").alias("answered"), reason.alias("reason"))
