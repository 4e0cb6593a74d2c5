"""Answer spans: candidates, working-set idf, ranking, alignment, receipts, chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, veto as V

LONGEST = 12


def candidates(sentences: DataFrame, key: list[str], sentence: str = "sentence", longest: int = LONGEST) -> DataFrame:
    """key, start, end, tokens, text: every run of 1 to ``longest`` tokens; offsets in the sentence, never found again by text."""
    runs = T.let(T.token_spans(sentence), lambda t: F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 1, F.lit(longest)), lambda y, k: F.struct(x["start"].alias("start"), y["end"].alias("end"), (k + 1).alias("tokens"))))))
    s = sentences.select(*key, F.col(sentence).alias("_s"), F.explode(runs).alias("r"))
    return s.select(*key, "r.start", "r.end", "r.tokens", F.substring(F.col("_s"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("text"))


def working_idf(hits: DataFrame) -> DataFrame:
    """qid, term, idf = ln(1 + (n + .5) / (df + .5)) over the passages retrieved for each question; hits: qid, doc_id, tokens."""
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    df = hits.select("qid", F.explode_outer(F.array_distinct("tokens")).alias("term")).filter("term is not null").groupBy("qid", "term").agg(F.count("*").alias("df"))
    return df.join(n, "qid").select("qid", "term", F.ln(1 + (F.col("n") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def ranked(scored: DataFrame, by: str, tie: list[str]) -> DataFrame:
    """scored with share (softmax of score within ``by``), rank, and the margin of the best over the second."""
    w = Window.partitionBy(by)
    top = F.max("score").over(w)
    share = F.exp(F.col("score") - top)
    out = scored.withColumn("share", share / F.sum(share).over(w))
    o = w.orderBy(F.desc("score"), *tie)
    return out.withColumns({"rank": F.row_number().over(o), "margin": F.col("share") - F.lead("share", 1, 0.0).over(o)})


def without_overlaps(spans: Column) -> Column:
    """Greedy choice from array<struct<score,start,end>>, best first: a span that overlaps a chosen one falls out."""
    best_first = F.reverse(F.array_sort(spans))
    return F.aggregate(best_first, F.array().cast("array<struct<score:double,start:int,end:int>>"), lambda kept, x: F.when(F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), kept).otherwise(F.concat(kept, F.array(x))))


def align(passage, answer) -> Column:
    """struct(start, end, method) in the passage as stored (normalised text): as it is, then the normalised answer,
    then with any white space between its words; null if none fits (see align_fuzzy)."""
    p, a = T.col(passage), T.col(answer)

    def placed(v: Column) -> Column:
        p, a, n = v["p"], v["a"], v["n"]
        found = lambda at, size, m: F.struct((at - 1).alias("start"), (at - 1 + size).alias("end"), F.lit(m).alias("method"))
        exact, normal = F.call_function("locate", a, p), F.call_function("locate", n, p)
        words = F.filter(F.split(n, r"\s+"), lambda w: w != "")
        pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
        # What stands before the first match is what a split at it leaves; no second look by text.
        spaced = F.regexp_substr(p, pattern)
        before = F.length(F.call_function("split", p, pattern, F.lit(2))[0])
        out = F.when((a == "") | (p == ""), None).when(exact > 0, found(exact, F.length(a), "exact")).when((normal > 0) & (n != ""), found(normal, F.length(n), "normalized"))
        return out.when((F.size(words) > 0) & spaced.isNotNull(), F.struct(before.alias("start"), (before + F.length(spaced)).alias("end"), F.lit("whitespace").alias("method")))

    return T.let(F.struct(p.alias("p"), a.alias("a"), T.normalize(a).alias("n")), placed)


def align_fuzzy(passage, answer, least: float = 0.9) -> Column:
    """struct(start, end, method) of the first window of the answer's length most like it, null below ``least``.

    Windows start at each place from a span before to one after up to 64 finds of the three longest words of three
    characters or more. For what align() leaves; Arrow batches, since the ratio has no native form."""

    @F.pandas_udf("start int, end int, method string")
    def run(p: pd.Series, a: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        out = []
        for text, want in zip(p, a):
            text, want, places, best = text or "", want or "", [], (0.0, None)
            for word in sorted(dict.fromkeys(want.split()), key=len, reverse=True)[:3]:
                at = text.find(word) if len(word) >= 3 else -1
                while at >= 0 and len(places) < 64:
                    places.append(at)
                    at = text.find(word, at + 1)
            if len(want) >= 4:
                match = SequenceMatcher(None, "", want)
                for at in sorted({x for q in places for x in range(max(0, q - len(want)), min(len(text) - 1, q + 1))}):
                    match.set_seq1(text[at : at + len(want)])
                    if match.real_quick_ratio() > best[0] and match.quick_ratio() > best[0] and match.ratio() > best[0]:
                        best = (match.ratio(), at)
            out.append((best[1], min(len(text), best[1] + len(want)), "fuzzy") if best[1] is not None and best[0] >= least else (None, None, None))
        return pd.DataFrame(out, columns=["start", "end", "method"]).astype({"start": "Int32", "end": "Int32"})

    return run(T.col(passage), T.col(answer))


def align_parts(rows: DataFrame, passage: str = "text", answer: str = "answer", kind: str = "answer_type") -> DataFrame:
    """rows with part (from 0), gold_text, text, start, end, method: answers of several spans are parted at ``;``, and
    text is the passage's own, so it differs from the gold where white space does."""
    several = F.filter(F.transform(F.split(answer, ";"), lambda x: F.trim(x)), lambda p: p != "")
    parts = F.when((F.col(kind) == "multiple spans") & (F.size(several) > 1), several).otherwise(F.array(F.trim(answer)))
    r = rows.select("*", F.posexplode(parts).alias("part", "gold_text")).filter("gold_text <> ''").withColumn("_h", align(passage, "gold_text"))
    own = F.substring(F.col(passage), F.col("_h.start") + 1, F.col("_h.end") - F.col("_h.start"))
    return r.withColumns({"text_": F.coalesce(own, "gold_text"), "start": F.col("_h.start"), "end": F.col("_h.end"), "method": F.col("_h.method")}).drop("_h")


def alignment_counts(aligned: DataFrame, kind: str = "answer_type") -> DataFrame:
    """kind, n, strict (exact or normalised), any: how many parts were found, by how."""
    strict = F.coalesce(F.col("method").isin("exact", "normalized"), F.lit(False))
    return aligned.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(strict).alias("strict"), F.count("method").alias("found"))


def length_matched(docs: DataFrame, lengths: list[int], key: str = "doc_id", keep: float = 0.85, seed: int = 7) -> DataFrame:
    """key, chunk, size, text: sentences are gathered until they reach a length drawn from ``lengths`` (a bounded list of
    gold lengths) for each chunk; a chunk below ``keep`` of it is dropped. One text at a time, in Arrow batches."""

    def made(batches):
        import zlib

        for b in batches:
            rows = []
            for k, sents in zip(b[key], b["sents"]):
                i = n = 0
                while i < len(sents):
                    want, buf, size = lengths[zlib.crc32(f"{seed}:{k}:{n}".encode()) % len(lengths)], [], 0
                    while i < len(sents) and size < want:
                        buf.append(sents[i])
                        size, i = size + len(sents[i]) + 1, i + 1
                    if size >= keep * want:
                        rows.append((k, n, size, " ".join(buf)))
                    n += 1
            yield pd.DataFrame(rows, columns=[key, "chunk", "size", "text"])

    return docs.select(key, T.sentences("text").alias("sents")).mapInPandas(made, f"{key} long, chunk int, size int, text string")


def chunks(docs: DataFrame, key: str = "doc_id", size: int = 150, overlap: int = 30) -> DataFrame:
    """key, chunk, n_tokens, digest: windows of ``size`` tokens that share ``overlap`` with the one before."""
    step = size - overlap
    t = docs.select(key, F.split(T.collapse_whitespace("text"), " ").alias("w")).filter("w[0] <> ''")
    t = t.select(key, "w", F.explode_outer(F.expr(f"sequence(0, greatest(size(w) - {overlap} - 1, 0) div {step})")).alias("chunk"))
    return t.select(key, "chunk", F.slice("w", F.col("chunk") * step + 1, F.lit(size)).alias("c")).select(key, "chunk", F.size("c").alias("n_tokens"), F.md5(F.concat_ws(" ", "c")).alias("digest"))


def best_evidence(claims: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """key, evidence, overlap: of each claim's passage the first sentence with the largest share of its content words; the
    whole passage if that has one sentence at most or the claim no content. claims: key, claim; passages: key, text."""
    j = claims.select(key, "claim").join(passages.select(key, "text"), key).withColumns({"_n": T.normalize("text"), "_c": V.content(T.tokenize("claim"))})
    j = j.withColumn("_s", T.sentence_spans("_n"))
    scored = F.transform("_s", lambda s, i: F.struct((F.size(F.array_intersect(F.col("_c"), V.content(T.tokenize(s["sentence"])))) / F.size("_c")).alias("o"), (-i).alias("i"), s["sentence"].alias("s")))
    best = F.array_max(scored)
    whole = (F.size("_s") <= 1) | (F.size("_c") == 0)
    return j.select(key, F.when(whole, F.col("text")).otherwise(best["s"]).alias("evidence"), F.when(whole, None).otherwise(best["o"]).alias("overlap"))


def receipts(passages: DataFrame, spans: DataFrame) -> DataFrame:
    """pid, start, end, answer, passage_sha256, passage_chars; spans: pid, start, end."""
    j = spans.join(passages.select("pid", "text"), "pid")
    return j.select("pid", "start", "end", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("answer"), F.sha2("text", 256).alias("passage_sha256"), F.length("text").alias("passage_chars"))


def check_receipts(issued: DataFrame, passages: DataFrame, config_hash: str | None = None) -> DataFrame:
    """pid, the five hard checks found, same_text, in_range, same_span, in_evidence (where there is evidence_sentence),
    ok, and same_config, which tells but does not fail."""
    j = issued.join(passages.select("pid", "text"), "pid", "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    same = sure(F.sha2("text", 256) == F.col("passage_sha256"))
    within = sure((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("text")))
    span = sure(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("answer")) & within
    shown = sure(F.contains("evidence_sentence", "answer")) if "evidence_sentence" in issued.columns else F.lit(True)
    config = F.col("config_hash").eqNullSafe(F.lit(config_hash)) if "config_hash" in issued.columns else F.lit(None).cast("boolean")
    return j.select("pid", F.col("text").isNotNull().alias("found"), same.alias("same_text"), within.alias("in_range"), span.alias("same_span"), shown.alias("in_evidence"), (same & within & span & shown).alias("ok"), config.alias("same_config"))


def overlay(passages: DataFrame, tampered: DataFrame) -> DataFrame:
    """passages with the tampered texts in place of theirs."""
    t = tampered.select("pid", F.col("text").alias("_t"))
    return passages.join(t, "pid", "left").withColumn("text", F.coalesce("_t", "text")).drop("_t")
