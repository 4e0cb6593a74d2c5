"""Text functions as native column expressions. Offsets count code points from 0."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

# What a token is, what ends a sentence, and the character maps of normalisation.
TOKEN = r"[\u0980-\u09FF]+|[A-Za-z]+[0-9]*|[0-9]+(?:[.,:/][0-9]+)*"
SENTENCE_END = r"(?<=[।?!])\s+|\n+"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
PUNCT_FROM = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2013\u2014\u2015\u2212\u00a0\u202f\u2007\u2009\u0965"
PUNCT_TO = "'" * 4 + '"' * 4 + "-" * 4 + " " * 4 + "\u0964"
BENGALI_DIGITS, ASCII_DIGITS = "\u09e6\u09e7\u09e8\u09e9\u09ea\u09eb\u09ec\u09ed\u09ee\u09ef", "0123456789"
#: Code points of the Bengali block that canonical composition changes.
DECOMPOSED = (("\u09dc", "\u09a1\u09bc"), ("\u09dd", "\u09a2\u09bc"), ("\u09df", "\u09af\u09bc"))
COMPOSED = (("\u09c7\u09be", "\u09cb"), ("\u09c7\u09d7", "\u09cc"))
#: How all characters that normalisation translates or composes begin in UTF-8 (the last is the no-break space).
FIRST_BYTES = (bytearray(b"\xe0"), bytearray(b"\xe2"), bytearray(b"\xef"), bytearray(b"\xc2\xa0"))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside lambdas an expression would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def nfc_bengali(c) -> Column:
    """NFC for Bengali text; other scripts are taken as composed already (see nfc for the rest)."""
    c = col(c)
    for a, b in DECOMPOSED + COMPOSED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def nfc(c) -> Column:
    """General NFC, for which Spark has no function: Arrow batches through unicodedata."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return run(col(c))


def _letters(c, fold_digits: bool = True) -> Column:
    """Letters and signs of the normalised form; texts without any of FIRST_BYTES have nothing that it changes."""

    def changed(t: Column) -> Column:
        t = F.replace(F.translate(nfc_bengali(t), PUNCT_FROM + ZERO_WIDTH, PUNCT_TO), F.lit("…"), F.lit("..."))
        return F.translate(t, BENGALI_DIGITS, ASCII_DIGITS) if fold_digits else t

    return let(col(c), lambda t: F.when(reduce(Column.__or__, [F.contains(t.cast("binary"), F.lit(b)) for b in FIRST_BYTES]), changed(t)).otherwise(t))


def normalize(c, fold_digits: bool = True) -> Column:
    # Most texts hold nothing for most of the passes: a look for a few signs is cheaper than a replacement.
    has = lambda t, *signs: reduce(Column.__or__, [F.contains(t, F.lit(s)) for s in signs])
    blanks = let(_letters(c, fold_digits), lambda t: F.when(has(t, "  ", "\t", "\r", "\f", "\x0b"), F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")).otherwise(t))
    lines = let(blanks, lambda t: F.when(has(t, "\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t))
    joined = F.regexp_replace(F.regexp_replace(lines, r"(?U)\s+([।,;:?!)\]}])", "$1"), r"(?U)([(\[{])\s+", "$1")
    blank = lambda t: t.rlike(r"(?U)\A\s")
    return let(joined, lambda t: F.when(blank(F.left(t, F.lit(1))) | blank(F.right(t, F.lit(1))), F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")).otherwise(t))


def normalize_for_match(c) -> Column:
    # What normalize does to white space makes no difference here, as each run of other signs becomes one blank.
    c = F.regexp_replace(F.lower(_letters(c)), r"(?U)[^\u0980-\u09FFa-z0-9\s]", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def collapse_whitespace(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def bengali_ratio(c) -> Column:
    solid = F.regexp_replace(col(c), r"(?U)\s", "")
    n = F.length(solid)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.regexp_replace(solid, r"[\u0980-\u09FF]", ""))) / n)


def to_bengali_digits(c) -> Column:
    return F.translate(col(c), ASCII_DIGITS, BENGALI_DIGITS)


def tokenize(c) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(TOKEN), F.lit(0))


def tokenize_lower(c) -> Column:
    # Lower case of the text first: one call, not one for each token, and no token changes its bounds.
    return F.regexp_extract_all(F.lower(normalize(c)), F.lit(TOKEN), F.lit(0))


def _placed(parts: Column, gaps: Column) -> Column:
    """array<struct<token,start,end>> from tokens and the text before each."""
    both = F.arrays_zip(parts.alias("t"), gaps.alias("g"))
    return F.aggregate(
        F.filter(both, lambda x: x["t"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["t"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(x["t"].alias("token"), (a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["t"])).alias("end")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def token_spans(c) -> Column:
    """On text that is normalised already."""
    return _placed(F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0)), F.split(col(c), TOKEN, -1))


def _windows(a: Column, n: int) -> Column:
    none = F.array().cast("array<array<string>>")
    return let(a, lambda v: F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - n + 1), lambda i: F.slice(v, i, F.lit(n)))).otherwise(none))


def _substrings(t: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(none)


def char_ngrams(c, low: int = 3, high: int = 5) -> Column:
    """n-grams of each token in angle brackets, repeats kept."""
    bracketed = F.transform(tokenize_lower(c), lambda t: F.concat(F.lit("<"), t, F.lit(">")))
    return F.flatten(F.transform(bracketed, lambda t: F.concat(*[_substrings(t, n) for n in range(low, high + 1)])))


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(normalize(c), SENTENCE_END), lambda x: F.trim(x)), lambda s: F.length(s) >= 2)


def sentence_spans(c) -> Column:
    """array<struct<sentence,start,end>> of text that is normalised already; offsets hold without looking the sentence up."""
    c = col(c)
    both = F.arrays_zip(F.split(c, SENTENCE_END, -1).alias("s"), F.regexp_extract_all(c, F.lit(SENTENCE_END), F.lit(0)).alias("g"))
    blank = lambda s: F.length(s) - F.length(F.ltrim(s))
    placed = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<sentence:string,start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["s"]) + F.coalesce(F.length(x["g"]), F.lit(0))).alias("at"),
            F.concat(a["out"], F.array(F.struct(F.trim(x["s"]).alias("sentence"), (a["at"] + blank(x["s"])).alias("start"), (a["at"] + blank(x["s"]) + F.length(F.trim(x["s"]))).alias("end")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.filter(placed, lambda x: F.length(x["sentence"]) >= 2)


def truncated(c, limit: int = 2000) -> Column:
    """struct(text, cut): the first ``limit`` code points, and whether there were more."""
    c = col(c)
    return F.struct(F.left(c, F.lit(limit)).alias("text"), (F.length(c) > limit).alias("cut"))


def config_hash(settings: dict) -> str:
    """Twelve hexadecimal digits of the settings' JSON with sorted keys."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:12]


def slug_pid(prefix: str, c) -> Column:
    """prefix_ and the id with runs of other characters than ASCII letters and digits as one underscore."""
    return F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def highlight(sentence, start: Column, end: Column, left: str = "**", right: str = "**") -> Column:
    """The sentence with the stretch from start to end (offsets in it) marked; unmarked where they do not lie within it."""
    s = col(sentence)
    fits = (start >= 0) & (start < end) & (end <= F.length(s))
    return F.when(fits, F.concat(F.left(s, start), F.lit(left), F.substring(s, start + 1, end - start), F.lit(right), F.substring(s, end + 1, F.length(s)))).otherwise(s)


# What parts clauses, and their least length.
CLAUSE_END = r"(?<=[,;:])\s+|\s+(?=কারণ|যেহেতু|ফলে|তাই|অর্থাৎ)\s*"
CLAUSE_LEAST = 8


def clauses(sentence) -> Column:
    """The whole sentence, then its clauses of CLAUSE_LEAST characters or more, unless that is all of it."""
    s = col(sentence)
    parts = F.filter(F.transform(F.split(s, CLAUSE_END), lambda x: F.trim(x)), lambda p: (F.length(p) >= CLAUSE_LEAST) & (p != F.trim(s)))
    return F.concat(F.array(s), parts)


def char_trigrams(c) -> Column:
    return let(F.concat(F.lit(" "), F.lower(normalize(c)), F.lit(" ")), lambda t: F.array_distinct(_substrings(t, 3)))


def trigram_cosine(a, b) -> Column:
    both = F.struct(char_trigrams(a).alias("x"), char_trigrams(b).alias("y"))
    return let(both, lambda v: F.when((F.size(v["x"]) == 0) | (F.size(v["y"]) == 0), 0.0).otherwise(F.size(F.array_intersect(v["x"], v["y"])) / F.sqrt(F.size(v["x"]).cast("double") * F.size(v["y"]))))


def word_shingles(c, n: int = 3) -> Column:
    """Set of n-word strings of the matching form; the whole of it if it has fewer words."""
    join = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))))
    return let(F.split(normalize_for_match(c), " "), lambda w: F.when(F.size(w) < n, F.array(F.concat_ws(" ", w))).otherwise(F.array_distinct(join(w))))


def word_ngrams(tokens: Column) -> Column:
    """Unigrams, then bigrams joined by a blank."""
    return let(tokens, lambda t: F.concat(t, F.transform(_windows(t, 2), lambda p: F.concat_ws(" ", p))))


def numbers(c) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def parse_grade(c) -> Column:
    """struct(low, high, label) of ``9``, ``9-10`` and the like, or null."""
    t = F.trim(F.translate(col(c).cast("string"), "–—" + BENGALI_DIGITS, "--" + ASCII_DIGITS))
    low, high = F.regexp_extract(t, r"^([0-9]+)\s*-\s*([0-9]+)$", 1), F.regexp_extract(t, r"^([0-9]+)\s*-\s*([0-9]+)$", 2)
    one = F.regexp_extract(t, "([0-9]+)", 1)
    pair = lambda a, b, label: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"), label.alias("label"))
    return F.when(low != "", pair(low, high, F.concat_ws("-", low, high))).when(one != "", pair(one, one, one))
