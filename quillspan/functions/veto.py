"""Contradiction checks between an answer and its evidence, as native expressions.

A check fires on a conflict, never on absence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon as L
from .text import col, let, normalize, tokenize

CAP = 0.15
CATEGORIES = ("numeral", "date", "unit", "entity", "polarity", "relation_order")
# What a numeral and a Latin proper name are, and the limits of a swap.
NUMERAL = r"[0-9]+(?:[.,][0-9]+)*"
LATIN_NAME = r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\b"
SWAP_TOKENS, SWAP_SHARED, SWAP_SHARE, SWAP_MOST = 4, 2, 0.6, 2


def _among(words) -> Column:
    return F.array(*map(F.lit, words))


def is_number(token: Column) -> Column:
    return token.rlike(f"^{NUMERAL}$")


def polarity(tokens: Column) -> Column:
    """True where no token negates."""
    return ~F.arrays_overlap(tokens, _among(L.NEGATION))


def years(tokens: Column) -> Column:
    """Numbers of four digits in 1000 to 2100, or next to a year word or month."""
    cues = _among(L.YEAR_WORDS + L.MONTHS)

    def found(tokens: Column) -> Column:
        near = lambda i: F.array_contains(cues, F.coalesce(F.get(tokens, i - 1), F.lit(""))) | F.array_contains(cues, F.coalesce(F.get(tokens, i + 1), F.lit("")))
        is_year = lambda t, i: t.rlike(r"^[0-9]+$") & (((F.length(t) == 4) & (t >= "1000") & (t <= "2100")) | near(i))
        return F.array_distinct(F.filter(tokens, is_year))

    # Else a text would be tokenised again for each of its numbers.
    return let(tokens, found)


def numbers(text: Column) -> Column:
    """Numerals anywhere in normalised text, so 12:30 is two of them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERAL), F.lit(0)))


def units(tokens: Column) -> Column:
    """``number unit`` strings."""
    known = _among(L.UNITS)
    pairs = F.transform(tokens, lambda t, i: F.when(is_number(t) & F.array_contains(known, F.lower(F.coalesce(F.get(tokens, i + 1), F.lit("")))), F.concat_ws(" ", t, F.lower(F.get(tokens, i + 1)))))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def bare_units(tokens: Column) -> Column:
    """The unit words, whether or not a number stands before them."""
    return F.array_distinct(F.array_intersect(F.transform(tokens, lambda t: F.lower(t)), _among(L.UNITS)))


def entities(text: Column, tokens: Column, gazetteer: Column | None = None) -> Column:
    """Runs of capitalised Latin words; the token before a marker, if that is no marker; else, of a token
    that is no marker, the one after an honorific; else a token that the gazetteer (an array) holds. No numbers."""
    markers, titles = _among(L.MARKERS), _among(L.HONORIFICS)
    before = lambda i: F.get(tokens, i - 1)

    def found(t: Column, i: Column) -> Column:
        out = F.when(F.array_contains(markers, t), F.when(~F.array_contains(markers, F.coalesce(before(i), F.lit(""))), before(i)))
        out = out.when(F.array_contains(titles, t) & F.get(tokens, i + 1).isNotNull(), F.get(tokens, i + 1))
        return out if gazetteer is None else out.when(F.array_contains(gazetteer, t), t)

    every = F.concat(F.regexp_extract_all(text, F.lit(LATIN_NAME), F.lit(0)), F.transform(tokens, found))
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull() & ~is_number(t)))


def relation_order(tokens: Column) -> Column:
    """``before>after`` about the direction words."""
    words = _among(L.DIRECTION)
    found = F.transform(tokens, lambda t, i: F.when(F.array_contains(words, t) & (i > 0) & F.get(tokens, i + 1).isNotNull(), F.concat_ws(">", F.get(tokens, i - 1), F.get(tokens, i + 1))))
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def content(tokens: Column) -> Column:
    stop = _among(sorted(set(L.STOPWORDS) - set(L.VETO_SAFE)))
    return F.array_distinct(F.filter(tokens, lambda t: ~F.array_contains(stop, t) & (F.length(t) > 1)))


def _conflict(a: Column, e: Column) -> Column:
    return (F.size(a) > 0) & (F.size(e) > 0) & (F.size(F.array_except(a, e)) > 0)


def swap(a: Column, e: Column, classes: Column | None = None) -> Column:
    """struct(said, stands) of two token arrays that are near copies but for one or two words, else null: the
    answer's first word in order that the evidence lacks, and the evidence's longest that the answer lacks.

    classes: a map from words to the class of their synonyms; words of one class are no swap."""
    pair = F.struct(content(a).alias("a"), content(e).alias("e"), F.size(a).alias("n"), F.size(e).alias("m"))

    def told(v: Column) -> Column:
        shared = F.size(F.array_intersect(v["a"], v["e"]))
        words = lambda x, y: F.array_sort(F.filter(F.array_except(x, y), lambda t: ~is_number(t)))
        only_a, only_e = words(v["a"], v["e"]), words(v["e"], v["a"])
        near = (v["n"] >= SWAP_TOKENS) & (v["m"] >= SWAP_TOKENS) & (shared >= SWAP_SHARED) & (shared >= SWAP_SHARE * F.size(v["a"])) & F.size(only_a).between(1, SWAP_MOST) & (F.size(only_e) >= 1)
        if classes is not None:
            kinds = lambda x: F.filter(F.transform(x, lambda t: F.try_element_at(classes, t)), lambda k: k.isNotNull())
            near = near & ~F.arrays_overlap(kinds(only_a), kinds(only_e))
        longest = F.array_sort(F.transform(only_e, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
        return F.when(near, F.struct(only_a[0].alias("said"), longest[0]["t"].alias("stands")))

    return let(pair, told)


def check(answer, evidence, gazetteer: Column | None = None, classes: Column | None = None, check_polarity: bool = True) -> Column:
    """Array of the categories that conflict, in order: date, numeral, unit, entity (a name that the evidence's
    text lacks while it names others, else a swapped word), polarity, relation_order (reversed only)."""
    both = lambda c: F.struct(normalize(c).alias("x"), tokenize(c).alias("t"))

    def fired(v: Column) -> Column:
        a, e = v["a"]["t"], v["e"]["t"]
        ya, ye = years(a), years(e)
        numeral = _conflict(F.array_except(numbers(v["a"]["x"]), ya), F.array_except(numbers(v["e"]["x"]), ye))
        missing = F.filter(entities(v["a"]["x"], a, gazetteer), lambda n: ~F.contains(v["e"]["x"], n))
        name = (F.size(missing) > 0) & (F.size(entities(v["e"]["x"], e, gazetteer)) > 0)
        turned = lambda p: F.concat_ws(">", F.element_at(F.split(p, ">"), 2), F.element_at(F.split(p, ">"), 1))
        reversed_ = F.exists(relation_order(a), lambda p: (turned(p) != p) & F.array_contains(relation_order(e), turned(p)))
        tests = [("date", _conflict(ya, ye)), ("numeral", numeral), ("unit", _conflict(bare_units(a), bare_units(e))), ("entity", name | swap(a, e, classes).isNotNull())]
        if check_polarity:
            tests.append(("polarity", (F.size(a) >= 3) & (polarity(a) != polarity(e))))
        tests.append(("relation_order", reversed_))
        return F.filter(F.array(*[F.when(test, F.lit(n)) for n, test in tests]), lambda x: x.isNotNull())

    return let(F.struct(both(answer).alias("a"), both(evidence).alias("e")), fired)


def features(answer, evidence, **k) -> Column:
    """struct of the 13 numbers that the checks give to a model: a flag each category, veto_any, veto_count, and what agrees."""
    v = F.struct(check(answer, evidence, **k).alias("f"), tokenize(answer).alias("a"), tokenize(evidence).alias("e"), normalize(answer).alias("x"), normalize(evidence).alias("y"))

    def made(v: Column) -> Column:
        one = lambda c: c.cast("double")
        within = lambda p, q: (F.size(p) > 0) & (F.size(F.array_except(p, q)) == 0)
        ya, na = years(v["a"]), numbers(v["x"])
        flags = [one(F.array_contains(v["f"], c)).alias(f"veto_{c}") for c in CATEGORIES]
        more = (("veto_any", F.size(v["f"]) > 0), ("veto_count", F.size(v["f"])), ("polarity_match", polarity(v["a"]) == polarity(v["e"])), ("year_in_evidence", within(ya, years(v["e"]))), ("answer_has_year", F.size(ya) > 0), ("nums_in_evidence", within(na, numbers(v["y"]))), ("answer_has_number", F.size(na) > 0))
        return F.struct(*flags, *[one(c).alias(n) for n, c in more])

    return let(v, made)


def capped(support: Column, fired: Column) -> Column:
    return F.when(F.size(fired) > 0, F.least(support, F.lit(CAP))).otherwise(support)


def containment(answer, evidence) -> Column:
    """Share of the answer's content words in the evidence."""
    return let(F.struct(content(tokenize(answer)).alias("a"), tokenize(evidence).alias("e")), lambda v: F.when(F.size(v["a"]) == 0, 0.0).otherwise(F.size(F.array_intersect(v["a"], v["e"])) / F.size(v["a"])))


def stem(token: Column, vocabulary: Column | None = None, strips: int = 2) -> Column:
    """Up to ``strips`` suffixes off; a stem has three code points or more and no final hasant.

    With a vocabulary (a small array; operators.retrieval.stems has one of any size) the longest suffix whose
    rest it holds; else tiers in order, longest first."""
    tiers = [s for tier in L.SUFFIX_TIERS.values() for s in sorted(tier, key=lambda s: (-len(s), s))]
    order = _among(sorted(tiers, key=lambda s: (-len(s), s)) if vocabulary is not None else tiers)

    def once(t: Column) -> Column:
        rest = lambda s: F.left(t, F.length(t) - F.length(s))
        fits = lambda s: F.endswith(t, s) & (F.length(t) - F.length(s) >= 3) & ~F.endswith(rest(s), F.lit(L.HASANT))
        ok = fits if vocabulary is None else lambda s: fits(s) & F.array_contains(vocabulary, rest(s))
        return let(F.get(F.filter(order, ok), F.lit(0)), lambda s: F.when(s.isNotNull(), rest(s)).otherwise(t))

    # All suffixes are of one script: other tokens are left at once.
    for _ in range(strips):
        token = let(token, lambda t: F.when(t.rlike("[\u0980-\u09FF]$"), once(t)).otherwise(t))
    return token


def question_class(question) -> Column:
    """Phrases anywhere in the text first; then a final ki asks for yes or no; then the first rule with a word
    of the question, but an initial ki before a clause without another question word asks for yes or no too."""
    what, asking = _among(L.WHAT), _among([w for group, _ in L.QUESTION_WORDS for w in group])

    def rule(v: Column) -> Column:
        q, t = v["q"], v["t"]
        out = F.when(F.lit(False), "")
        for phrase, kind in L.QUESTION_PHRASES:
            out = out.when(F.contains(q, F.lit(" ".join(L.words(phrase)))), kind)
        out = out.when((F.size(t) > 1) & F.array_contains(what, F.element_at(t, -1)), "POLARITY")
        alone = F.array_contains(what, F.get(t, F.lit(0))) & (F.size(t) > 2) & ~F.arrays_overlap(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), asking)
        for words, kind in L.QUESTION_WORDS:
            out = out.when(F.arrays_overlap(t, _among(words)), F.when(alone, "POLARITY").otherwise(kind) if kind == "THING" else F.lit(kind))
        return F.when(F.size(t) == 0, F.when(out.isNotNull(), out).otherwise("UNKNOWN")).otherwise(out.otherwise("UNKNOWN"))

    return let(F.struct(normalize(question).alias("q"), tokenize(question).alias("t")), rule)


def is_list_question(question) -> Column:
    return let(normalize(question), lambda q: F.exists(_among([" ".join(L.words(c)) for c in L.LIST_CUES]), lambda c: F.contains(q, c)))


def route(kind: Column, question_type: Column, question) -> Column:
    """polarity, list or span: which decoder a question goes to."""
    listed = (F.coalesce(question_type, F.lit("")) == "list") | is_list_question(question)
    return F.when((kind == "POLARITY") | (question_type == "confirmation"), "polarity").when(listed, "list").otherwise("span")


def span_matches_class(span, kind: Column) -> Column:
    """Whether a span can answer a question of the class; permissive, false only without tokens or against a rule."""
    v = F.struct(tokenize(span).alias("t"), col(span).alias("x"))

    def fits(v: Column) -> Column:
        t, digit = v["t"], v["x"].rlike("[0-9]")
        word = ~(digit & (F.size(t) == 1))
        place = word | F.arrays_overlap(t, _among(L.MARKERS + L.HONORIFICS))
        out = F.when(kind == "TIME", digit | (F.size(years(t)) > 0)).when(kind == "NUMBER", digit | F.arrays_overlap(t, _among(L.UNITS))).when(kind == "PERSON", word).when(kind == "PLACE", place).when(kind.isin("REASON", "PROCESS"), F.size(t) >= 3).otherwise(True)
        return (F.size(t) > 0) & out

    return let(v, fits)
