"""Contrast sets: values of one type drawn from the corpus, swapped into statements; counterfactual passages.

A replacement is drawn by a hash of the statement and the seed, so a draw needs no order of rows. Pools
are tables of distinct values; a draw joins on the value's rank, so no pool is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L, text as T, veto as V

KINDS = ("date", "numeral", "unit", "entity")


def _values(kind: str, text: Column) -> Column:
    def found(x: Column, t: Column) -> Column:
        if kind == "date":
            return V.years(t)
        if kind == "numeral":
            return F.array_except(V.numbers(x), V.years(t))
        return V.bare_units(t) if kind == "unit" else F.array_sort(V.entities(x, t))

    # Text and tokens are made once, whatever the values are looked for by.
    return T.let(T.normalize(text), lambda x: T.let(F.struct(x.alias("x"), F.regexp_extract_all(x, F.lit(T.TOKEN), F.lit(0)).alias("t")), lambda v: found(v["x"], v["t"])))


def pool(sentences: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """value, rank (from 0), n: distinct values of a kind that may replace another: years of four digits in 1000
    to 2100, numbers that are no years, units, names of three characters or more."""
    v = sentences.select(F.explode(_values(kind, F.col(text))).alias("value")).distinct()
    if kind == "date":
        v = v.filter("length(value) = 4 and value between '1000' and '2100'")
    elif kind == "entity":
        v = v.filter("length(value) > 2")
    # Ranks by parts of the pool: a hash bucket is numbered by itself, and the buckets' sizes are added up.
    v = v.withColumn("_b", F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(64)))
    sizes = v.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy("value")) - 1
    return v.join(F.broadcast(before), "_b").select("value", (at + F.col("_from")).cast("long").alias("rank"), "n")


def _draw(key: Column, seed: int, n: Column) -> Column:
    return F.pmod(F.crc32(F.concat_ws(":", F.lit(seed), key).cast("binary")), n)


def swapped(statements: DataFrame, values: DataFrame, kind: str, key: str = "id", text: str = "statement", seed: int = 7) -> DataFrame:
    """key, text, swapped_from, swapped_to of the statements that hold a value of the kind: their first one gives
    way to another of the pool. If the value drawn is the same, the next of the pool is taken."""
    s = statements.select(key, T.normalize(text).alias("_x"), F.get(_values(kind, F.col(text)), F.lit(0)).alias("old")).filter("old is not null")
    size = values.agg(F.max("n").alias("n"))
    s = s.join(F.broadcast(size)).filter("n > 0").withColumn("rank", _draw(F.col(key).cast("string"), seed, F.col("n")))
    both = F.explode(F.array(F.struct(F.col("rank"), F.lit(0).alias("turn")), F.struct(F.pmod(F.col("rank") + 1, F.col("n")).alias("rank"), F.lit(1).alias("turn"))))
    drawn = s.select(key, "_x", "old", both.alias("d")).select(key, "_x", "old", F.col("d.rank").alias("rank"), F.col("d.turn").alias("turn")).join(values.select("rank", "value"), "rank").filter("value <> old")
    one = drawn.groupBy(key).agg(F.min_by(F.struct("_x", "old", "value"), "turn").alias("d")).select(key, "d.*")
    at = F.call_function("locate", F.col("old"), F.col("_x"))
    made = F.concat(F.substring(F.col("_x"), F.lit(1), at - 1), F.col("value"), F.substring(F.col("_x"), at + F.length("old"), F.length("_x")))
    return one.filter(at > 0).select(key, made.alias("text"), F.col("old").alias("swapped_from"), F.col("value").alias("swapped_to"))


def negated(text) -> Column:
    """The first negation out, else one in before a final dari; null for fewer than three tokens without one."""
    v = F.struct(T.normalize(text).alias("x"), T.tokenize(text).alias("t"))

    def turned(v: Column) -> Column:
        first = F.get(F.filter(v["t"], lambda t: F.array_contains(V._among(L.NEGATION), t)), F.lit(0))
        without = F.trim(F.call_function("regexp_replace", v["x"], F.concat(F.lit(r"^(.*?)\s*(?<![ঀ-৿])"), first, F.lit(r"(?![ঀ-৿])")), F.lit("$1")))
        body = F.rtrim(F.regexp_replace(F.rtrim(v["x"]), "।+$", ""))
        added = F.concat(body, F.lit(f" {L.NO}"), F.when(F.endswith(F.rtrim(v["x"]), F.lit("।")), "।").otherwise(""))
        return F.when(first.isNotNull(), without).when(F.size(v["t"]) >= 3, added)

    return T.let(v, turned)


def turned_around(text) -> Column:
    """The words about the first direction word (from, of) change places; null where there is none or they are equal."""
    v = F.struct(T.normalize(text).alias("x"), T.tokenize(text).alias("t"))

    def turned(v: Column) -> Column:
        spots = F.filter(F.transform(v["t"], lambda t, i: F.when(t.isin(*L.DIRECTION[:2]) & (i > 0) & F.get(v["t"], i + 1).isNotNull() & (F.get(v["t"], i - 1) != F.get(v["t"], i + 1)), F.struct(F.get(v["t"], i - 1).alias("l"), t.alias("m"), F.get(v["t"], i + 1).alias("r")))), lambda s: s.isNotNull())
        s = F.get(spots, F.lit(0))
        old, new = F.concat_ws(" ", s["l"], s["m"], s["r"]), F.concat_ws(" ", s["r"], s["m"], s["l"])
        return F.when(s.isNotNull() & F.contains(v["x"], old), F.regexp_replace(v["x"], F.concat(F.lit(r"\Q"), old, F.lit(r"\E")), new))

    return T.let(v, turned)


def neutral_pairs(items: DataFrame, key: str, statement: str, evidence: str, pid: str) -> DataFrame:
    """key, statement, evidence, pid: each statement with the evidence of the item half the table further (of a
    hash order), where that is of another passage."""
    from .metrics import rank_of

    r = rank_of(items.select(key, statement, evidence, pid), [F.crc32(F.col(key).cast("string").cast("binary")), key])
    n = items.agg(F.count("*").alias("_n"))
    half = r.join(F.broadcast(n)).withColumn("_at", F.pmod(F.col("pos") - 1 + F.floor(F.col("_n") / 2), F.col("_n")) + 1)
    other = r.select(F.col("pos").alias("_at"), F.col(evidence).alias("_e"), F.col(pid).alias("_p"))
    return half.join(other, "_at").filter(F.col(pid) != F.col("_p")).select(key, statement, F.col("_e").alias("evidence"), F.col("_p").alias("pid"))


def perturbed(passages: DataFrame, answers: DataFrame, pools: dict[str, DataFrame], key: str = "pid", seed: int = 7) -> DataFrame:
    """key, text, original_answer, tampered_answer: passages whose answer (key, answer) gives way to another of its
    type: its year, else its first number, else the whole of it by a name."""
    a = answers.select(key, "answer").join(passages.select(key, "text"), key).filter("answer <> ''").withColumn("text", T.normalize("text")).filter(F.contains("text", F.col("answer")))
    kind = F.when(F.size(V.years(T.tokenize("answer"))) > 0, "date").when(F.col("answer").rlike("[0-9]"), "numeral").otherwise("entity")
    a = a.withColumn("kind", kind).withColumn("old", F.when(F.col("kind") == "date", F.get(V.years(T.tokenize("answer")), F.lit(0))).when(F.col("kind") == "numeral", F.regexp_extract("answer", "([0-9]+)", 1)).otherwise(F.col("answer")))
    out = None
    for k, values in pools.items():
        rows = a.filter(F.col("kind") == k).join(F.broadcast(values.agg(F.max("n").alias("n")))).filter("n > 0").withColumn("rank", _draw(F.col(key).cast("string"), seed, F.col("n")))
        new = rows.join(values.select("rank", "value"), "rank").filter("value <> old")
        if k == "entity":
            new = new.filter(~F.contains("text", F.col("value")) & (F.length("value") < 40))
        out = new if out is None else out.unionByName(new)
    put = lambda whole, old, to: F.concat(F.substring(whole, F.lit(1), F.call_function("locate", old, whole) - 1), to, F.substring(whole, F.call_function("locate", old, whole) + F.length(old), F.length(whole)))
    out = out.withColumn("tampered_answer", put(F.col("answer"), F.col("old"), F.col("value")))
    return out.select(key, put(F.col("text"), F.col("answer"), F.col("tampered_answer")).alias("text"), F.col("answer").alias("original_answer"), "tampered_answer")


def car_aorr(runs: DataFrame) -> DataFrame:
    """One row: car, the share of answers that follow the tampered passage, and aorr, the share of answered
    questions that keep the old answer once their passage is gone; runs: followed, kept, answered (booleans)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return runs.agg(share("followed").alias("car"), (F.sum((F.col("kept") & F.col("answered")).cast("int")) / F.sum(F.col("answered").cast("int"))).alias("aorr"))
