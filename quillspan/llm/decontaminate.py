"""Benchmark decontamination by winnowing.

Items and documents become words. Of every run of WINDOW words the least of its hashed GRAM-word
shingles is a fingerprint (winnowing with window WINDOW - GRAM + 1); runs that share their least
shingle share one row, so about a quarter of the places are left. Two runs with equal words have the
same least shingle, so every shared run has a join partner. A partner's words are compared, and the hit
is extended to both sides for as long as the words agree, up to the runs that the shingle can lie in; a
hit of WINDOW words or more counts. Hash collisions add nothing.

Items of fewer than WINDOW words are one window each, with a hash of all their words.

Cases: a null or empty text has no words; an item without words has no window; a null item_id
is named by the empty string; repeated rows each get their own result row; without items no
document is hit; columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .words import ascii_lower, words

WINDOW = 10
GRAM = 4
SIDES = ["before", "core", "after"]
#: The windows of the benchmark are broadcast up to both of these sizes, else joined by a shuffle.
BROADCAST_WINDOWS = 200_000
BROADCAST_CHARS = 32 << 20


def _doubled(df: DataFrame, size: int, merge: str, back: bool = False) -> DataFrame:
    """_h with each place merged with the size - 1 places after it (before it, if back): after a step of s, each place covers s more."""
    span = 1
    while span < size:
        step = min(span, size - span)
        shifted = f"concat(slice(_h, 1, least({step}, size(_h))), slice(_h, 1, greatest(size(_h) - {step}, 0)))" if back else f"slice(_h, {step + 1}, greatest(size(_h) - {step}, 0))"
        df, span = df.withColumn("_h", F.expr(f"zip_with(_h, {shifted}, (a, b) -> {merge})")), span + step
    return df


def _fingerprints(df: DataFrame, w: str, keep: list[str]) -> DataFrame:
    """keep, at, fp: the place and hash of each GRAM-word shingle that is the least of some run of WINDOW words; w: column of lower-cased words."""
    places = WINDOW - GRAM + 1
    df = _doubled(df.withColumn("_h", F.expr(f"transform({w}, x -> xxhash64(x))")), GRAM, "xxhash64(a, b)")
    df = df.withColumn("_g", F.expr(f"slice(_h, 1, greatest(size({w}) - {GRAM - 1}, 0))"))
    # Least of each run, by its start; missing places count as none. A shingle is kept if the greatest of
    # these over the runs that hold it is its own hash: then it is the least of that run. Equal hashes all stay.
    df = _doubled(df.withColumn("_h", F.col("_g")), places, "least(a, b)")
    df = df.withColumn("_h", F.expr(f"slice(_h, 1, greatest(size({w}) - {WINDOW - 1}, 0))"))
    df = df.withColumn("_h", F.expr(f"if(size(_h) = 0, _h, concat(_h, array_repeat(_h[size(_h) - 1], {places - 1})))"))
    df = _doubled(df, places, "greatest(a, b)", back=True)
    chosen = F.expr("zip_with(_g, _h, (g, m) -> if(g = m, g, null))")
    # outer: else the optimizer infers a filter on the array and evaluates all of the above once more for each use of _h.
    return df.select(*keep, F.posexplode_outer(chosen).alias("at", "fp"))


def _whole(df: DataFrame, w: str, keep: list[str], n: int) -> DataFrame:
    """As _fingerprints for runs of n words, n < WINDOW, hashed as a whole."""
    return df.select(*keep, F.posexplode_outer(F.expr(f"transform(slice({w}, 1, greatest(size({w}) - {n - 1}, 0)), (x, i) -> xxhash64(slice({w}, i + 1, {n})))")).alias("at", "fp"))


def _around(w, at, n: int, size: int):
    """The n words from at of w and up to size - n on each side: before (nearest first), core, after."""
    start = F.greatest(at - (size - n), F.lit(0))
    return [F.reverse(F.slice(w, start + 1, at - start)), F.slice(w, at + 1, F.lit(n)), F.slice(w, at + n + 1, F.lit(size - n))]


def _agree(a: str, b: str, n: int):
    """How many of the n leading words of two arrays agree. No lambda: this stays in the generated code of the join."""
    fits = F.least(F.size(a), F.size(b))
    return sum(((fits >= k) & (F.slice(a, 1, k) == F.slice(b, 1, k))).cast("int") for k in range(1, n + 1)) if n else F.lit(0)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item, n (words hashed), fp, before, core, after: the fingerprints of all items with the words around them, repeats included once an item."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.col("text"))).alias("w"))
    full = _fingerprints(b.filter(F.size("w") >= WINDOW), "w", ["item", "w"]).filter("fp is not null")
    full = full.select("item", F.lit(GRAM).alias("n"), F.lit(WINDOW).alias("size"), "fp", *[x.alias(c) for x, c in zip(_around(F.col("w"), F.col("at"), GRAM, WINDOW), SIDES)])
    none = F.array().cast("array<string>")
    few = b.filter((F.size("w") > 0) & (F.size("w") < WINDOW)).select("item", F.size("w").alias("n"), F.size("w").alias("size"), F.xxhash64("w").alias("fp"), none.alias("before"), F.col("w").alias("core"), none.alias("after"))
    return full.unionByName(few).distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row for each document: doc_id, th (hash of its text), n_words, n_hit, n_items, items (sorted), contaminated."""
    key = [F.concat_ws(" ", c) for c in SIDES]
    windows = written(benchmark_windows(benchmark).withColumn("wid", F.md5(F.concat_ws("\n", F.col("size").cast("string"), *key))))
    distinct = windows.drop("item").distinct()
    sizes = windows.groupBy("size", "n").agg(F.count("*").alias("rows"), F.sum(sum(map(F.length, key))).alias("chars")).collect()  # at most WINDOW rows
    small = sum(r.rows for r in sizes) <= broadcast_windows and sum(r.chars for r in sizes) <= BROADCAST_CHARS

    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    lowered = docs.select("doc_id", "th", words(ascii_lower(F.col("text"))).alias("w"))
    hits = []
    for r in sizes:
        side = distinct.filter(F.col("size") == r["size"]).select("fp", "wid", *SIDES)
        keep = ["doc_id", "th", "w"] if small else ["doc_id", "th"]
        found = _fingerprints(lowered, "w", keep) if r["size"] == WINDOW else _whole(lowered, "w", keep, r.n)
        found = found.filter("fp is not null")
        if small:
            found = found.join(F.broadcast(side), "fp")
        else:
            # Partners are told apart before the text is fetched, so that repeated rows do not meet each other.
            found = found.join(side, "fp").dropDuplicates(["doc_id", "th", "at", "wid"]).alias("f").join(docs.alias("d"), _same("f", "d")).select("f.doc_id", "f.th", words(ascii_lower(F.col("text"))).alias("w"), "at", "wid", *SIDES)
        own = _around(F.col("w"), F.col("at"), r.n, r["size"])
        near = found.select("doc_id", "th", "at", "wid", *SIDES, *[x.alias(f"own_{c}") for x, c in zip(own, SIDES)])
        # A hash may lie: the shingle's words are compared, then those before and after it for as long as they agree.
        # xy = yx for equal lengths means x = y; as plain equality it would become a join key, made for every place.
        near = near.filter(F.concat("core", "own_core") == F.concat("own_core", "core"))
        reach = r["size"] - r.n
        spans = near.select("doc_id", "th", "wid", (F.col("at") - _agree("before", "own_before", reach)).alias("start"), (F.col("at") + r.n + _agree("after", "own_after", reach)).alias("end"))
        hits.append(spans.filter(F.col("end") - F.col("start") >= r["size"]))
    base = docs.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if not hits:
        none = F.lit(0).cast("long")
        return base.select("doc_id", "th", "n_words", none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    # Written: spans and items are both read from it, and the search is the costly part.
    hit = written(reduce(DataFrame.unionByName, hits).distinct())
    spans = hit.groupBy("doc_id", "th", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("doc_id", "th").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    owners = windows.select("wid", "item").distinct()
    items = hit.select("doc_id", "th", "wid").distinct().join(F.broadcast(owners) if small else owners, "wid").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered.alias("c").join(items.alias("i"), _same("c", "i")).select("c.doc_id", "c.th", "n_hit", "items")
    return base.alias("b").join(both.alias("x"), _same("b", "x"), "left").select(
        F.col("b.doc_id").alias("doc_id"), F.col("b.th").alias("th"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents less those that hold a window of the benchmark; columns and rows as they are. A row is
    told by doc_id and text, so a null or reused id takes no clean text with it."""
    bad = contamination(documents, benchmark).filter("contaminated").select(F.col("doc_id").alias("__bad"), F.col("th").alias("__bad_th")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("__bad")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__bad_th"))
    return documents.join(bad, here, "left_anti")
