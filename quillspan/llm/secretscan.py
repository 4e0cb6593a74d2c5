"""Secret scan: fixed formats, and a randomness test battery for the rest.

Fixed formats (kinds assign, access, hex) are found by pattern. The battery takes every run of
MIN_CHARS or more encoding characters that has a digit and a letter, infers its encoding (hex,
base32, base62, base64) and tests the hypothesis that its symbols are drawn at random: chi-squared
uniformity over the alphabet, runs about its middle, and serial correlation of neighbours. The
three p-values are combined by Fisher's method. A Benjamini-Hochberg procedure at level FDR within
each length class (powers of two) rejects what is structured text or numbering; what is not
rejected is reported as kind random, unless it overlaps a fixed format. The classes keep the many
short runs, whose tests have little power, from deciding about the long ones. p-values are rounded
up to a fixed grid, so that the procedure needs only counts a class and bin: a table of bounded size.

All is native and row-local but for these counts. Cases: a null or empty text has no spans;
repeated rows each get a row; an empty table gives none; offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 20
FDR = 0.05
#: Bins of the p-value grid, STEPS to a factor of e.
BINS, STEPS = 400, 8

_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _spans(pattern: str, group: str | None, kind: int):
    """Array of struct(start, kind, end, value). The text between matches gives the offsets: one pass, no search."""
    p = F.lit(pattern)
    found = F.arrays_zip(F.split("text", pattern).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("m"), (F.regexp_extract_all("text", p, F.lit(2)) if group else F.regexp_extract_all("text", p, F.lit(0))).alias("v"))
    found = F.filter(found, lambda x: x["m"].isNotNull())
    spans = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (a["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["v"].alias("value")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.col("text").rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _two_sided(z):
    """p of a normal deviate, by the logistic approximation of its distribution."""
    z = F.abs(z)
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-30), 2.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))))


def battery(s):
    """struct(stratum, bin) of a run s: its length class and its p-value on the grid."""
    body = F.rtrim(s, F.lit("="))
    k = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(body.rlike("^[A-Z2-7]+$"), 32).when(body.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64)
    alphabet = F.when(k == 16, F.lit("0123456789abcdef")).when(k == 32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).when(k == 62, F.lit(_BASE62)).otherwise(F.lit(_BASE62 + "+/"))
    text = F.when(k == 16, F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    symbols = F.transform(F.array_remove(F.split(text, ""), ""), lambda c: F.instr(alphabet, c) - 1)
    first = F.transform(F.array(F.struct(symbols.alias("x"), k.alias("k"))), lambda a: F.struct(a["x"].alias("x"), F.size(a["x"]).cast("double").alias("n"), a["k"].cast("double").alias("k")))

    def tests(a):
        x, n, k = a["x"], a["n"], a["k"]
        squares = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(0.0), lambda t, j: t + F.pow(F.size(F.filter(x, lambda v: v == j)).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
        pairs = F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        runs = F.size(F.filter(pairs, lambda t: (t["p"] >= k / 2) != (t["q"] >= k / 2))).cast("double") + 1
        mid = (k - 1) / 2
        cov = F.aggregate(pairs, F.lit(0.0), lambda t, y: t + (y["p"] - mid) * (y["q"] - mid))
        var = F.aggregate(x, F.lit(0.0), lambda t, y: t + (y - mid) * (y - mid))
        return F.struct(n.alias("n"), k.alias("k"), squares.alias("sq"), high.alias("hi"), runs.alias("runs"), (cov / F.greatest(var, F.lit(1e-9))).alias("r"))

    def combined(t):
        df = t["k"] - 1
        chi = F.greatest(t["k"] / t["n"] * t["sq"] - t["n"], F.lit(1e-9))
        z1 = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        # Too many of few symbols is what tells text from noise; too even is not held against a run.
        p1 = F.when(z1 <= 0, F.lit(1.0)).otherwise(_two_sided(z1))
        lo = t["n"] - t["hi"]
        both = 2 * t["hi"] * lo
        mean, var = both / t["n"] + 1, both * (both - t["n"]) / (t["n"] * t["n"] * F.greatest(t["n"] - 1, F.lit(1.0)))
        p2 = F.when(var > 0, _two_sided((t["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(F.lit(1e-30))
        p3 = _two_sided(t["r"] * F.sqrt(t["n"]))
        half = -(F.ln(p1) + F.ln(p2) + F.ln(p3))
        # Fisher: chi-squared with 6 degrees of freedom in closed form; floor() rounds p up to its grid point.
        log_p = -half + F.ln(1 + half + half * half / 2)
        return F.struct(F.floor(F.log2(t["n"])).cast("int").alias("stratum"), F.least(F.lit(BINS), F.floor(-log_p * STEPS)).cast("int").alias("bin"))

    return F.transform(F.transform(first, tests), combined)[0]


def _candidates(documents: DataFrame) -> DataFrame:
    """documents with ``runs``: array of struct(start, kind, end, stratum, bin)."""
    runs = F.filter(F.col("raw"), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & (F.length(F.rtrim(x["value"], F.lit("="))) >= MIN_CHARS))
    tested = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), battery(x["value"]).alias("t")))
    return documents.withColumn("raw", _spans(RUN, None, 3)).withColumn("runs", tested).drop("raw")


def thresholds(candidates: DataFrame) -> DataFrame:
    """One row: cut, a map from length class to the least rejected bin (absent: none rejected)."""
    bins = candidates.select(F.explode_outer("runs").alias("x")).filter("x is not null").groupBy("x.t.stratum", "x.t.bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))  # at most BINS + 1 rows a class
    ranked = bins.select("stratum", "bin", F.sum("n").over(down).alias("up_to"), F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    rejected = ranked.filter(F.exp(-F.col("bin") / STEPS) <= FDR * F.col("up_to") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return rejected.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin"))).alias("cut"))  # one entry for each power of two


def scan(documents: DataFrame) -> DataFrame:
    """A row for each document: doc_id, base and spans (arrays of struct(start, kind, end), sorted)."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = thresholds(_candidates(docs))
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    fixed = docs.withColumns({"a": _spans(ASSIGN, "2", 0), "c": _spans(ACCESS, None, 1), "h": _spans(HEX, None, 2)})
    fixed = fixed.withColumn("base", F.sort_array(F.transform(F.concat(F.filter("a", lambda x: F.length(x["value"]) >= 12), "c", "h"), bare))).drop("a", "c", "h")
    more = F.filter("runs", lambda x: (x["t"]["bin"] < F.coalesce(F.try_element_at("cut", x["t"]["stratum"]), F.lit(BINS + 1))) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return _candidates(fixed).join(F.broadcast(cut)).select("doc_id", "base", F.sort_array(F.concat("base", F.transform(more, bare))).alias("spans"))


def named(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans, kind: int):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
