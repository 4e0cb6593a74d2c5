"""Calibration, risk-coverage, conformal thresholds and answer metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 10


def ece_bins(scored: DataFrame, p: str = "p", y: str = "y", bins: int = BINS) -> DataFrame:
    """bin, n, conf, acc with bins (lo, hi], the first closed: least edge at or above p, taken from explicit edges."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(edges, lambda e: F.col(p) > e)) + 1
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))


def _gap(b: DataFrame) -> DataFrame:
    return b.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("gap"))


def ece(scored: DataFrame, **k) -> DataFrame:
    return _gap(ece_bins(scored, **k))


def rank_of(scored: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Global row number (from 1) without one task for all rows: a range sort, rows counted a partition, prefix sums of the counts."""
    s = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    s = s.persist()
    n = s.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return s.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_row", "_before")


def ace(scored: DataFrame, p: str = "p", y: str = "y", key: str = "doc_id", bins: int = BINS) -> DataFrame:
    """Equal mass: the first (n mod bins) bins have one row more, as ntile."""
    r = rank_of(scored, [p, key]).join(F.broadcast(scored.agg(F.count("*").alias("_all"))))
    small, extra = F.expr(f"_all div {bins}"), F.col("_all") % bins
    at = F.col("pos") - 1
    b = F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(extra + F.floor((at - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return _gap(r.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc")))


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def auroc(scored: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """by, auc: rank sum with average ranks. Ties are counted first, so what is ordered is the distinct scores."""
    d = scored.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    below = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("neg", F.col("n") - F.col("pos")).withColumn("lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return d.groupBy(*by).agg((F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def running(scored: DataFrame, order: list, value: Column, pos: str = "k", name: str = "total") -> DataFrame:
    """scored with its global row number and the running sum of value: within a range partition, plus what the partitions before it hold."""
    s = scored.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).persist()
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = s.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(up_to), F.lit(0)).alias("_sum"))
    here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(before), "_part")
    out = out.withColumns({pos: F.col("_rows") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1, name: F.col("_sum") + F.sum("_v").over(here)})
    return out.drop("_v", "_part", "_row", "_n", "_rows", "_sum")


def risk_coverage(scored: DataFrame, p: str = "p", y: str = "y", key: str = "doc_id") -> DataFrame:
    """k, coverage, risk: answered in order of falling confidence."""
    r = running(scored, [F.desc(p), key], 1 - F.col(y), "k", "err")
    total = scored.agg(F.count("*").alias("_n"))
    return r.join(F.broadcast(total)).select("k", (F.col("k") / F.col("_n")).alias("coverage"), (F.col("err") / F.col("k")).alias("risk"))


def risk_curve(scored: DataFrame, points: int = 101, **k) -> DataFrame:
    """point, k, coverage, risk (four places) at ``points`` coverages from one row to all; rounded halves go to the even k."""
    g = points - 1
    n = scored.agg(F.count("*").alias("n")).filter("n > 0")
    grid = scored.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    wanted = grid.join(F.broadcast(n)).select("point", "n", F.greatest(F.bround((g + F.col("point") * (F.col("n") - 1)) / g, 0).cast("long"), F.lit(1).cast("long")).alias("k"))
    at = risk_coverage(scored, **k).join(F.broadcast(wanted.select("k").distinct()), "k")  # at most ``points`` rows go on
    return wanted.join(at.select("k", "risk"), "k").select("point", "k", F.round(F.col("k") / F.col("n"), 4).alias("coverage"), F.round("risk", 4).alias("risk"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """One row: rc_auc (trapezoids; lower is better), and the risk at full coverage and at the first point of half and of 0.8 or more."""
    w = Window.orderBy("point")  # as many rows as points
    c = curve.select("*", (F.col("coverage") - F.lag("coverage").over(w)).alias("_dx"), (F.col("risk") + F.lag("risk").over(w)).alias("_sy"))
    first = lambda at: F.min_by("risk", F.when(F.col("coverage") >= at, F.col("point")))
    return c.agg(F.sum(F.col("_dx") * F.col("_sy") / 2).alias("rc_auc"), F.max_by("risk", "point").alias("risk_at_full"), first(0.5).alias("risk_at_50"), first(0.8).alias("risk_at_80"))


def compare_policies(arms: dict[str, DataFrame], **k) -> DataFrame:
    """policy and its curve_summary, for scored rows by policy."""
    out = None
    for name, arm in arms.items():
        one = curve_summary(risk_curve(arm, **k)).select(F.lit(name).alias("policy"), F.round("rc_auc", 4).alias("rc_auc"), "risk_at_full", "risk_at_50", "risk_at_80")
        out = one if out is None else out.unionByName(one)
    return out


def conformal_verify(scored: DataFrame, tau: float, feasible: bool, alpha: float = 0.1, delta: float = 0.1, p: str = "p", y: str = "y") -> DataFrame:
    """One row on rows not used for tau: n_test, answered, coverage, risk, errors, guarantee_in_force, bound_held (null where nothing is answered), claim."""
    answered = F.col(p) >= tau
    t = scored.agg(F.count("*").alias("n_test"), F.coalesce(F.sum(answered.cast("long")), F.lit(0)).alias("answered"), F.coalesce(F.sum(F.when(answered, 1 - F.col(y)).otherwise(0)), F.lit(0)).cast("long").alias("errors"))
    risk = F.when(F.col("answered") > 0, F.col("errors") / F.col("answered")).otherwise(0.0)
    held = f"with {100 * (1 - delta):.0f}% confidence, at most {100 * alpha:.0f}% of answered questions are wrong"
    force = F.lit(feasible) & (F.col("answered") > 0)
    return t.select("n_test", "answered", "errors", F.round(F.col("answered") / F.greatest("n_test", F.lit(1)), 4).alias("coverage"), F.round(risk, 4).alias("risk"), force.alias("guarantee_in_force"), F.when(F.col("answered") > 0, risk <= alpha).alias("bound_held"), F.when(force, held).otherwise("NOT IN FORCE").alias("claim"))


def average_precision(scored: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """by, auprc: the precision at each distinct score, weighted by the recall it adds."""
    d = scored.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*by, "pos", (F.sum("pos").over(down) / F.sum("n").over(down)).alias("precision"))
    return d.groupBy(*by).agg((F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).alias("auprc"))


def fusion_row(scored: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """by, auroc, auprc, brier, accuracy (at one half)."""
    right = ((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")
    plain = scored.groupBy(*by).agg(brier(p, y).alias("brier"), F.avg(right).alias("accuracy"))
    return auroc(scored, by, p, y).withColumnRenamed("auc", "auroc").join(average_precision(scored, by, p, y), by).join(plain, by)


def bootstrap_interval(values: DataFrame, value: str, key: str, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """One row: mean, low, high. Each row counts in each resample as often as a Poisson draw with mean 1 says (the limit
    of drawing with replacement), drawn by a hash of its key: sums of each resample are combined before the shuffle."""
    cells = F.array(*[F.lit(x) for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)])
    u = F.pmod(F.xxhash64(key, "b"), F.lit(1 << 31)) / float(1 << 31)
    drawn = values.select(key, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).withColumn("_w", F.size(F.filter(cells, lambda c: c < u)))
    means = drawn.groupBy("b").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))  # one mean a resample
    return values.agg(F.avg(value).alias("mean")).join(ends)


def _beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function: its prefactor in logarithms, its continued fraction (Lentz) on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(b, a, 1 - x)
    tiny, c, i = 1e-300, 1.0, 0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    while True:
        i += 1
        for t in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 / ((1 + t * d) or tiny), (1 + t / c) or tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * f / a


def clopper_pearson_upper(errors: str, n: str, delta: float, steps: int = 60) -> Column:
    """1 if n = 0 or errors >= n; else the p whose binomial CDF at ``errors`` is delta, by bisection. No built-in has the CDF at any n, so Python does."""

    def bound(k, m):
        if k is None or m is None:
            return None
        if m == 0 or k >= m:
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _beta_cdf(m - k, k + 1, 1 - mid) > delta else (lo, mid)
        return (lo + hi) / 2

    return F.udf(bound, "double")(F.col(errors).cast("long"), F.col(n).cast("long"))


def threshold_table(scored: DataFrame, spark, points: int = 201, p: str = "p", y: str = "y") -> DataFrame:
    """tau, n, errors for tau = 0 … 1: each row is counted once, in the last grid cell it reaches, and cells are summed from above."""
    g = points - 1
    cells = scored.groupBy(F.floor(F.round(F.col(p) * g, 9)).cast("int").alias("cell")).agg(F.count("*").alias("n"), F.sum(1 - F.col(y)).alias("e"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("cell"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # ``points`` rows
    filled = grid.join(cells, "cell", "left").fillna(0)
    return filled.select((F.col("cell") / g).alias("tau"), F.sum("n").over(above).alias("n"), F.sum("e").over(above).cast("long").alias("errors"))


def select_threshold(scored: DataFrame, spark, alpha: float = 0.1, delta: float = 0.1, **k) -> DataFrame:
    """One row tau, coverage, risk, ucb, feasible: the largest coverage whose bound is at most alpha; of equals the least tau; else tau = 1."""
    t = threshold_table(scored, spark, **k).withColumn("ucb", clopper_pearson_upper("errors", "n", delta))
    best = t.filter((F.col("ucb") <= alpha) & (F.col("n") > 0)).orderBy(F.desc("n"), "tau").limit(1)
    total = scored.agg(F.count("*").alias("all_n"))
    return total.join(best, how="left").select(
        F.coalesce("tau", F.lit(1.0)).alias("tau"), F.coalesce(F.col("n") / F.col("all_n"), F.lit(0.0)).alias("coverage"),
        (F.col("errors") / F.col("n")).alias("risk"), F.coalesce("ucb", F.lit(1.0)).alias("ucb"), F.col("tau").isNotNull().alias("feasible"),
    )


def token_f1(a: Column, b: Column) -> Column:
    """Multiset F1 of two token arrays; 1 if both are empty, 0 if one is."""
    from ..functions.text import let

    def score(v: Column) -> Column:
        a, b = v["a"], v["b"]
        hit = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda u: u == t)), F.size(F.filter(b, lambda u: u == t))))
        empty = (F.size(a) == 0) | (F.size(b) == 0)
        return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(empty, 0.0).otherwise(2.0 * hit / (F.size(a) + F.size(b)))

    return let(F.struct(a.alias("a"), b.alias("b")), score)


def best_over_golds(score, pred: Column, golds: Column) -> Column:
    """The best score(pred, gold) over an array of golds, 0 without any; pred and golds may be token arrays."""
    from ..functions.text import let

    return let(F.struct(pred.alias("p"), golds.alias("g")), lambda v: F.when(F.size(v["g"]) == 0, 0.0).otherwise(F.array_max(F.transform(v["g"], lambda g: score(v["p"], g)))))


def set_f1(preds: Column, golds: Column) -> Column:
    """Of arrays of token arrays: each prediction in turn takes its best gold that is left (the first of equals); F1 of the sums."""
    from ..functions.text import let

    def matched(v: Column) -> Column:
        none = F.array().cast("array<int>")
        places = F.sequence(F.lit(0), F.greatest(F.size(v["g"]) - 1, F.lit(0)))

        def take(state: Column, p: Column) -> Column:
            left = F.filter(places, lambda i: ~F.array_contains(state["used"], i))
            scores = F.transform(left, lambda i: F.struct(token_f1(p, F.get(v["g"], i)).alias("f"), (-i).alias("i")))
            best = F.array_max(scores)
            return F.when(F.size(left) == 0, state).otherwise(F.struct((state["total"] + best["f"]).alias("total"), F.concat(state["used"], F.array(-best["i"])).alias("used")))

        total = F.aggregate(v["p"], F.struct(F.lit(0.0).alias("total"), none.alias("used")), take, lambda s: s["total"])
        # Of precision and recall with one numerator, F1 is twice it over both sizes.
        return F.when((F.size(v["p"]) == 0) | (F.size(v["g"]) == 0), ((F.size(v["p"]) == 0) & (F.size(v["g"]) == 0)).cast("double")).otherwise(2 * total / (F.size(v["p"]) + F.size(v["g"])))

    return let(F.struct(preds.alias("p"), golds.alias("g")), matched)


def canonical(tokens: Column, classes: Column | None = None) -> Column:
    """Each token's class of synonyms (a map from words to the representative), stemmed."""
    from ..functions.veto import stem

    return F.transform(tokens, lambda t: stem(t if classes is None else F.coalesce(F.try_element_at(classes, t), t)))


def soft_f1(pred: Column, gold: Column, vetoed: Column, classes: Column | None = None) -> Column:
    """Tier 3: F1 over canonical tokens, never below token F1, and no more than it where a check fires."""
    base = token_f1(pred, gold)
    return F.when(vetoed, base).otherwise(F.greatest(base, token_f1(canonical(pred, classes), canonical(gold, classes))))


def qa_aggregate(rows: DataFrame, tiers: list[str], f1: str, answerable: str = "is_answerable", abstained: str = "abstained") -> DataFrame:
    """One row: n, the mean of each tier, n_hasans, hasans_f1, n_noans, noans_f1 (share that abstains), abstention_rate."""
    has, out = F.col(answerable), F.col(abstained).cast("double")
    return rows.agg(F.count("*").alias("n"), *[F.avg(t).alias(t) for t in tiers], F.count_if(has).alias("n_hasans"), F.avg(F.when(has, F.col(f1))).alias("hasans_f1"), F.count_if(~has).alias("n_noans"), F.avg(F.when(~has, out)).alias("noans_f1"), F.avg(out).alias("abstention_rate"))


def decide(policy: str, confidence: str, tau: str, vetoed: str, feasible: str) -> Column:
    """answered: always, threshold, fused_veto (a veto abstains) or conformal (as that, 0.5 where no tau is feasible)."""
    p, c = F.col(policy), F.col(confidence)
    bar = F.when((p == "conformal") & ~F.col(feasible), 0.5).otherwise(F.col(tau))
    return F.when(p == "always", True).when(p == "threshold", c >= bar).otherwise(~F.col(vetoed) & (c >= bar))
