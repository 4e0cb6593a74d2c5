import math

from pyspark.sql import functions as F

from quillspan.operators import metrics as M


def cdf(k, n, p):
    """Binomial CDF, its terms summed exactly after they are taken from logarithms."""
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_clopper_pearson_at_large_n(spark):
    cases = [(0, 10), (5, 100), (1600, 4000), (16000, 40000), (3, 10000), (9990, 10000), (30000, 100000)]
    got = spark.createDataFrame(cases, "errors long, n long").select("errors", "n", M.clopper_pearson_upper("errors", "n", 0.1).alias("u")).collect()
    for r in got:
        assert r.errors / r.n < r.u < 1 and abs(cdf(r.errors, r.n, r.u) - 0.1) < 1e-6, r


def test_no_threshold_above_the_risk_at_large_n(spark):
    scored = spark.range(40000).select((F.col("id") % 5 >= 2).cast("int").alias("y"), F.lit(1.0).alias("p"))
    assert not M.select_threshold(scored, spark, alpha=0.3).first().feasible
    assert M.select_threshold(scored, spark, alpha=0.42).first().feasible
