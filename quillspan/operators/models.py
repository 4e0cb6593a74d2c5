"""Fusion classifiers, calibrators and clustering on Spark ML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def fusion(train: DataFrame, test: DataFrame, features: list[str], kind: str, label: str = "y") -> DataFrame:
    """test with ``p``; kind: logreg (balanced, standardised), nb (gaussian, standardised) or gbdt."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    share = train.agg(F.avg(F.col(label).cast("double")).alias("_s"))
    train = train.join(F.broadcast(share)).withColumn("_w", F.when(F.col(label) == 1, 0.5 / F.col("_s")).otherwise(0.5 / (1 - F.col("_s"))))
    gather = VectorAssembler(inputCols=features, outputCol="_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    model = {
        "logreg": LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", probabilityCol="_p"),
        "nb": NaiveBayes(featuresCol="_x", labelCol=label, modelType="gaussian", probabilityCol="_p"),
        "gbdt": GBTClassifier(featuresCol="_raw", labelCol=label, maxIter=10, seed=1337).setProbabilityCol("_p"),
    }[kind]
    stages = [gather, model] if kind == "gbdt" else [gather, scale, model]
    out = Pipeline(stages=stages).fit(train).transform(test)
    return out.withColumn("p", vector_to_array("_p")[1]).select(*test.columns, "p")


def logit(p: str) -> Column:
    p = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def temperature(scored: DataFrame, spark: SparkSession, points: int = 250, p: str = "p", y: str = "y") -> DataFrame:
    """One row t, nll: the temperature of least log loss; equal (p, y) are counted before they meet the grid."""
    cells = scored.groupBy(p, y).agg(F.count("*").alias("n")).withColumn("z", logit(p))
    grid = cells.withColumn("t", F.explode(F.expr(f"transform(sequence(1, {points}), i -> 0.05 + i * 0.02)").cast("array<double>")))
    q = 1 / (1 + F.exp(-F.col("z") / F.col("t")))
    loss = -F.when(F.col(y) == 1, F.ln(F.greatest(q, F.lit(1e-12)))).otherwise(F.ln(F.greatest(1 - q, F.lit(1e-12))))
    return grid.groupBy("t").agg((F.sum(F.col("n") * loss) / F.sum("n")).alias("nll")).orderBy("nll", "t").limit(1)


def isotonic(train: DataFrame, test: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    fitted = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="q").fit(train.withColumns({p: F.col(p).cast("double"), y: F.col(y).cast("double")}))
    return fitted.transform(test)


def platt(train: DataFrame, test: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return fusion(train.withColumn("_z", logit(p)), test.withColumn("_z", logit(p)).withColumnRenamed(p, "_was"), ["_z"], "logreg", y).withColumnRenamed("p", "q").withColumnRenamed("_was", p).drop("_z")


def clusters(vectors: DataFrame, ks: tuple[int, ...], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """k, silhouette for each k, best first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features")).cache()
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=1337, maxIter=10).fit(x).transform(x)))) for k in ks]
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double").orderBy(F.desc("silhouette"), "k")
