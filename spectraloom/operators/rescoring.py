"""Target-decoy q-values and cross-fitted rescoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOLDS = 3


RANGES = 256


def tdc_qvalues(psms: DataFrame, score: str = "score", decoy: str = "is_decoy", ranges: int = RANGES) -> DataFrame:
    """psms with q_value: the least (decoys + 1) / targets over all thresholds at or below the row's score, at most 1.

    Rows with equal scores share a threshold; null scores are below all others. Scores are cut into `ranges`
    ranges with about as many different scores: the running counts start from the totals of the ranges above, the running
    minimum is completed by those of the ranges below, so no task orders more than its own range.
    """
    rows = psms.withColumn("__score", F.col(score).cast("double"))
    d = F.coalesce(F.col(decoy), F.lit(False))
    steps = rows.groupBy("__score").agg(F.count_if(d).alias("__d"), F.count_if(~d).alias("__t"))
    # one row, from the same aggregate: the scored plan runs once for it and the steps
    cuts = steps.agg(F.array_distinct(F.percentile_approx("__score", [i / ranges for i in range(1, ranges)], 20 * ranges)).alias("__cuts"))
    steps = steps.crossJoin(F.broadcast(cuts))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(ranges.bit_length()))))  # binary search for the number of cuts up to the score
    at = F.aggregate(halves, F.lit(0), lambda i, h: F.when(F.get("__cuts", i + h - 1) <= F.col("__score"), i + h).otherwise(i))
    steps = steps.withColumn("__range", F.when(F.col("__score").isNull(), -1).otherwise(at)).drop("__cuts")
    above = W.orderBy(F.col("__range").desc()).rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy("__range").agg(F.sum("__d").alias("d"), F.sum("__t").alias("t"))  # at most `ranges` rows
    start = sums.select("__range", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("__d0"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("__t0"))
    falling = W.partitionBy("__range").orderBy(F.col("__score").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    decoys, targets = F.sum("__d").over(falling) + F.col("__d0"), F.sum("__t").over(falling) + F.col("__t0")
    rates = steps.join(start, "__range").withColumn("__fdr", F.least((decoys + 1) / F.greatest(targets, F.lit(1)), F.lit(1.0)))
    below = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    lows = rates.groupBy("__range").agg(F.min("__fdr").alias("m")).select("__range", F.min("m").over(below).alias("__low"))
    rising = W.partitionBy("__range").orderBy(F.col("__score").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    q = rates.join(lows, "__range").select(F.col("__score").alias("__s"), F.least(F.min("__fdr").over(rising), F.col("__low")).alias("q_value"))
    return rows.join(q, rows["__score"].eqNullSafe(q["__s"])).drop("__score", "__s")


def dense_network(n_features: int):
    """Classifier of the feature table: 103 inputs narrowing to 100, 50 and 20 units by default."""
    return MultilayerPerceptronClassifier(layers=[n_features, 100, 50, 20, 2], maxIter=100, seed=1, featuresCol="features", labelCol="target")


def linear_model(n_features: int):
    return LogisticRegression(maxIter=50, regParam=0.01, featuresCol="features", labelCol="target")


def rescored(pin: DataFrame, features: list[str], key: str = "SpecId", model: Callable = linear_model, folds: int = FOLDS, rounds: int = 0, train_q: float = 0.01) -> DataFrame:
    """pin with score and q_value: each fold is scored by a model that was fitted on the others, folds by a hash of the key.

    The first model is fitted on all targets against the decoys. Each of `rounds` further ones takes as
    positives only the targets whose q-value, by the model before, is `train_q` or less in its own training
    folds; it stops where there is none. A fold whose training lacks targets or decoys has the score 0.5.
    pin is read often, so it should be written.
    """
    rows = pin.withColumns({"__fold": F.pmod(F.xxhash64(key), F.lit(folds)), "target": (F.col("Label") > 0).cast("double")})
    rows = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="keep").transform(rows)
    if rows.limit(1).count() == 0:
        return pin.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("q_value"))
    rows = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(rows).transform(rows)

    def scored(fitted, df: DataFrame) -> DataFrame:
        return fitted.transform(df).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")

    classes = {(r["__fold"], r["target"]) for r in rows.select("__fold", "target").distinct().collect()}  # two rows a fold at most
    out = None
    for k in range(folds):
        training = rows.where(F.col("__fold") != k)
        if len({t for f, t in classes if f != k}) < 2:  # nothing to tell apart
            part = rows.where(F.col("__fold") == k).select(*pin.columns, F.lit(0.5).alias("score"))
            out = part if out is None else out.unionByName(part)
            continue
        fitted = model(len(features)).fit(training)
        for _ in range(rounds):
            judged = tdc_qvalues(scored(fitted, training).withColumn("__decoy", F.col("Label") < 0), "score", "__decoy")
            chosen = judged.where((F.col("Label") < 0) | (F.col("q_value") <= train_q)).drop("score", "q_value", "__decoy")
            if chosen.where("Label > 0").limit(1).count() == 0:
                break
            fitted = model(len(features)).fit(chosen)
        part = scored(fitted, rows.where(F.col("__fold") == k)).select(*pin.columns, "score")
        out = part if out is None else out.unionByName(part)
    return tdc_qvalues(out.withColumn("__decoy", F.col("Label") < 0), "score", "__decoy").drop("__decoy")
