"""Aggregates by key: top-1 with ties settled, first entry, collapsed columns, counts, pivots, percentiles, outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The table, evaluated once for all that reads it inside the block; if the caller holds it already, it stays held."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def top_by(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """The row of each key with the greatest value; ties go to the smallest of `ties`, then of the other columns. Null is below all values.

    One aggregate over a struct: combined before the shuffle, unlike a window.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(value).isNull().alias("none"), (-F.col(value)).alias("v"), *(F.col(t) for t in [*ties, *(c for c in rest if c not in ties)]))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__top")).select(*keys, "__top.*").select(*df.columns)


def max_fragment_per_psm(fragments: DataFrame) -> DataFrame:
    """The most intense fragment of each PSM."""
    return top_by(fragments, ["psm_id"], "fragment_intensity")


def max_fragment_per_peptide(fragments: DataFrame) -> DataFrame:
    """The most intense fragment of each peptide."""
    return top_by(fragments, ["peptide"], "fragment_intensity", "psm_id")


def first_entry(df: DataFrame, keys: list[str], columns: list[str], *order: str) -> DataFrame:
    """`columns` of each key's first row in the given order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first")).select(*keys, "__first.*")


def collapse(df: DataFrame, keys: list[str], largest: list[str] = (), least: list[str] = (), mean: list[str] = (), total: list[str] = (), first: list[str] = (), order: list[str] = ()) -> DataFrame:
    """One row per key: {column}_max, _min, _mean and _sum, and `first` from the first row in `order`. A single aggregate."""
    aggs = [f(F.col(f"`{c}`")).alias(f"{c}_{n}") for n, f, cs in (("max", F.max, largest), ("min", F.min, least), ("mean", F.avg, mean), ("sum", F.sum, total)) for c in cs]
    own = [c for c in first if c not in keys]
    if own:
        aggs.insert(0, F.min_by(F.struct(*own), F.struct(*order)).alias("__first"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "__first.*", *(f"`{c}`" for c in out.columns if c not in (*keys, "__first"))) if own else out


def with_counts(df: DataFrame, key: str = "peptide", least: int = 2) -> DataFrame:
    """Rows of keys that occur `least` times or more, with count; null keys go.

    Counting combines before the shuffle and the join is one to many, so Spark can broadcast few counts and
    split a frequent key, which a window could not.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
    return df.join(counts, key)


def multi_agg(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """max, mean, sample standard deviation, sum and count of a column by key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.sum(v).alias("sum"), F.count(F.lit(1)).alias("n"))


def pivot_sum(df: DataFrame, index: str, column: str, value: str, names: list[str]) -> DataFrame:
    """A column for each of the fixed `names` with the sum of `value`, 0 where there is none."""
    return df.groupBy(index).pivot(column, names).agg(F.sum(value)).fillna(0.0)


def non_zero_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many entries of each key differ from 0."""
    return df.groupBy(*keys).agg(F.count_if(F.col(value) != 0).alias("non_zero_count"))


def distinct_counts(**columns: tuple[DataFrame, str]) -> DataFrame:
    """One row: number of distinct values of each given column (null included once), for integrity checks."""
    out = None
    for name, (df, column) in columns.items():
        one = df.select(column).distinct().agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one aggregate each
    return out


def exact_percentile(df: DataFrame, value: Column, q: float, accuracy: int = 10_000) -> float | None:
    """Exact percentile with linear interpolation; null and NaN are left out, None without a value.

    An approximate one brackets it first, and the rows between are counted against those below, so that the
    exact step sees a ten-thousandth of the rows or so in place of every value of the table.
    """
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    shares = [max(q / 100 - 2 / accuracy, 0.0), min(q / 100 + 2 / accuracy, 1.0)]
    n, low, high, bounds = v.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.percentile_approx("v", shares, accuracy)).first()
    if not n:
        return None
    low, high = bounds[0] if shares[0] > 0 else low, bounds[1] if shares[1] < 1 else high
    inside = v.where(F.col("v").between(low, high))
    place = q / 100 * (n - 1)
    below, held = v.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
    if not (below <= math.floor(place) and math.ceil(place) < below + held):  # never with a bracket that keeps its promise
        inside, below, held = v, 0, n
    return inside.agg(F.percentile("v", (place - below) / max(held - 1, 1))).first()[0]


def percentile(df: DataFrame, value: Column, q: float, name: str) -> DataFrame:
    """One row: exact percentile with linear interpolation."""
    return df.sparkSession.createDataFrame([(exact_percentile(df, value, q),)], f"`{name}` double")


def iqr_outliers(df: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Rows outside [q1 - k*iqr, q3 + k*iqr] of their key."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    spread = (F.element_at("__q", 2) - F.element_at("__q", 1)) * k
    out = (F.col(value) < F.element_at("__q", 1) - spread) | (F.col(value) > F.element_at("__q", 2) + spread)
    return df.join(q, keys).where(out).drop("__q")


def zscore_outliers(df: DataFrame, keys: list[str], value: str, limit: float = 2.0) -> DataFrame:
    """Rows further than `limit` population standard deviations from the mean of their key."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    return df.join(s, keys).where(F.abs(F.col(value) - F.col("__mean")) > limit * F.col("__std")).drop("__mean", "__std")


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: slope, intercept and RMSE of y over x."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(fit))  # one row
    rmse = F.sqrt(F.avg(F.pow(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")), 2)))
    return both.agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), rmse.alias("rmse"))


def dense_ranks(df: DataFrame, partition: list[str], value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(W.partitionBy(*partition).orderBy(value)))


def ranks(df: DataFrame, partition: list[str], *order: str) -> DataFrame:
    """0-based place of each row in a total order, as `rank`."""
    return df.withColumn("rank", (F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))


def average_ranks(df: DataFrame, partition: list[str], value: str, name: str, ranges: int = 256) -> DataFrame:
    """1-based ranks; tied values share the mean of their places. Null is below all values.

    Values are counted first and cut into `ranges` ranges; a range's running counts start from the totals of those below,
    so no task orders a partition, however few there are. (Values that are no numbers are counted, but stay in one range.)
    """
    n, v = len(partition), F.col(value)
    steps = df.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(partition)), v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    keys = [f"__k{i}" for i in range(n)]
    at = F.lit(0)
    if isinstance(df.schema[value].dataType, T.NumericType):
        cuts = steps.agg(F.array_distinct(F.percentile_approx(F.col("__v").cast("double"), [i / ranges for i in range(1, ranges)], 20 * ranges)).alias("__cuts"))
        steps = steps.crossJoin(F.broadcast(cuts))  # one row
        halves = F.array(*(F.lit(1 << k) for k in reversed(range(ranges.bit_length()))))  # binary search for the number of cuts up to the value
        at = F.aggregate(halves, F.lit(0), lambda i, h: F.when(F.get("__cuts", i + h - 1) <= F.col("__v").cast("double"), i + h).otherwise(i))
    steps = steps.withColumn("__range", F.when(F.col("__v").isNull(), -1).otherwise(at)).select(*keys, "__v", "__n", "__range")
    lower = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy(*keys, "__range").agg(F.sum("__n").alias("__t"))  # at most `ranges` rows a partition
    starts = sums.select(*(F.col(k).alias(f"{k}s") for k in keys), F.col("__range").alias("__s"), F.coalesce(F.sum("__t").over(lower), F.lit(0)).alias("__start"))
    met = F.col("__range") == F.col("__s")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{k}s"))
    within = W.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__start") + F.coalesce(F.sum("__n").over(within), F.lit(0))
    out = steps.join(starts, met).select(*keys, "__v", (before + 1 + (F.col("__n") - 1) / 2).alias(name))
    met = v.eqNullSafe(F.col("__v"))
    for k, c in zip(keys, partition):
        met = met & F.col(c).eqNullSafe(F.col(k))
    return df.join(out, met).drop(*keys, "__v")


def relative_intensity(df: DataFrame, keys: list[str], value: str, least: float = 0.05) -> DataFrame:
    """Rows above `least` of their key's maximum, with relative_intensity."""
    top = F.max(value).over(W.partitionBy(*keys))
    return df.withColumn("relative_intensity", F.try_divide(F.col(value), top)).where(F.col("relative_intensity") > least)
