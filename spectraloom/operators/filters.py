"""Filters, deduplication, semi and anti joins, quality-control predicates and set operations on PSM and fragment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def below_q(psms: DataFrame, q: float = 1.0, column: str = "spectrum_q") -> DataFrame:
    """Rows with q-value strictly below q; null and NaN go."""
    return psms.where(F.col(column) < q)


def without_residue(psms: DataFrame, part: str = "U", column: str = "peptide") -> DataFrame:
    """Rows whose peptide does not hold `part`; null goes."""
    return psms.where(~F.col(column).contains(part))


def near_apex(fragments: DataFrame, width: float = 3.0) -> DataFrame:
    """Rows within `width` of their peptide's apex (strictly); no apex goes."""
    return fragments.where(F.abs(F.col("rt") - F.col("rt_max_peptide_sub")) < width)


def first_rows(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key `others` has."""
    return df.join(others.select(key), key, "left_semi")


def orphans(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key `others` lacks."""
    return df.join(others.select(key), key, "left_anti")


def _endless(c: str) -> Column:
    return F.col(c).isin(float("inf"), float("-inf"))


PSM_CHECKS = {
    "bad_peptide": lambda: F.col("peptide").isNull() | (F.col("peptide") == ""),
    "bad_charge": lambda: F.col("charge") <= 0,
    "bad_rt": lambda: (F.col("rt") < 0) | _endless("rt"),
    "bad_q": lambda: (F.col("spectrum_q") < 0) | (F.col("spectrum_q") > 1),
}
FRAGMENT_CHECKS = {
    "bad_type": lambda: ~F.col("fragment_type").isin("a", "b", "c", "x", "y", "z"),
    "bad_intensity": lambda: (F.col("fragment_intensity") < 0) | _endless("fragment_intensity"),
}


def checked(df: DataFrame, checks: dict) -> DataFrame:
    """df with a boolean column for each check; null input counts as no finding but where the check asks for null."""
    return df.withColumns({n: F.coalesce(c(), F.lit(False)) for n, c in checks.items()})


def findings(df: DataFrame, checks: dict) -> DataFrame:
    """One row: how often each check finds something."""
    return checked(df, checks).agg(*(F.count_if(n).alias(n) for n in checks))


def common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that both have."""
    return a.select(column).intersect(b.select(column))


def only_first(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that only `a` has."""
    return a.select(column).subtract(b.select(column))


def concat(*parts: DataFrame) -> DataFrame:
    """Rows of all parts by column name, missing columns null."""
    out, *rest = parts
    for p in rest:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def threshold_counts(df: DataFrame, column: str, thresholds=(0.01, 0.025, 0.05, 0.1, 0.25)) -> DataFrame:
    """(threshold, n): rows at or below each threshold, in one pass."""
    row = df.agg(*(F.count_if(F.col(column) <= t).alias(str(i)) for i, t in enumerate(thresholds)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(str(i)).alias("n")) for i, t in enumerate(thresholds)))))


def histogram(df: DataFrame, column: str, width: float, *by: str) -> DataFrame:
    """Counts in left-closed bins of `width`, by further columns."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, F.floor(F.col(column) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
