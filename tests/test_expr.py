"""Hand-computed cases of expressions and kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import expr as X
from spectraloom.functions import kernels as K


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_mass_shifts(spark):
    assert len(X.MASS_SHIFTS) == 31
    assert one(spark, X.replace_mass_shift(F.lit("PEPC[+57.021465]TM[+15.9949]IDE[+1.0]"))) == "PEPC[Carbamidomethyl]TM[Oxidation]IDE[+1.0]"
    assert one(spark, X.replace_mass_shift(F.lit(None).cast("string"))) is None


def test_text(spark):
    assert one(spark, X.strip_modifications(F.lit("PEPM[Oxidation]K[Acetyl]"))) == "PEPMK"
    assert one(spark, X.base_sequence(F.lit("PEPTIDEM[OX]"))) == "PEPTIDEM"
    assert one(spark, X.fragment_name(F.lit("b"), F.lit(3), F.lit(1))) == "b3/1"
    assert one(spark, X.peptidoform(F.lit("PEP"), F.lit(2))) == "PEP/2"
    assert tuple(one(spark, X.split_ion(F.lit("y12^2")))) == ("y", 12, 2)
    assert tuple(one(spark, X.split_ion(F.lit("b3")))) == ("b", 3, 1)
    assert one(spark, X.find(F.lit("PEPTIDE"), "TI")) == 3 and one(spark, X.find(F.lit("PEPTIDE"), "X")) == -1
    assert [one(spark, X.label(F.lit(b).cast("boolean"))) for b in (True, False, None)] == [-1, 1, 1]


def test_masses(spark):
    assert one(spark, X.ppm_error(F.lit(500.26), F.lit(500.25))) == pytest.approx(19.98, abs=0.1)
    assert one(spark, X.precursor_mz(F.lit(1000.0), F.lit(2))) == pytest.approx(501.007276466812)
    assert one(spark, X.mass_of(F.lit("GG"))) == pytest.approx(2 * 57.02146372 + 18.0105646837)
    assert one(spark, X.mass_of(F.lit("GX"))) is None


def test_safe_divide(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (3.0, 3.0), (4.0, 0.0), (5.0, 5.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(X.safe_divide(F.col("a"), F.col("b"))).collect()] == [1, 0, 1, 0, 1, 0]


@pytest.mark.parametrize("values,qs,want", [([5.0, 1, 4, 2, 3], (50,), [3.0]), ([5.0], (50,), [5.0]), ([3.0] * 4, (50,), [3.0]), ([float(i) for i in range(1, 11)], (25, 50, 75), [3.25, 5.5, 7.75]), ([], (50,), [0.0])])
def test_percentiles(spark, values, qs, want):
    assert one(spark, X.percentiles(F.array(*map(F.lit, values)).cast("array<double>"), qs)) == want


def test_percentiles_with_index(spark):
    v, i = F.array(*map(F.lit, (0.9, 0.1, 0.5))), F.array(*map(F.lit, (7, 8, 9)))
    assert [tuple(p) for p in one(spark, X.percentiles_with_index(v, i, (0, 50, 100)))] == [(0.1, 8), (0.5, 9), (0.9, 7)]
    assert [tuple(p) for p in one(spark, X.percentiles_with_index(v, i, (0, 50, 100), positional=True))] == [(0.9, 7), (0.1, 8), (0.5, 9)]


def test_top_values(spark):
    assert one(spark, X.top_values(F.array(*map(F.lit, (5.0, 1.0, 3.0, 4.0, 2.0))), 3)) == [5, 4, 3]
    assert one(spark, X.top_values(F.array(F.lit(2.0)), 3)) == [2, 0, 0]


def test_correlation_and_cosine(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 5.0), ("b", 1.0, 7.0), ("c", 0.0, 1.0), ("c", 1.0, 0.0), ("d", 0.1 + 0.2, 1.0), ("d", 0.3, 2.0), ("e", None, 1.0)], "k string, x double, y double")
    got = {r["k"]: r for r in rows.groupBy("k").agg(X.safe_corr(F.col("x"), F.col("y")).alias("r"), X.safe_corr(F.col("x"), F.col("y"), None).alias("n"), X.cosine(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got["a"]["r"] == pytest.approx(1) and got["a"]["c"] == pytest.approx(1)
    assert got["b"]["r"] == 0 and got["b"]["n"] is None and got["d"]["r"] == 0
    assert got["c"]["r"] == pytest.approx(-1) and got["c"]["c"] == 0
    assert got["e"]["r"] == 0


def test_isotope_peaks(spark):
    mz, i = F.array(*map(F.lit, (499.498, 500.0, 500.001, 500.5017))), F.array(*map(F.lit, (10.0, 5.0, 7.0, 3.0)))
    got = X.isotope_peaks(mz, i, F.lit(500.0), F.lit(2))
    assert [one(spark, got[k]) for k in ("M-1", "M", "M+1")] == [10, 7, 3]
    assert one(spark, X.peak_intensity(F.array().cast("array<double>"), F.array().cast("array<double>"), F.lit(5.0))) == 0


def test_lasso_and_p_value():
    rng = np.random.default_rng(1)
    x = rng.random((60, 3))
    w, b = K.nn_lasso(x, x @ [2.0, 0.0, 0.5] + 0.3, alpha=1e-6)
    assert np.allclose(w, [2, 0, 0.5], atol=1e-2) and b == pytest.approx(0.3, abs=1e-2)
    assert (K.nn_lasso(x, -x[:, 0], alpha=0.01)[0] >= 0).all()
    assert K.pearson_pvalue(0.5, 10) == pytest.approx(0.1411, abs=2e-4)
    assert K.pearson_pvalue(0.9, 5) == pytest.approx(0.0374, abs=2e-4)
    assert K.pearson_pvalue(1.0, 5) == 0 and math.isnan(K.pearson_pvalue(0.5, 2)) and K.pearson_pvalue(0.0, 9) == 1
    assert np.allclose(K.pearson_pvalue([0.5, -0.3, 0.9], [4, 4, 3]), [0.5, 0.7, 1 - 2 / math.pi * math.asin(0.9)])


def test_feature_columns(spark):
    v, i = F.lit([3.0, 1.0, 2.0]), F.lit([30.0, 10.0, 20.0])
    got = lambda c: list(spark.range(1).select(*(x.alias(n) for n, x in c.items())).first())
    assert got(X.feature_columns(v, "f", (0, 50, 100), "percentile")) == [1.0, 2.0, 3.0]
    assert got(X.feature_columns(v, "f", (0, 50), "percentile", i)) == [1.0, 2.0, 10.0, 20.0]
    assert list(X.feature_columns(v, "f", (1, 2, 3, 4), "top", i)) == ["f_1", "f_2", "f_3", "f_4", "f_1_idx", "f_2_idx", "f_3_idx", "f_4_idx"]
    assert got(X.feature_columns(v, "f", (1, 2, 3, 4), "top", i)) == [3.0, 2.0, 1.0, 0.0, 30.0, 20.0, 10.0, 0.0]
    assert got(X.feature_columns(F.array().cast("array<double>"), "f", (1, 2), "top")) == [0.0, 0.0]
    with pytest.raises(ValueError, match="unknown method"):
        X.feature_columns(v, "f", (1,), "mean")
