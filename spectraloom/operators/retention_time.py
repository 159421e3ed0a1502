"""Retention-time features, predictors by provider, error bounds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import RESIDUES
from ..schemas import require_columns
from .aggregates import exact_percentile, held, top_by

MODIFICATION = re.compile(r"\[.*?\]")
OTHER = len(RESIDUES)  # the code of what is no residue
CODES = np.full(128, OTHER)
CODES[[ord(r) for r in RESIDUES]] = range(OTHER)


def rt_features(psms: DataFrame, predictions: DataFrame, limit: float = 0.2, absolute: bool = True, relative: bool = True) -> DataFrame:
    """PSMs with rt_predictions and, as wanted, rt_prediction_error_abs and rt_prediction_error_abs_relative.

    The relative error is the absolute one over the table's greatest rt. Rows below `limit` stay, by the
    relative error if it is made, else by the absolute one, else all. Without a prediction there is no
    error, and such rows go if a limit applies; a greatest rt of 0 gives no relative error.
    """
    require_columns(psms, "peptide", "rt")
    require_columns(predictions, "peptide", "rt_predictions")
    out = psms.join(predictions.select("peptide", "rt_predictions"), "peptide", "left")
    error = F.abs(F.col("rt") - F.col("rt_predictions"))
    if relative:
        top = psms.agg(F.max("rt").alias("__top"))
        out = out.crossJoin(F.broadcast(top))  # a table of one row
    if absolute:
        out = out.withColumn("rt_prediction_error_abs", error)
    if relative:
        out = out.withColumn("rt_prediction_error_abs_relative", F.try_divide(error, F.col("__top"))).drop("__top")
        return out.where(F.col("rt_prediction_error_abs_relative") < limit)
    return out.where(F.col("rt_prediction_error_abs") < limit) if absolute else out


class RtProvider(Protocol):
    """Predicts retention times; `fit` returns a picklable function over a pandas series of peptides."""

    def fit(self, training: DataFrame) -> Callable[[pd.Series], pd.Series]: ...


def composition(peptides: pd.Series, ends: int = 0) -> np.ndarray:
    """Residue counts, length and a constant; with `ends`, also which residues stand at so many places from either end."""
    bare = [MODIFICATION.sub("", p) if "[" in p else p for p in peptides.fillna("")]
    n, size = len(bare), np.fromiter(map(len, bare), int, len(bare))
    points = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = CODES[np.minimum(points, 127)]
    counts = np.bincount(np.repeat(np.arange(n), size) * (OTHER + 1) + codes, minlength=n * (OTHER + 1)).reshape(n, OTHER + 1)
    places = []
    for i in (*range(ends), *range(-ends, 0)):
        there = size > i if i >= 0 else size >= -i
        code = np.full(n, OTHER)
        code[there] = codes[(np.cumsum(size) + np.where(i >= 0, -size, 0) + i)[there]]
        places.append(code[:, None] == np.arange(OTHER))
    return np.column_stack([counts[:, :OTHER], size, *places, np.ones(n)]).astype(float)


@dataclass(frozen=True)
class CompositionRt:
    """Ridge regression of rt on residue counts, and on the residues at `ends` places from either end.

    Its normal equations are summed over partitions, so any number of rows trains it.
    """

    ridge: float = 1.0
    ends: int = 0

    def fit(self, training: DataFrame) -> Callable[[pd.Series], pd.Series]:
        n, ends = len(RESIDUES) * (1 + 2 * self.ends) + 2, self.ends

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, b = np.zeros((n, n)), np.zeros(n)
            for pdf in batches:
                pdf = pdf.dropna()
                x = composition(pdf["peptide"], ends)
                a += x.T @ x
                b += x.T @ pdf["rt"].to_numpy(float)
            yield pd.DataFrame({"k": range(n * n + n), "v": np.concatenate([a.ravel(), b])})

        parts = training.select("peptide", "rt").mapInPandas(sums, "k int, v double").repartition(8, "k")  # a partition's sums are few: no file for each of many tasks
        got = parts.groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
        if not len(got):
            return lambda peptides: pd.Series(np.zeros(len(peptides)))
        w = np.linalg.solve(got[: n * n].reshape(n, n) + self.ridge * np.eye(n), got[n * n :])
        return lambda peptides: pd.Series((composition(peptides, ends) * w).sum(axis=1))  # a peptide's sum, whatever its batch


def predict_rt(peptides: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(peptide, rt_predictions) for the distinct peptides: each is predicted once, whatever the number of PSMs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"peptide": pdf["peptide"], "rt_predictions": model(pdf["peptide"]).to_numpy(float)})

    return peptides.select("peptide").where("peptide IS NOT NULL").distinct().mapInPandas(run, "peptide string, rt_predictions double")


def training_rows(psms: DataFrame, q: float = 0.01) -> DataFrame:
    """The most intense confident PSM of each peptide."""
    return top_by(psms.where(F.col("spectrum_q") < q).select("peptide", "rt", "fragment_intensity", "psm_id"), ["peptide"], "fragment_intensity", "psm_id")


def below_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows strictly below the exact percentile of the column."""
    with held(df.select(column)) as values:
        limit = exact_percentile(values, F.col(column), q)
    return df.where(F.col(column) < F.lit(limit).cast("double"))


def with_errors(rows: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Rows that have a peptide, with rt_predictions and error; each row is predicted where it is, so nothing is joined."""

    @F.pandas_udf("double")
    def predicted(peptides: pd.Series) -> pd.Series:
        return pd.Series(model(peptides).to_numpy(float))

    out = rows.where("peptide IS NOT NULL").withColumn("rt_predictions", predicted("peptide"))
    return out.withColumn("error", F.abs(F.col("rt") - F.col("rt_predictions")))


def retrained(psms: DataFrame, provider: RtProvider | None = None, exclude: float = 95, q: float = 0.01) -> tuple[Callable, Callable, float]:
    """(first model, model fitted again without the worst errors, twice the 95th percentile of its errors).

    The training rows are taken from the PSMs once and held, as are their errors, which the percentiles read several times.
    """
    provider = provider or CompositionRt()
    with held(training_rows(psms, q)) as rows:
        first = provider.fit(rows)
        with held(with_errors(rows, first).select("peptide", "rt", "error")) as judged:
            good = below_percentile(judged, "error", exclude).select("peptide", "rt")
            second = provider.fit(good)
            with held(with_errors(good, second).select("error")) as errors:
                width = exact_percentile(errors, F.col("error"), 95)
    return first, second, 2.0 * (width or 0.0)


def rt_bounds(peptides: DataFrame, width: float, factor: float = 60.0, coefficient: float = 1.0) -> DataFrame:
    """predictions in the run's time unit (times factor) and predictions_lower and _upper, half a width away on either side."""
    half = F.lit(width * factor * coefficient / 2.0)
    p = F.col("rt_predictions") * F.lit(factor)
    return peptides.withColumns({"predictions": p, "predictions_lower": p - half, "predictions_upper": p + half})

