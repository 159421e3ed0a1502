"""The wide feature table: one row per peptidoform, from collapsed PSM columns and correlation features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import label, spec_id
from .aggregates import collapse
from .fragments import KEYS

# Which columns are collapsed in which way.
MAX_COLUMNS = [
    "fragment_ppm", "rank", "delta_next", "delta_rt_model", "matched_peaks", "longest_b", "longest_y", "matched_intensity_pct",
    "spectrum_q", "peptide_q", "rt_prediction_error_abs_relative", "precursor_ppm", "hyperscore",
    "precursor_intensity_M", "precursor_intensity_M+1", "precursor_intensity_M-1",
]
MIN_COLUMNS = [
    "fragment_ppm", "rank", "delta_next", "delta_rt_model", "matched_peaks", "longest_b", "longest_y", "matched_intensity_pct",
    "fragment_intensity", "poisson", "spectrum_q", "peptide_q", "rt", "rt_predictions", "rt_prediction_error_abs",
    "rt_prediction_error_abs_relative", "precursor_ppm", "hyperscore", "delta_best",
    "precursor_intensity_M", "precursor_intensity_M+1", "precursor_intensity_M-1",
]
MEAN_COLUMNS = ["spectrum_q", "peptide_q", "precursor_intensity_M", "precursor_intensity_M+1", "precursor_intensity_M-1"]
SUM_COLUMNS = ["precursor_intensity_M", "precursor_intensity_M+1", "precursor_intensity_M-1"]
FIRST_COLUMNS = ["psm_id", "filename", "scannr", "peptide", "num_proteins", "proteins", "expmass", "calcmass", "is_decoy", "charge", "peptide_len", "missed_cleavages"]
# Headers of the exported table.
PIN_NAMES = {"expmass": "ExpMass", "calcmass": "CalcMass", "psm_id": "ScanNr", "peptide": "Peptide", "proteins": "Proteins", "is_decoy": "Label"}
NOT_FEATURES = ["SpecId", "ScanNr", "filename", "Peptide", "Proteins", "ExpMass", "CalcMass", "Label"]


def peptidoform_row(psms: DataFrame) -> DataFrame:
    """Collapsed columns by peptide and charge, the first PSM's (by rt, then psm_id) identity, label and SpecId: 59 columns."""
    out = collapse(psms, KEYS, MAX_COLUMNS, MIN_COLUMNS, MEAN_COLUMNS, SUM_COLUMNS, FIRST_COLUMNS, ["rt", "psm_id"])
    return out.withColumns({"is_decoy": label(F.col("is_decoy")), "SpecId": spec_id(F.col("psm_id"), F.col("filename"), F.col("scannr"))})


def pin_table(psms: DataFrame, correlations: DataFrame) -> DataFrame:
    """The exported table: both halves joined by peptidoform, headers renamed, null and NaN as 0. 111 columns, 103 of them features."""
    joined = peptidoform_row(psms).join(correlations, KEYS).drop("scannr")
    return joined.withColumnsRenamed(PIN_NAMES).fillna(0.0)
