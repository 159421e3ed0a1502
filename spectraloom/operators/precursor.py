"""Precursor isotope intensities: each PSM's MS1 spectrum is found through its MS2 scan, then three peaks are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import isotope_peaks, precursor_mz
from .joins import ms1_of_ms2, of_file


def precursor_intensities(psms: DataFrame, spectra: DataFrame, ppm: float = 20.0) -> DataFrame:
    """psms with precursor_intensity_M-1, _M and _M+1; 0 where the scan, its MS1 spectrum or the peak is missing.

    Scans are told apart by file and scan id (see `of_file`), so every PSM comes back once. What is asked
    about is gathered by MS1 spectrum first: its peaks are joined once for all PSMs that need them.
    """
    link, rows = of_file(ms1_of_ms2(spectra).withColumnRenamed("scan_id", "scannr"), psms, ["scannr"])
    keys = ["__file", "scannr", "charge", "calcmass"]
    asked = rows.select(*keys).distinct().join(link.select("__file", "scannr", "file", "ms1_scan_id"), ["__file", "scannr"])
    by_ms1 = asked.groupBy("file", "ms1_scan_id").agg(F.collect_list(F.struct(*keys)).alias("asked"))
    ms1 = spectra.where("ms_level = 1").select("file", F.col("scan_id").alias("ms1_scan_id"), "mz", "intensity")

    def found(a):
        peaks = isotope_peaks(F.col("mz"), F.col("intensity"), precursor_mz(a["calcmass"], a["charge"]), a["charge"], ppm)
        return F.struct(*(a[k].alias(k) for k in keys), *(v.alias(f"precursor_intensity_{n}") for n, v in peaks.items()))

    names = [f"precursor_intensity_{n}" for n in ("M-1", "M", "M+1")]
    peaks = by_ms1.join(ms1, ["file", "ms1_scan_id"]).select(F.inline(F.transform("asked", found)))
    met = [rows[k].eqNullSafe(peaks[k]) for k in keys]
    return rows.join(peaks, met[0] & met[1] & met[2] & met[3], "left").select(*(rows[f"`{c}`"] for c in psms.columns), *(F.coalesce(peaks[f"`{n}`"], F.lit(0.0)).alias(n) for n in names))
