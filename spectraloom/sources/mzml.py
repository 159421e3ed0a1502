"""mzML as a table of spectra: Spark's XML reader splits files at <spectrum>, an Arrow function decodes the peak arrays, and back."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import rt_bin

# Accessions of the controlled vocabulary.
MS_LEVEL, SCAN_START, TARGET, LOWER, UPPER = "MS:1000511", "MS:1000016", "MS:1000827", "MS:1000828", "MS:1000829"
MZ_ARRAY, INTENSITY_ARRAY, FLOAT64, FLOAT32, ZLIB, MINUTE = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000521", "MS:1000574", "UO:0000031"
_PARAM = "array<struct<_accession:string,_value:string,_unitAccession:string>>"
SCHEMA = (
    f"_id string, _index long, cvParam {_PARAM},"
    f" scanList struct<scan:array<struct<cvParam:{_PARAM}>>>,"
    f" precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_PARAM}>>>>,"
    f" binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_PARAM},binary:string>>>"
)
OUT = "file string, scan_id string, scan_index long, ms_level int, rt double, mz array<double>, intensity array<double>, target_mz double, lower_offset double, upper_offset double"


def _value(params: Column, accession: str, field: str = "_value") -> Column:
    """Of an array of cvParam: the value (or unit) of an accession, null without it."""
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))[field]


def decode(params, text: str | None) -> np.ndarray:
    """A binary array: base64, zlib if so marked, 32 or 64 bits."""
    names = {p["_accession"] for p in params}
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if ZLIB in names and raw else raw
    return np.frombuffer(raw, dtype="<f4" if FLOAT32 in names else "<f8").astype(np.float64)


PEAKS = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mz", "intensity")])


@F.pandas_udf(PEAKS)
def _peaks(arrays: pd.Series) -> pd.DataFrame:
    """Peaks by rising m/z from a spectrum's binary arrays."""
    out = []
    for own in arrays:
        found = {MZ_ARRAY: np.empty(0), INTENSITY_ARRAY: np.empty(0)}
        for a in own if own is not None else []:
            for name in found:
                if any(p["_accession"] == name for p in a["cvParam"]):
                    found[name] = decode(a["cvParam"], a["binary"])
        mz, intensity = found.values()
        order = np.argsort(mz, kind="stable")
        out.append((mz[order].tolist(), intensity[order].tolist()))
    return pd.DataFrame(out, columns=["mz", "intensity"])


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of one or many mzML files: see OUT for the columns; rt in seconds, peaks by rising m/z.

    Parameters are read as columns. Peak arrays are decoded in a column of their own, which a plan that
    needs no peaks leaves out.
    """
    rows = spark.read.format("xml").option("rowTag", "spectrum").option("attributePrefix", "_").schema(SCHEMA).load(path)
    params, scan = F.col("cvParam"), F.get("scanList.scan", F.lit(0))["cvParam"]
    window = F.get("precursorList.precursor", F.lit(0))["isolationWindow"]["cvParam"]
    number = lambda p, a: _value(p, a).try_cast("double")
    flat = rows.select(
        F.input_file_name().alias("file"),
        F.col("_id").alias("scan_id"),
        F.col("_index").alias("scan_index"),
        number(params, MS_LEVEL).cast("int").alias("ms_level"),
        (number(scan, SCAN_START) * F.when(_value(scan, SCAN_START, "_unitAccession") == MINUTE, 60.0).otherwise(1.0)).alias("rt"),
        _peaks(F.col("binaryDataArrayList.binaryDataArray")).alias("peaks"),
        *(number(window, a).alias(n) for a, n in ((TARGET, "target_mz"), (LOWER, "lower_offset"), (UPPER, "upper_offset"))),
    )
    return flat.select("file", "scan_id", "scan_index", "ms_level", "rt", "peaks.mz", "peaks.intensity", "target_mz", "lower_offset", "upper_offset")


@F.pandas_udf(T.StringType())
def _packed(values: pd.Series) -> pd.Series:
    """Doubles as zlib-compressed base64; null and empty as an empty string."""
    return values.map(lambda v: base64.b64encode(zlib.compress(np.asarray(v, dtype="<f8").tobytes())).decode() if v is not None and len(v) else "")


def write_mzml(spectra: DataFrame, path: str, interval: float | None = None) -> None:
    """Spectra as mzML files in a folder, a file for each task; with `interval` a folder for each retention-time bin, so that a search reads its bin alone.

    Files hold what `read_mzml` reads (parameters, isolation window, peaks as zlib-compressed doubles), not
    the instrument's description.
    """
    cv = lambda accession, value, unit=None: F.struct(F.lit(accession).alias("_accession"), (F.lit("") if value is None else value.cast("string")).alias("_value"), F.lit(unit).cast("string").alias("_unitAccession"))
    array = lambda name, kind: F.struct(F.array(cv(FLOAT64, None), cv(ZLIB, None), cv(kind, None)).alias("cvParam"), _packed(F.col(name)).alias("binary"))
    window = F.struct(F.struct(F.array(*(cv(a, F.col(n)) for a, n in ((TARGET, "target_mz"), (LOWER, "lower_offset"), (UPPER, "upper_offset")))).alias("cvParam")).alias("isolationWindow"))
    rows = spectra.select(
        F.col("scan_id").alias("_id"),
        F.col("scan_index").alias("_index"),
        F.array(cv(MS_LEVEL, F.col("ms_level"))).alias("cvParam"),
        F.struct(F.array(F.struct(F.array(cv(SCAN_START, F.col("rt"), "UO:0000010")).alias("cvParam"))).alias("scan")).alias("scanList"),
        F.when(F.col("target_mz").isNotNull(), F.struct(F.array(window).alias("precursor"))).alias("precursorList"),
        F.struct(F.array(array("mz", MZ_ARRAY), array("intensity", INTENSITY_ARRAY)).alias("binaryDataArray")).alias("binaryDataArrayList"),
        *([rt_bin(F.col("rt"), interval).alias("rt_part")] if interval else []),
    )
    writer = rows.write.mode("overwrite").format("xml").option("rowTag", "spectrum").option("rootTag", "mzML").option("attributePrefix", "_")
    (writer.partitionBy("rt_part") if interval else writer).save(path)


def write_partitioned(spectra: DataFrame, path: str, interval: float = 120.0) -> None:
    """Spectra as Parquet, a folder for each retention-time bin, so that a search reads its bin alone."""
    spectra.withColumn("rt_part", rt_bin(F.col("rt"), interval)).write.mode("overwrite").partitionBy("rt_part").parquet(path)
