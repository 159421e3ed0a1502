"""Every catalogued query against its SQL in DuckDB at the smallest size, and the whole plan end to end."""

import importlib.util
import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spectraloom.config import EngineConfig
from spectraloom.plans import catalog, pipeline
from spectraloom.sources import search_results

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(DATA)), duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a = sorted(tuple(cell(r[n]) for n in names) for r in got.collect())
    at = [want.columns.index(n) for n in names]
    assert a == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    catalog.QUERIES[name](spark, str(DATA)).collect()


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it now raises ImportError
    spec = importlib.util.spec_from_file_location("entry_alone", Path(__spark_entry__.__file__))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE)


def test_nothing_else_imports_the_text_operators():
    root = Path(catalog.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]


def test_whole_plan(spark):
    peptides = [("PEPTIDEK", 2), ("ELVISK", 2), ("SAMPLER", 3)]
    psms = [(i, "run", f"scan={i % 6}", *peptides[i % 3], 0.001, i % 5 == 0, 10.0 + i % 3 + i / 100) for i in range(30)]
    p = spark.createDataFrame(psms, "psm_id long, filename string, scannr string, peptide string, charge int, spectrum_q double, is_decoy boolean, rt double")
    p = p.withColumn("scannr", F.concat("scannr", F.lit("/"), "psm_id"))
    for c in ("fragment_ppm", "rank", "delta_next", "delta_rt_model", "matched_peaks", "longest_b", "longest_y", "matched_intensity_pct", "peptide_q", "precursor_ppm", "hyperscore", "poisson", "delta_best", "expmass", "peptide_len", "missed_cleavages", "num_proteins"):
        p = p.withColumn(c, F.col("psm_id") * 1.0)
    p = p.withColumns({"calcmass": F.lit(900.0), "proteins": F.lit("sp")})
    f = p.select("psm_id").crossJoin(spark.createDataFrame([("b1/1",), ("b2/1",), ("y1/1",)], "fragment_name string")).withColumn("fragment_intensity", F.pmod(F.xxhash64("psm_id", "fragment_name"), F.lit(1000)) + 1.0)
    spectra = spark.createDataFrame([("f", "ms1", 0, 1, [451.007276466812], [5.0])], "file string, scan_id string, scan_index long, ms_level int, mz array<double>, intensity array<double>")
    pin = pipeline.feature_table(search_results.load(p, f), spectra, EngineConfig(rt_limit=10.0))
    got = pin.toPandas()
    assert got.shape == (3, 111) and not got.isna().any().any()
    proteins = spark.createDataFrame([("sp1", "PEPTIDEKELVISKSAMPLER")], "identifier string, sequence string")
    windows, width = pipeline.peptide_windows(proteins, p.withColumn("fragment_intensity", F.lit(1.0)))
    assert width >= 0 and windows.where("predictions_lower > predictions_upper").count() == 0 and windows.count() > 3
