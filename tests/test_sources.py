"""FASTA, text tables, mzML, stage cache, settings and streaming forms."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom import config as C
from spectraloom import streaming
from spectraloom.operators import digest as D
from spectraloom.sources import mzml, tables


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|A first protein\nPEPT\nIDEK\n>sp|B\r\nSEQUENCER\r\n>sp|C x\nTESTPEPTIDER\n")
    got = {r["identifier"]: r["sequence"] for r in tables.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"sp|A first protein": "PEPTIDEK", "sp|B": "SEQUENCER", "sp|C x": "TESTPEPTIDER"}
    peptides = D.digest(D.with_decoys(tables.read_fasta(spark, str(tmp_path / "a.fasta")), kinds=("original",)))
    assert {r["id"] for r in peptides.collect()} == {"sp|A|0|8", "sp|B|0|9", "sp|C|0|12"}
    tables.write_fasta(peptides, str(tmp_path / "out"))
    back = tables.read_fasta(spark, str(tmp_path / "out"))
    assert sorted(r["sequence"] for r in back.collect()) == ["PEPTIDEK", "SEQUENCER", "TESTPEPTIDER"]


def test_text_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [])], "id long, s string, v array<double>")
    tables.write_pin(df, str(tmp_path / "pin"))
    assert len(list((tmp_path / "pin").glob("part-*"))) == 1
    got = tables.read_pin(spark, str(tmp_path / "pin"), "id long, s string, v string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "[1.0]"), (2, "b", "[]")]
    tables.write_csv(df.select("id", "s"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_stage_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    cache = tables.StageCache(spark, str(tmp_path))
    assert cache.get("s", {"q": 1}, make).count() == cache.get("s", {"q": 1}, make).count() == 3 and len(made) == 1
    cache.get("s", {"q": 2}, make)
    assert len(made) == 2
    tables.StageCache(spark, str(tmp_path), read=False, write=False).get("s", {"q": 1}, make)
    assert len(made) == 3
    asked, known = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("z", 9)], "k string, v int")
    got = tables.cached_predictions(asked, known, "k", lambda df: df.select("k", F.lit(5).alias("v")))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 5)}


def array_xml(values, name, bits, packed):
    raw = np.array(values, dtype="<f8" if bits == 64 else "<f4").tobytes()
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    params = [f"MS:100052{3 if bits == 64 else 1}", "MS:1000574" if packed else "MS:1000576", name]
    return f'<binaryDataArray encodedLength="{len(text)}">' + "".join(f'<cvParam cvRef="MS" accession="{p}" name="x" value=""/>' for p in params) + f"<binary>{text}</binary></binaryDataArray>"


def spectrum_xml(i, level, rt, unit, mz, intensity, bits, packed, target=None):
    window = "" if target is None else f'<precursorList count="1"><precursor><isolationWindow><cvParam accession="MS:1000827" value="{target}"/><cvParam accession="MS:1000828" value="10"/><cvParam accession="MS:1000829" value="10"/></isolationWindow></precursor></precursorList>'
    return (
        f'<spectrum index="{i}" id="scan={i}" defaultArrayLength="{len(mz)}"><cvParam accession="MS:1000511" name="ms level" value="{level}"/>'
        f'<scanList count="1"><scan><cvParam accession="MS:1000016" value="{rt}" unitAccession="{unit}"/></scan></scanList>{window}'
        f'<binaryDataArrayList count="2">{array_xml(mz, "MS:1000514", bits, packed)}{array_xml(intensity, "MS:1000515", 32, packed)}</binaryDataArrayList></spectrum>'
    )


def test_mzml(spark, tmp_path):
    body = spectrum_xml(0, 1, 1.5, "UO:0000031", [600.0, 500.0], [2.0, 1.0], 64, True) + spectrum_xml(1, 2, 95.0, "UO:0000010", [100.5], [7.0], 32, False, 500.0) + spectrum_xml(2, 2, 130.0, "UO:0000010", [], [], 64, False)
    (tmp_path / "run.mzML").write_text(f'<?xml version="1.0" encoding="utf-8"?><mzML><run><spectrumList count="3">{body}</spectrumList></run></mzML>')
    s = mzml.read_mzml(spark, str(tmp_path / "run.mzML"))
    got = s.orderBy("scan_index").collect()
    assert [(r["scan_id"], r["ms_level"], r["rt"]) for r in got] == [("scan=0", 1, 90.0), ("scan=1", 2, 95.0), ("scan=2", 2, 130.0)]
    assert got[0]["mz"] == [500.0, 600.0] and got[0]["intensity"] == [1.0, 2.0] and got[1]["mz"] == [100.5]
    assert (got[1]["target_mz"], got[1]["lower_offset"]) == (500.0, 10.0) and got[0]["target_mz"] is None and got[2]["mz"] == []
    mzml.write_partitioned(s, str(tmp_path / "parts"))
    assert {p.name for p in (tmp_path / "parts").glob("rt_part=*")} == {"rt_part=120.0", "rt_part=240.0"}


def test_run(spark, tmp_path):
    """The command line's path from files to q-values."""
    from spectraloom.operators.spectra import random_spectra
    from spectraloom.plans.pipeline import run

    peptides = [("PEPTIDEK", 2), ("ELVISK", 2), ("SAMPLER", 3), ("TESTK", 2), ("DECOYR", 2), ("KEYWRDK", 3)]
    p = spark.createDataFrame([(i, "run", f"scan={i}", *peptides[i % 6], 0.001, i % 6 > 3, 10.0 + i % 6 + i / 100) for i in range(60)], "psm_id long, filename string, scannr string, peptide string, charge int, spectrum_q double, is_decoy boolean, rt double")
    for c in ("fragment_ppm", "rank", "delta_next", "delta_rt_model", "matched_peaks", "longest_b", "longest_y", "matched_intensity_pct", "peptide_q", "precursor_ppm", "hyperscore", "poisson", "delta_best", "expmass", "peptide_len", "missed_cleavages", "num_proteins"):
        p = p.withColumn(c, F.col("psm_id") * 1.0)
    p.withColumns({"calcmass": F.lit(900.0), "proteins": F.lit("sp")}).write.parquet(str(tmp_path / "psms"))
    f = p.select("psm_id").crossJoin(spark.createDataFrame([("b1/1",), ("b2/1",), ("y1/1",)], "fragment_name string"))
    f.withColumn("fragment_intensity", F.pmod(F.xxhash64("psm_id", "fragment_name"), F.lit(1000)) + 1.0).write.parquet(str(tmp_path / "fragments"))
    body = spectrum_xml(0, 1, 1.5, "UO:0000031", [451.007276466812], [2.0], 64, True) + spectrum_xml(1, 2, 95.0, "UO:0000010", [100.5], [7.0], 32, False, 500.0)
    (tmp_path / "run.mzML").write_text(f"<mzML><run><spectrumList>{body}</spectrumList></run></mzML>")
    config = C.EngineConfig(mzml_path=str(tmp_path / "run.mzML"), psm_path=str(tmp_path / "psms"), fragment_path=str(tmp_path / "fragments"), result_dir=str(tmp_path / "out"), rt_limit=10.0, write_search_cache=True, write_rt_cache=True, write_fragment_cache=True, write_correlation_cache=True)
    got = run(spark, config)
    assert got.count() == 6 and {"score", "q_value"} <= set(got.columns) and len(list((tmp_path / "out/cache").iterdir())) == 7
    assert run(spark, C.EngineConfig(**{**vars(config), "remove_intermediate_files": True})).count() == 6 and not (tmp_path / "out/cache").exists()
    assert run(spark, C.EngineConfig(**{**vars(config), "result_dir": str(tmp_path / "other"), "write_search_cache": False, "write_rt_cache": False, "write_fragment_cache": False, "write_correlation_cache": False, "rt_predictor": "composition", "fragment_predictor": "flat", "rescoring_rounds": 0})).count() == 6
    assert list((tmp_path / "other/cache").iterdir()) == []
    known = spark.createDataFrame([(x, 1.0) for x, _ in peptides], "peptide string, rt_predictions double")
    known.write.parquet(str(tmp_path / "known"))
    far = run(spark, C.EngineConfig(**{**vars(config), "result_dir": str(tmp_path / "third"), "known_rt": str(tmp_path / "known"), "rt_limit": 0.61}))
    assert {r["Peptide"] for r in far.select("Peptide").collect()} == {"PEPTIDEK"}  # nobody else elutes within 0.61 of the run from minute 1
    assert random_spectra(spark, 3).where(F.size("mz") == 50).count() == 3


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"ppm": 15, "rt_limit": 0.1, "min_count": "3", "enzyme": {"kr": 1}}))
    c = C.merged(["--config_file", str(file), "--ppm=5", "--no-transfer_learn"], {"SPECTRALOOM_RT_LIMIT": "0.2", "SPECTRALOOM_PPM": "7", "SPECTRALOOM_REMOVE_INTERMEDIATE_FILES": "Yes"})
    assert (c.ppm, c.rt_limit, c.min_count, c.transfer_learn, c.remove_intermediate_files) == (5.0, 0.2, 3, False, True)
    assert c.search == {"enzyme": {"kr": 1}}
    C.write(c, str(tmp_path / "x/out.json"))
    assert C.merged([], {}, str(tmp_path / "x/out.json")) == c
    assert C.merged([], {}) == C.EngineConfig()
    assert [C.coerced(w, True) for w in ("off", "on", "maybe", "")] == [False, True, True, False] and C.coerced("x", 1) == "x"
    for bad in (["--fdr_init_search=-1"], ["--model_type=x"], ["--min_len=9", "--max_len=5"], ["--ppm=0"]):
        with pytest.raises(ValueError):
            C.merged(bad, {})


SCANS = [("f", "A", 0, 1, 10.0), ("f", "x", 1, 2, 130.0), ("g", "early", 0, 2, 1.0)], [("f", "y", 2, 2, 140.0), ("f", "B", 3, 1, 250.0), ("f", "z", 4, 2, 260.0), ("g", "C", 1, 1, 2.0)]
SCHEMA = "file string, scan_id string, scan_index long, ms_level int, rt double"


def stream(spark, tmp_path, make, mode):
    source, out = tmp_path / "in", []
    query = None
    for i, batch in enumerate(SCANS):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if query is None:
            query = make(spark.readStream.schema(SCHEMA).parquet(str(source))).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
    query.stop()
    return out


def test_streamed_carry_forward(spark, tmp_path):
    got = stream(spark, tmp_path, streaming.carry_ms1, "append")
    assert sorted(r for b in got for r in b) == [("f", "x", "A"), ("f", "y", "A"), ("f", "z", "B")]


def test_streamed_bins(spark, tmp_path):
    got = stream(spark, tmp_path, streaming.bin_counts, "complete")
    assert sorted(got[-1]) == [("f", 120.0, 1, 10.0), ("f", 240.0, 2, 140.0), ("f", 360.0, 2, 260.0), ("g", 120.0, 2, 2.0)]


def test_mzml_round_trip(spark, tmp_path):
    rows = [("f", "scan=1", 0, 1, 12.5, [100.0, 200.5], [1.0, 2.0], None, None, None), ("f", "scan=2", 1, 2, 130.0, [], [], 500.25, 10.0, 12.0), ("f", "scan=3", 2, 2, 131.0, [50.0], [7.5], 510.0, 1.0, 1.0)]
    spectra = spark.createDataFrame(rows, mzml.OUT)
    mzml.write_mzml(spectra, str(tmp_path / "one"))
    mzml.write_mzml(spectra, str(tmp_path / "bins"), 120.0)
    for path in (tmp_path / "one", tmp_path / "bins"):
        got = mzml.read_mzml(spark, str(path)).drop("file", "rt_part").orderBy("scan_index").collect()
        assert [tuple(r) for r in got] == [r[1:] for r in rows]
    assert len(list((tmp_path / "bins").glob("rt_part=*"))) == 2
    plan = mzml.read_mzml(spark, str(tmp_path / "one")).select("scan_id", "rt")._jdf.queryExecution().optimizedPlan().toString()
    assert "_peaks" not in plan  # no peaks are decoded for a plan that needs none


def windowed_inputs(spark, tmp_path):
    """Spectra with all singly charged ions of three peptides, first-search PSMs and a FASTA file that holds them."""
    from spectraloom.functions import expr as X
    from spectraloom.operators.spectra import theoretical_ions

    own = [("PEPTIDEK", 600.0), ("ELVISLIVESK", 1200.0), ("SAMPLERSR", 1800.0)]
    p = spark.createDataFrame([(f"scan={i}", i, x, rt) for i, (x, rt) in enumerate(own)], "scan_id string, scan_index long, peptide string, rt double")
    ions = theoretical_ions(F.col("peptide"))
    s = p.select(F.lit("file:/x/run.mzML").alias("file"), "scan_id", "scan_index", F.lit(2).alias("ms_level"), "rt", F.sort_array(F.transform(ions, lambda i: i["mz"])).alias("mz"), F.transform(ions, lambda i, k: k + 1.0).alias("intensity"), (X.mass_of(F.col("peptide")) / 2 + F.lit(X.PROTON)).alias("target_mz"), F.lit(5.0).alias("lower_offset"), F.lit(5.0).alias("upper_offset"))
    (tmp_path / "p.fasta").write_text(">sp1\nPEPTIDEKELVISLIVESKSAMPLERSR\n")
    first = [(i, x, rt / 60, 0.001, 5.0, i) for i, (x, rt) in enumerate([*own, *own])]
    return s, spark.createDataFrame(first, "psm_id long, peptide string, rt double, spectrum_q double, fragment_intensity double, n int"), own


def test_windowed_search(spark, tmp_path):
    from spectraloom.operators.search import windowed_search
    from spectraloom.plans import pipeline

    s, first, own = windowed_inputs(spark, tmp_path)
    peptides = spark.createDataFrame([(x, False, rt - 60, rt + 60) for x, rt in own] + [("KEDITPEP", True, 500.0, 700.0), ("PEPTIDEK", False, 5000.0, 6000.0)], "peptide string, is_decoy boolean, predictions_lower double, predictions_upper double")
    psms, fragments = windowed_search(s, peptides, 120.0, 120.0)
    got = {r["peptide"]: r for r in psms.collect()}
    assert {x for x, _ in own} <= set(got) and all(got[x]["charge"] == 2 and got[x]["matched_peaks"] >= 2 * (len(x) - 1) - 2 for x, _ in own)
    assert got["PEPTIDEK"]["scannr"] == "scan=0" and len({r["psm_id"] for r in got.values()}) == len(got)
    assert fragments.join(psms, "psm_id").count() == fragments.count() > 30
    if "KEDITPEP" in got:
        assert got["KEDITPEP"]["hyperscore"] < got["PEPTIDEK"]["hyperscore"]
    late = spark.createDataFrame([("PEPTIDEK", False, 5000.0, 6000.0)], peptides.schema)
    assert windowed_search(s, late, 120.0, 120.0)[0].count() == 0  # not where it is predicted to elute
    config = C.EngineConfig(fasta_file=str(tmp_path / "p.fasta"), rt_interval=120.0)
    results = pipeline.searched(spark, s, first, config)
    best = {r["peptide"] for r in results.psms.where("NOT is_decoy").collect()}
    assert {x for x, _ in own} & best and "fragment_intensity" in results.psms.columns
