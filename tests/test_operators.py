"""Hand-computed cases of operators on PSM and fragment tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import aggregates as A
from spectraloom.operators import digest as D
from spectraloom.operators import features as P
from spectraloom.operators import filters as L
from spectraloom.operators import fragments as M
from spectraloom.operators import joins as J
from spectraloom.operators import precursor as I
from spectraloom.operators import rescoring as Q
from spectraloom.operators import retention_time as R
from spectraloom.operators import search as E
from spectraloom.operators import spectra as S
from spectraloom.schemas import require_columns
from spectraloom.sources import search_results


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("least,peptides,want", [(2, ["P1", "P1", "P2", "P3", "P3", "P3"], 5), (1, ["P1", "P2", "P3"], 3), (3, ["P1", "P1", "P2", "P3"], 0), (2, ["", "", "P1", "P1"], 4), (2, [None, None, "P1", "P1"], 2), (0, ["P1", "P2"], 2)])
def test_counts(spark, least, peptides, want):
    assert A.with_counts(spark.createDataFrame([(p,) for p in peptides], "peptide string"), least=least).count() == want


PSMS = [("P1", 10.5), ("P2", 15.2), ("P3", 20.8), ("P4", 25.3)]
PREDS = [("P1", 10.8), ("P2", 14.9), ("P3", 22.1), ("P5", 30.5)]


def rt(spark, psms, preds, *args, **more):
    return R.rt_features(spark.createDataFrame(psms, "peptide string, rt double"), spark.createDataFrame(preds, "peptide string, rt_predictions double"), *args, **more)


def test_rt_features(spark):
    got = {r["peptide"]: r for r in rt(spark, PSMS, PREDS, 0.5).collect()}
    assert sorted(got) == ["P1", "P2", "P3"]
    assert got["P1"]["rt_prediction_error_abs"] == pytest.approx(0.3) and got["P2"]["rt_prediction_error_abs_relative"] == pytest.approx(0.3 / 25.3)
    assert rt(spark, PSMS, PREDS, 0.5, relative=False).count() == 2
    off = rt(spark, PSMS, PREDS, absolute=False, relative=False)
    assert off.count() == 4 and off.columns == ["peptide", "rt", "rt_predictions"]
    assert rt(spark, PSMS, [("X", 1.0)], 0.5).count() == 0
    assert rt(spark, [("a", 0.0), ("b", 10.0)], [("a", 1.0), ("b", 9.0)], 1.0).count() == 2
    assert rt(spark, [("a", -1.0), ("b", 10.0)], [("a", 0.0), ("b", 11.0)], 1.0).count() == 2
    assert rt(spark, [("a", 0.0)], [("a", 1.0)]).count() == 0  # no positive rt, so no relative error
    assert [r["rt_predictions"] for r in rt(spark, [("P1", 10.0), ("P1", 10.5)], [("P1", 10.2)], 1.0).collect()] == [10.2, 10.2]


def test_filters(spark):
    q = spark.createDataFrame([(1, 0.001), (2, 1.0), (3, float("nan")), (4, None)], "id long, spectrum_q double")
    assert rows(L.below_q(q).select("id"), "id") == [(1,)]
    p = spark.createDataFrame([("PEPU",), ("PEP",), (None,)], "peptide string")
    assert rows(L.without_residue(p), "peptide") == [("PEP",)]
    bad = spark.createDataFrame([(None, 0, -5.0, 1.5), ("", -1, math.inf, -0.1), ("P", 2, 1.0, 0.5)], "peptide string, charge int, rt double, spectrum_q double")
    assert tuple(L.findings(bad, L.PSM_CHECKS).first()) == (2, 2, 2, 2)
    frags = spark.createDataFrame([("b", -100.0), ("y", math.inf), ("unknown", 5.0)], "fragment_type string, fragment_intensity double")
    assert tuple(L.findings(frags, L.FRAGMENT_CHECKS).first()) == (1, 2)
    f, k = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,), (999,)], "psm_id long"), spark.createDataFrame([(1,), (2,), (3,)], "psm_id long")
    assert L.orphans(f, k, "psm_id").count() == 1 and L.members(f, k, "psm_id").count() == 5
    with pytest.raises(ValueError, match="charge"):
        require_columns(p, "peptide", "charge")


def test_loader(spark):
    psms = spark.createDataFrame([(1, "s1", "A[+15.9949]", 0.001, 2, 1.0), (2, "s2", "B", 0.005, 2, 2.0), (3, "s3", "C", 0.05, 2, 3.0), (4, "s1", "A[+15.9949]", 0.0, 2, 1.0)], "psm_id long, scannr string, peptide string, spectrum_q double, charge int, rt float")
    frags = spark.createDataFrame([(1, "b1", 1000.0), (1, "y1", 1500.0), (2, "b1", 800.0), (2, "y1", 1200.0), (3, "b1", 900.0)], "psm_id long, fragment_name string, fragment_intensity double")
    got = search_results.load(psms, frags, 0.01)
    assert got.fragments.count() == 4
    assert rows(got.psms.select("psm_id", "peptide", "fragment_intensity"), "psm_id") == [(1, "A[Oxidation]", 1500.0), (2, "B", 1200.0)]
    assert rows(got.fragment_max.select("psm_id", "fragment_name"), "psm_id") == [(1, "y1"), (2, "y1")]
    assert [df.count() for df in search_results.load(psms, frags, 0.0)] == [0, 0, 0, 0]


def test_top_rows_and_ties(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 5.0), ("b", 3, None), ("b", 4, 1.0)], "k string, id long, v double")
    assert rows(A.top_by(df, ["k"], "v", "id").select("k", "id"), "k")[0] == ("a", 1)
    assert rows(A.dense_ranks(spark.createDataFrame([(i, m) for i, m in enumerate((100.5, 200.2, 100.5, 300.1, 200.2))], "i int, mz double"), [], F.round("mz", 3), "r").select("i", "r"), "i") == [(0, 1), (1, 2), (2, 1), (3, 3), (4, 2)]


def test_range_joins_agree_with_nested_loops(spark):
    points = spark.range(200).select("id", (F.rand(1) * 50 - 5).alias("at"))
    ranges = spark.range(80).select(F.col("id").alias("rid"), (F.rand(2) * 50 - 5).alias("low")).withColumn("high", F.col("low") + F.rand(3) * 6 - 0.5)
    points, ranges = points.cache(), ranges.cache()
    want = points.join(ranges, (points["at"] >= ranges["low"]) & (points["at"] <= ranges["high"]) & (ranges["low"] <= ranges["high"]))
    got = J.range_join(points, ranges, F.col("at"), F.col("low"), F.col("high"), 2.5)
    assert rows(got.select("id", "rid"), "id", "rid") == rows(want.select("id", "rid"), "id", "rid")
    a = ranges.select(F.col("rid").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah")).where("al <= ah")
    b = ranges.select(F.col("rid").alias("b"), (F.col("low") + 3).alias("bl"), (F.col("high") + 7).alias("bh"))
    want = a.join(b, F.greatest("al", "bl") <= F.least("ah", "bh"))
    assert rows(J.interval_overlap_join(a, b, "al", "ah", "bl", "bh", 2.0).select("a", "b"), "a", "b") == rows(want.select("a", "b"), "a", "b")


def test_order(spark):
    scans = [("f", "m2early", 0, 2), ("f", "A", 1, 1), ("f", "x", 2, 2), ("f", "y", 3, 2), ("f", "B", 4, 1), ("f", "z", 5, 2), ("g", "w", 0, 2)]
    s = spark.createDataFrame(scans, "file string, scan_id string, scan_index long, ms_level int")
    assert rows(J.ms1_of_ms2(s).select("scan_id", "ms1_scan_id"), "scan_id") == [("x", "A"), ("y", "A"), ("z", "B")]
    bins = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (20.0,), (45.0,)], "rt double").select(J.rt_bin(F.col("rt"), 10.0).cast("int"))
    assert [r[0] for r in bins.collect()] == [10, 10, 20, 20, 50]
    ids = spark.createDataFrame([("p1", 0), ("p1", 4), ("p2", 0), ("p3", 2)], "part string, psm_id long")
    assert rows(J.running_offset(ids, "part").select("psm_id"), "psm_id") == [(0,), (4,), (5,), (8,)]
    g = spark.createDataFrame([("s1", 500.0, 10.0, 10.0), ("s2", 500.0, 10.0, 10.0), ("s3", None, 1.0, 1.0)], "scan_id string, target_mz double, lower_offset double, upper_offset double")
    assert rows(J.isolation_groups(g), "window") == [("490.0|510.0", ["s1", "s2"])]


def test_digest(spark):
    p = spark.createDataFrame([("sp1 x", "AKPRPEKRK"), ("sp2", "MMMMMKXXXXXR"), ("sp3", "")], "identifier string, sequence string")
    whole = D.digest(D.with_decoys(p, kinds=("original",)), 1, 50, 0)
    assert rows(whole.where("protein = 'sp1'").select("peptide", "start", "end"), "start") == [("AKPRPEK", 0, 7), ("R", 7, 8), ("K", 8, 9)]
    missed = D.digest(D.with_decoys(p, kinds=("original",)), 5, 50, 2)
    assert {r["peptide"] for r in missed.collect()} == {"AKPRPEK", "AKPRPEKR", "AKPRPEKRK", "MMMMMK"}
    decoys = D.with_decoys(p)
    assert {r["protein"] for r in decoys.collect()} == {"sp1", "sp2", "sp3", "rev_sp1", "rev_sp2", "rev_sp3"}
    mixed = D.with_decoys(p, "scramble", kinds=("decoy",)).where("protein = 'rev_sp1'").first()["sequence"]
    assert sorted(mixed) == sorted("AKPRPEKRK")
    with pytest.raises(ValueError):
        D.with_decoys(p, "other")


def fragment_rows(spark):
    f = [("PEP", 2, 1, "b1/1", 500.0, 10.0, 10.0), ("PEP", 2, 1, "y1/1", 1000.0, 10.0, 10.0), ("PEP", 2, 2, "b1/1", 200.0, 11.0, 10.0), ("PEP", 2, 2, "b2/1", 400.0, 11.0, 10.0), ("OTHER", 3, 3, "b1/1", 1.0, 5.0, 5.0)]
    p = [("PEP", 2, "b1/1", 0.2), ("PEP", 2, "y1/1", 0.4), ("PEP", 2, "y9/1", 0.1)]
    return spark.createDataFrame(f, "peptide string, charge int, psm_id long, fragment_name string, fragment_intensity double, rt double, rt_max_peptide_sub double"), spark.createDataFrame(p, "peptide string, charge int, fragment_name string, predicted double")


def test_fragment_features(spark):
    f, p = fragment_rows(spark)
    m = M.matrices(f, p)
    d = M.deviation(m).first()
    assert d["l1"] == pytest.approx((0.25 + 2.25) / 2) and d["sum_predicted"] == pytest.approx(1.5) and d["l1_total"] == pytest.approx((2.5 + 0.25) / 2)
    assert rows(M.apex_scores(m), "peptide") == [("PEP", 2, pytest.approx(1.0), pytest.approx(1.0))]
    assert M.apex_scores(M.matrices(f.drop("rt"), p)).count() == 0
    assert tuple(m.select("p", "observed").first()) == ([0.5, 0.0, 1.0, 0.25], [1, 1, 1, 0])
    assert [tuple(r) for r in m.first()["psms"]] == [(1, [0.5, 0.0, 1.0, 0.0]), (2, [0.5, 1.0, 0.0, 0.0])]
    row = M.correlation_row(m)
    assert row.first()["mse_avg_pred_intens_1"] == pytest.approx(d["l1"]) and row.first()["mse_avg_pred_intens_total_1"] == pytest.approx(d["l1_total"])
    assert len(row.columns) == 2 + 53 and row.count() == 1
    scores = {r["psm_id"]: r for r in M.psm_scores(m).collect()}
    assert scores[1]["n_observed"] == 2 and row.first()["top_correlation_individual_1"] == pytest.approx(scores[1]["correlation"])


def test_feature_table_width(spark):
    f, p = fragment_rows(spark)
    own = {c: F.lit(1.0) for c in {*P.MAX_COLUMNS, *P.MIN_COLUMNS} - {"rt"}}
    psms = spark.createDataFrame([(1, "PEP", 2, 10.0, False), (2, "PEP", 2, 11.0, False), (3, "OTHER", 3, 5.0, True)], "psm_id long, peptide string, charge int, rt double, is_decoy boolean").withColumns({**own, "filename": F.lit("f"), "scannr": F.lit("s"), "num_proteins": F.lit(1), "proteins": F.lit("p"), "expmass": F.lit(1.0), "calcmass": F.lit(1.0), "peptide_len": F.lit(3), "missed_cleavages": F.lit(0)})
    assert len(P.peptidoform_row(psms).columns) == 59
    pin = P.pin_table(psms, M.correlation_row(M.matrices(f, p)))
    assert len(pin.columns) == 111 and len([c for c in pin.columns if c not in P.NOT_FEATURES]) == 103
    assert pin.first()["SpecId"] == "1|f|s" and pin.first()["Label"] == 1


def test_precursors(spark):
    spectra = spark.createDataFrame([("f", "m1", 0, 1, [501.007, 501.0072], [5.0, 9.0]), ("f", "s", 1, 2, [], [])], "file string, scan_id string, scan_index long, ms_level int, mz array<double>, intensity array<double>")
    psms = spark.createDataFrame([(1, "s", 2, 1000.0), (2, "none", 2, 1000.0)], "psm_id long, scannr string, charge int, calcmass double")
    got = rows(I.precursor_intensities(psms, spectra).select("psm_id", "`precursor_intensity_M-1`", "precursor_intensity_M", "`precursor_intensity_M+1`"), "psm_id")
    assert got == [(1, 0.0, 9.0, 0.0), (2, 0.0, 0.0, 0.0)]


def test_scan_ids_repeat_between_files(spark):
    peaks = [("file:/data/a.mzML", 5.0), ("file:/data/b.mzML", 9.0)]
    scans = [row for f, i in peaks for row in ((f, "scan=0", 0, 1, [501.007276466812], [i]), (f, "scan=1", 1, 2, [58.0287], [i]))]
    spectra = spark.createDataFrame(scans, "file string, scan_id string, scan_index long, ms_level int, mz array<double>, intensity array<double>")
    psms = spark.createDataFrame([(1, "b.mzML", "scan=1", 2, 1000.0, "GAG"), (2, "a.mzML", "scan=1", 2, 1000.0, "GAG"), (3, "c.mzML", "scan=1", 2, 1000.0, "GAG"), (4, None, "scan=1", 2, None, "GAG")], "psm_id long, filename string, scannr string, charge int, calcmass double, peptide string")
    names = ["`precursor_intensity_M-1`", "precursor_intensity_M", "`precursor_intensity_M+1`"]
    got = rows(I.precursor_intensities(psms, spectra).select("psm_id", *names), "psm_id")
    assert got == [(1, 0.0, 9.0, 0.0), (2, 0.0, 5.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)]
    alone = rows(I.precursor_intensities(psms.drop("filename"), spectra).select("psm_id", *names), "psm_id")
    assert alone == [(1, 0.0, 5.0, 0.0), (2, 0.0, 5.0, 0.0), (3, 0.0, 5.0, 0.0), (4, 0.0, 0.0, 0.0)]
    assert rows(S.annotate(psms, spectra).select("psm_id", "fragment_name", "fragment_intensity"), "psm_id") == [(1, "b1/1", 9.0), (2, "b1/1", 5.0)]


def test_top_row_is_never_a_null_one(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 4, None)], "k string, id long, v double")
    assert rows(A.top_by(df, ["k"], "v", "id"), "k") == [("a", 2, 5.0), ("b", 4, None)]


def test_exact_percentile(spark):
    values = [float(x * x % 997) for x in range(1000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for q in (0, 2.5, 50, 95, 100):
        assert A.exact_percentile(df, F.col("v"), q, accuracy=50) == pytest.approx(np.percentile(values, q))
    assert A.exact_percentile(df.where("v < 0"), F.col("v"), 50) is None
    assert A.percentile(df.where("v < 0"), F.col("v"), 50, "p").first()["p"] is None
    assert R.below_percentile(df.where("v < 0"), "v", 50).count() == 0


def test_ions_of_higher_charge_and_with_losses(spark):
    ions = {i["fragment_name"]: i["mz"] for i in spark.range(1).select(S.theoretical_ions(F.lit("GAG"), F.lit(2), tuple(S.LOSSES)).alias("x")).first()["x"]}
    assert len(ions) == 2 * 2 * 2 * 3
    assert ions["b1/2"] == pytest.approx((57.02146372 + 2 * 1.007276466812) / 2) and ions["y1-H2O/1"] == pytest.approx(57.02146372 + 1.007276466812)
    assert ions["b2-NH3/1"] == pytest.approx(57.02146372 + 71.03711379 - 17.0265491015 + 1.007276466812)


def test_rt_model_and_bounds(spark):
    weight = {r: i for i, r in enumerate("ACDEFGHIKLMNPQRSTVWY")}
    peptides = ["".join("ACDEFGHIKLMNPQRSTVWY"[(i * 7 + j * j) % 20] for j in range(5 + i % 9)) for i in range(200)]
    psms = spark.createDataFrame([(p, float(sum(weight[c] for c in p)), float(i), i, 0.001) for i, p in enumerate(peptides)], "peptide string, rt double, fragment_intensity double, psm_id long, spectrum_q double")
    first, second, width = R.retrained(psms, R.CompositionRt(1e-6))
    got = R.predict_rt(psms, second).join(psms, "peptide").toPandas()
    assert (got["rt"] - got["rt_predictions"]).abs().max() < 1e-3 and 0 <= width < 1e-3
    b = R.rt_bounds(spark.createDataFrame([("P", 2.0)], "peptide string, rt_predictions double"), 0.5).first()
    assert (b["predictions"], b["predictions_lower"], b["predictions_upper"]) == (120.0, 105.0, 135.0)


def test_spectra(spark):
    v = spark.createDataFrame([("P", [0.0, -1.0], [1.0])], "peptide string, b array<double>, y array<double>")
    assert rows(S.delogged(v, ["peptide"]), "fragment_name") == [("P", "b1/1", 1.0), ("P", "b2/1", 0.5), ("P", "y1/1", 2.0)]
    ions = {i["fragment_name"]: i["mz"] for i in spark.range(1).select(S.theoretical_ions(F.lit("GAG")).alias("x")).first()["x"]}
    assert ions["b1/1"] == pytest.approx(57.02146372 + 1.007276466812) and ions["y1/1"] == pytest.approx(57.02146372 + 18.0105646837 + 1.007276466812) and len(ions) == 4
    psms = spark.createDataFrame([(1, "s", "GAG", 2)], "psm_id long, scannr string, peptide string, charge int")
    peaks = spark.createDataFrame([("s", [ions["b1/1"], ions["b1/1"] + 1e-4, 300.0], [3.0, 4.0, 9.0])], "scan_id string, mz array<double>, intensity array<double>")
    assert rows(S.annotate(psms, peaks).select("fragment_name", "fragment_intensity"), "fragment_name") == [("b1/1", 4.0)]
    peaks = spark.createDataFrame([("s", 100.0), ("s", 157.0), ("s", 400.0)], "scan string, mz double")
    got = S.mass_differences(peaks, ["scan"]).first()
    assert (got["low"], got["high"], got["residue"]) == (100.0, 157.0, "G")


def test_deconvolution(spark):
    a, b = [1.0, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, 0.5]
    rows_ = [("s", i, n, f"f{i}", 10 * a[i]) for i in range(4) for n in ("A/2", "B/2")]
    preds = [("A/2", f"f{i}", a[i]) for i in range(4)] + [("B/2", f"f{i}", b[i]) for i in range(4)]
    got = S.deconvolved(spark.createDataFrame(rows_, "scannr string, peak_identifier int, peptidoform string, fragment_name string, fragment_intensity double"), spark.createDataFrame(preds, "peptidoform string, fragment_name string, predicted double"), 1e-4)
    assert [r["peptidoform"] for r in got.collect()] == ["A/2"]


def test_tdc_and_rescoring(spark):
    s = [(5.0, False), (4.0, False), (3.0, True), (2.0, False), (2.0, False), (1.0, True)]
    got = [r["q_value"] for r in Q.tdc_qvalues(spark.createDataFrame(s, "score double, is_decoy boolean"), "score").orderBy(F.desc("score")).collect()]
    assert got == pytest.approx([0.5, 0.5, 0.5, 0.5, 0.5, 0.75])
    pdf = pd.DataFrame({"SpecId": [f"s{i}" for i in range(300)], "Label": [1 if i % 3 else -1 for i in range(300)]})
    pdf["x"] = pdf["Label"] * 2.0 + [math.sin(i) for i in range(300)]
    pdf["y"] = [math.cos(i) for i in range(300)]
    out = Q.rescored(spark.createDataFrame(pdf), ["x", "y"]).toPandas()
    assert len(out) == 300 and out[out.Label > 0].score.min() > out[out.Label < 0].score.max()
    assert Q.dense_network(103).getLayers() == [103, 100, 50, 20, 2]


def test_windowed_results(spark):
    psms = spark.createDataFrame([("1", 0, "A"), ("1", 1, "B"), ("2", 0, "C")], "part string, psm_id long, peptide string")
    frags = spark.createDataFrame([("1", 0, "A", "b1", 1.0), ("1", 1, "B", "b1", 3.0), ("2", 0, "C", "b1", 2.0), ("2", 0, "C", "y1", 5.0)], "part string, psm_id long, peptide string, fragment_name string, fragment_intensity double")
    f, p, top, best = E.combined(psms, frags)
    assert rows(p.select("psm_id", "peptide"), "psm_id") == [(0, "A"), (1, "B"), (2, "C")]
    assert rows(top.select("psm_id", "fragment_name"), "psm_id") == [(0, "b1"), (1, "b1"), (2, "y1")] and best.count() == 3
    E.check_integrity(f, p)
    with pytest.raises(ValueError):
        E.check_integrity(f.where("peptide <> 'A'"), p)


def test_fitted_fragment_provider(spark):
    psms = spark.createDataFrame([(1, "PEPK", 0.001), (2, "AEPK", 0.001), (3, "GGGG", 0.5)], "psm_id long, peptide string, spectrum_q double")
    fragments = spark.createDataFrame([(1, "b2/1", 100.0), (1, "y1/1", 50.0), (2, "b2/1", 25.0), (2, "y1/1", 100.0), (3, "b1/1", 9.0), (1, "b1-H2O/1", 9.0)], "psm_id long, fragment_name string, fragment_intensity double")
    provider = S.fitted_provider(psms, fragments)
    got = provider(pd.DataFrame({"peptide": ["VEPK", "[Acetyl]VEPK"], "charge": [2, 2]}))
    assert got["b"][0][1] == pytest.approx((0.0 - 2.0) / 2) and got["y"][0][0] == pytest.approx((-1.0 + 0.0) / 2)  # the bond E-P, and P-K
    assert got["b"][0] == got["b"][1] and len(got["y"][0]) == 3
    assert S.fitted_provider(psms.where("psm_id = 3"), fragments) is S.flat_provider


def test_rt_model_with_ends(spark):
    peptides = ["".join("ACDEFGHIKLMNPQRSTVWY"[(i * 7 + j * j) % 20] for j in range(5 + i % 9)) for i in range(300)]
    psms = spark.createDataFrame([(p, 10.0 * (p[0] == "A") + 3.0 * (p[-2] == "C") + len(p), float(i), i, 0.001) for i, p in enumerate(peptides)], "peptide string, rt double, fragment_intensity double, psm_id long, spectrum_q double")
    error = lambda ends: R.predict_rt(psms, R.CompositionRt(1e-6, ends).fit(psms)).join(psms, "peptide").select(F.avg(F.abs(F.col("rt") - F.col("rt_predictions")))).first()[0]
    assert error(2) < 1e-3 < error(0)


def test_semi_supervised_rounds(spark):
    pin = spark.createDataFrame([(f"{i}", 1 if i % 3 else -1, float(i % 7) + (5.0 if i % 3 == 1 else 0.0), float(i % 5)) for i in range(300)], "SpecId string, Label int, a double, b double")
    got = Q.rescored(pin, ["a", "b"], rounds=2, train_q=0.2)
    best = got.where("Label > 0").groupBy((F.col("SpecId").cast("int") % 3 == 1).alias("real")).agg(F.avg("score").alias("s")).collect()
    by = {r["real"]: r["s"] for r in best}
    assert got.count() == 300 and by[True] > by[False]
