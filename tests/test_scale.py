"""Rows that operators make and put through a shuffle on the way to their result, and the same results by plainer means."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectraloom.functions import expr as X
from spectraloom.functions import kernels as K
from spectraloom.operators import aggregates as A
from spectraloom.operators import fragments as M
from spectraloom.operators import joins as J
from spectraloom.operators import retention_time as R
from spectraloom.operators import spectra as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_annotation_does_not_multiply_rows_by_the_tolerance(spark):
    psms = spark.createDataFrame([(k, f"s{k}", seq, 3) for k, seq in enumerate(["GAG", "PEPTIDEK", "GXA", "", None, "SAMPLER", "GAGW"])], "psm_id long, scannr string, peptide string, charge int")
    mz = [float(v) for v in range(900, 50, -3)]  # falling
    peaks = [(f"s{k}", [None, *mz, float("nan")], [7.0, *(None if i % 5 == 0 else float(i * 37 % 101) for i in range(len(mz)))]) for k in range(7) if k != 6]
    peaks = spark.createDataFrame(peaks, "scan_id string, mz array<double>, intensity array<double>")
    got = S.annotate(psms, peaks, 20000.0, 2, tuple(S.LOSSES))
    assert "Generate" not in plan(got)  # neither ions nor peaks are rows before they have met
    ions = psms.select("psm_id", "scannr", F.inline(S.theoretical_ions(F.col("peptide"), F.lit(2), tuple(S.LOSSES)))).withColumnRenamed("mz", "t")
    rows = peaks.select(F.col("scan_id").alias("scannr"), F.inline(F.arrays_zip("mz", "intensity")))
    want = ions.join(rows, "scannr").where("mz BETWEEN t - t * 0.02D AND t + t * 0.02D").groupBy("psm_id", "fragment_name").agg(F.max("intensity").alias("i"))
    want = sorted(map(tuple, want.collect()), key=lambda r: r[:2])
    assert len(want) > 100 and sorted(map(tuple, got.select("psm_id", "fragment_name", "fragment_intensity").collect()), key=lambda r: r[:2]) == want


def test_mass_differences_make_three_rows_of_a_peak_at_most(spark):
    peaks = spark.createDataFrame([(s, 100.0 + (k * k * 37 + s) % 400 + k % 7 * 0.02) for s in range(3) for k in range(60)] * 2, "scan int, mz double")
    got = S.mass_differences(peaks, ["scan"])
    assert "residue" not in "".join(line for line in plan(got).splitlines() if "LocalRelation" in line or "LogicalRDD" in line)  # no row for each residue
    masses = spark.createDataFrame(list(X.RESIDUES.items()), "residue string, mass double")
    pairs = peaks.distinct().withColumnRenamed("mz", "low").join(peaks.distinct().withColumnRenamed("mz", "high"), "scan").crossJoin(masses).withColumn("delta", F.abs(F.col("high") - F.col("low") - F.col("mass"))).where("delta < 0.5")
    want = pairs.groupBy("scan", "low", "high").agg(F.min(F.struct("delta", "residue")).alias("b")).select("scan", "low", "high", "b.residue", "b.delta")
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    assert S.mass_differences(peaks, ["scan"], residues={}).count() == 0


@pytest.mark.parametrize("piece", [1 << 16, 100])
def test_ranges_that_only_look_small_are_not_broadcast(spark, tmp_path, monkeypatch, piece):
    nan = float("nan")
    targets = spark.range(1500).select(F.col("id").alias("target"), F.when(F.col("id") % 250 > 0, 450 + F.floor(F.col("id") / 500) * 0.06).alias("target_mz"), F.lit("a").alias("file"))  # few masses
    targets = targets.union(spark.createDataFrame([(-1, 450.06, None), (None, 450.0, "a"), (None, 450.0, "a"), (-2, nan, "a"), (-3, -0.0, "b"), (-4, 449.99, "b")], "target long, target_mz double, file string"))
    targets.coalesce(1).write.parquet(str(tmp_path / "targets"))
    targets = spark.read.parquet(str(tmp_path / "targets"))
    peaks = [(k, 450 + k * 0.003, "ab"[k % 2]) for k in range(-20, 60)] + [(100, 450.0 - 450.0 * 20 * 1e-6, "a"), (101, nan, "a"), (102, 0.0, "b"), (103, None, "a"), (104, 450.0, None), (105, 900.0, "a"), (105, 450.06, "a")]
    peaks = spark.createDataFrame(peaks, "scan int, mz double, file string")
    within = "mz BETWEEN target_mz - target_mz * 20.0D * 1e-6D AND target_mz + target_mz * 20.0D * 1e-6D"
    shown = lambda df: sorted(map(str, df.selectExpr("scan", "mz", "target", "target_mz", "file").collect()))
    monkeypatch.setattr(J, "BROADCAST_BYTES", 64 << 10)
    monkeypatch.setattr(J, "PIECE_RANGES", piece, raising=False)
    assert int(str(targets._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < J.BROADCAST_BYTES
    for on in ([], ["file"]):
        right = targets if on else targets.drop("file")
        got = J.ppm_range_join(peaks, right, on=on)
        want = peaks.join(right, on).where(within) if on else peaks.crossJoin(right).where(within)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() or piece == 100  # but the few pieces
        assert len(shown(want)) > 1000 and shown(got) == shown(want) and got.columns == [*on, *(c for c in ("scan", "mz", "file", "target", "target_mz") if c not in on)]
    assert J.ppm_range_join(peaks, targets.drop("file", "target")).count() == peaks.crossJoin(targets.drop("file")).where(within).count()
    spans = targets.select("target", F.col("target_mz").alias("low"), (F.col("target_mz") + 0.05).alias("high"))
    got = J.interval_overlap_join(peaks.select("scan", F.col("mz").alias("a"), (F.col("mz") + 0.01).alias("b")), spans, "a", "b", "low", "high", 0.05)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    few = J.ppm_range_join(peaks, targets.drop("file").limit(50))
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keep", ["all", "both", "any"])
def test_pair_correlations_shuffle_entries_and_cut_large_keys(spark, keep):
    draw = np.random.default_rng(1)
    rows = [(g, f"m{e}", t, None if u < 0.1 else float(round(8 * w) / 4 * (u > 0.3))) for g, size in (("a", 12), ("b", 3), (None, 3)) for e in range(size) for t in range(9) for u, w in [draw.random(2)] if u < 0.9]
    rows += [("a", "m3", 2, 5.0), ("a", "m4", 2, 1.5), ("a", None, 2, 1.0), ("a", "m1", None, 1.0), *(("b", "flat", t, 0.1) for t in range(9))]
    long = spark.createDataFrame(rows, "g string, e string, t int, x double")
    left, right = (long.select("g", "t", F.col("e").alias(n), F.col("x").alias(f"x{n}")) for n in "ab")
    kept = {"all": "true", "both": "xa <> 0 AND xb <> 0", "any": "xa <> 0 OR xb <> 0"}[keep]
    want = left.join(right, ["g", "t"]).where("a < b").where(kept).groupBy("g", "a", "b").agg(X.safe_corr(F.col("xa"), F.col("xb"), None).alias("c"), F.count(F.lit(1)).alias("n"))
    want = sorted((r["g"], r["a"], r["b"], r["n"], r["c"]) for r in want.collect())
    for pieces in ({}, {"piece_members": 4}, {"piece_rows": 20}):
        out = M.pair_correlations(long, "e", "t", ["g"], keep, **pieces)
        got = sorted((r["g"], r["a"], r["b"], r["n"], r["correlation"]) for r in out.collect())
        assert [r[:4] for r in got] == [r[:4] for r in want] and len(want) > 60
        assert [r[4] for r in got] == [pytest.approx(r[4], abs=1e-9) if r[4] is not None else None for r in want]
    full = spark.range(800).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2 % 20).alias("e"), F.floor(F.col("id") / 40).alias("t"), F.sin(F.col("id") * F.col("id")).alias("x"))
    left, right = (full.select("g", "t", F.col("e").alias(n), F.col("x").alias(f"x{n}")) for n in "ab")
    want = left.join(right, ["g", "t"]).where("a < b").groupBy("g", "a", "b").agg(F.corr("xa", "xb").alias("c"))
    want = {tuple(r[:3]): r[3] for r in want.collect()}
    assert {tuple(r[:3]): r["correlation"] for r in M.pair_correlations(full, "e", "t", ["g"], piece_members=7).collect()} == pytest.approx(want, abs=1e-9) and len(want) == 380


def test_average_ranks_order_no_partition_in_one_task(spark):
    nan = float("nan")
    rows = [(k, (k * k * 31 % 97) / 3.0 if k % 11 else None, "ab"[k % 2] if k % 5 else None) for k in range(300)] + [(300, nan, "a"), (301, nan, "a"), (302, -0.0, "a"), (303, 0.0, "a")]
    df = spark.createDataFrame(rows, "id int, v double, g string")
    w = W.partitionBy("g").orderBy("v")
    want = df.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy("g", "v")) - 1) / 2)
    got = A.average_ranks(df, ["g"], "v", "r", ranges=8)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = df.withColumn("v", F.col("v").cast("string"))
    want = text.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy("g", "v")) - 1) / 2)
    assert sorted(map(str, A.average_ranks(text, ["g"], "v", "r").collect())) == sorted(map(str, want.collect()))
    windows = [line for line in plan(A.average_ranks(df, ["g"], "v", "r")).splitlines() if "Window" in line]
    assert windows and all("__range" in line for line in windows)


@pytest.mark.parametrize("held", [50, 100_000])
def test_lasso_solves_scans_together(spark, monkeypatch, held):
    draw = np.random.default_rng(0)
    rows = [(f"s{s}", int(p), f"f{draw.integers(9)}", f"n{draw.integers(4)}", float(draw.random()) if draw.random() > 0.05 else None) for s in range(30) for p in draw.integers(1, 8, 40)]
    names = ["scannr", "peak_identifier", "peptidoform", "fragment_name", "fragment_intensity"]
    given = {(f"f{f}", f"n{n}"): float(draw.random()) for f in range(9) for n in range(3)}
    pdf = pd.DataFrame(rows, columns=names).sort_values(names)
    pdf["predicted"] = [given.get(k, 0.0) for k in zip(pdf["peptidoform"], pdf["fragment_name"])]
    want = {}
    for s, one in pdf.groupby("scannr"):
        y = one.groupby("peak_identifier")["fragment_intensity"].first().fillna(0.0)
        x = one.pivot_table(index="peak_identifier", columns="peptidoform", values="predicted", aggfunc="sum", fill_value=0.0)
        want |= {(s, c): v for c, v in zip(x.columns, K.nn_lasso(x.to_numpy(float), (y / y.sum()).to_numpy(float), 0.001)[0]) if v > 1e-10}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        rows_of = spark.createDataFrame(rows, "scannr string, peak_identifier int, peptidoform string, fragment_name string, fragment_intensity double")
        monkeypatch.setattr(S, "LASSO_ROWS", held)
        got = S.deconvolved(rows_of, spark.createDataFrame([(*k, v) for k, v in given.items()], "peptidoform string, fragment_name string, predicted double"), 0.001)
        assert "FlatMapGroups" not in plan(got)  # no call for each scan
        assert {(r["scannr"], r["peptidoform"]): r["coefficient"] for r in got.collect()} == pytest.approx(want, abs=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_correlations_of_a_matrix():
    x = np.random.default_rng(2).random((5, 7))
    x[3] = 0.4  # does not vary
    observed = np.array([True, True, False, True, True, False, True])
    rows, columns, c, n = K.matrix_features(x, x[0] * 2, observed)
    lower = lambda m: np.sort(np.repeat(np.corrcoef(m)[np.tril_indices(len(m), -1)] ** 2, 2))
    assert rows == pytest.approx(lower(x[[0, 1, 2, 4]])) and columns == pytest.approx(lower(x.T[observed]))
    assert c == pytest.approx([1.0, *(np.corrcoef(x[0], x[k])[0, 1] for k in (1, 2)), 0.0, np.corrcoef(x[0], x[4])[0, 1]]) and list(n) == [7.0] * 5


def test_retraining_takes_its_rows_once_and_predicts_each_once(spark):
    read, predicted = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    class Counting:
        def fit(self, training):
            model = R.CompositionRt(1e-3).fit(training)

            def run(peptides):
                predicted.add(len(peptides))
                return model(peptides)

            return run

    rows = [(k, "".join("GASPVTC"[int(x)] for x in np.base_repr(k // 2, 7)), float(k * k * 37 % 501) / 10, float(k % 5), 0.001) for k in range(400)]
    rows += [(400, None, 3.0, 1.0, 0.001), (401, "WW", None, 1.0, 0.001), (402, "KK", float("nan"), 1.0, 0.001), (403, "KKK", 1.0, 1.0, 0.5)]
    schema = "psm_id long, peptide string, rt double, fragment_intensity double, spectrum_q double"
    psms = spark.createDataFrame(rows, schema)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    _, second, width = R.retrained(psms.mapInPandas(counted, schema), Counting())
    assert read.value == len(rows)
    assert 300 < predicted.value <= 202 + 200  # all with a peptide by the first model, the good ones by the second
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    best = {}
    for k, p, rt, i, q in rows:
        if q < 0.01 and p is not None and (p not in best or (-i, k) < best[p][0]):
            best[p] = ((-i, k), rt)
    have = pd.DataFrame([(p, rt) for p, (_, rt) in best.items() if rt is not None and rt == rt], columns=["peptide", "rt"])

    def solved(t):
        x = R.composition(t["peptide"])
        return np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ t["rt"])

    error = (have["rt"] - R.composition(have["peptide"]) @ solved(have)).abs()
    good = have[error < np.percentile(error, 95)]
    w = solved(good)
    assert len(good) < len(have) and width == pytest.approx(2 * np.percentile((good["rt"] - R.composition(good["peptide"]) @ w).abs(), 95))
    assert second(have["peptide"]).to_numpy() == pytest.approx(R.composition(have["peptide"]) @ w)
    assert list(second(have["peptide"])) == [second(have["peptide"][k : k + 1])[0] for k in range(len(have))]  # the same number in any batch
    read.value = 0
    low = R.below_percentile(psms.mapInPandas(counted, schema), "fragment_intensity", 50)
    assert read.value == len(rows) and low.count() == sum(r[3] < np.percentile([r[3] for r in rows], 50) for r in rows)


def test_a_table_held_by_its_caller_stays_held(spark):
    df = spark.range(10).select((F.col("id") * 1.0).alias("v")).persist()
    try:
        assert R.below_percentile(df.select("v"), "v", 50).count() == 5
        with A.held(df) as same:
            assert same.count() == 10
        assert df.storageLevel.useMemory
    finally:
        df.unpersist()


@pytest.mark.parametrize("ends", [0, 2])
def test_composition_counts_as_plain_text_functions_do(ends):
    letters = list("GASPVTCLINDQKEMHFRYWXga[]\n\u00e9\U0001f600.")
    draw = np.random.default_rng(3)
    texts = pd.Series(["", None, "A", "[x]A", "A[", "]A[", "A[\n]C", "P[+15.9]EP[]K", *("".join(draw.choice(letters, draw.integers(0, 12))) for _ in range(500))], index=range(7, 515))
    bare = texts.fillna("").str.replace(r"\[.*?\]", "", regex=True)
    places = [bare.str.get(i) == r for i in (*range(ends), *range(-ends, 0)) for r in X.RESIDUES]
    want = np.column_stack([*(bare.str.count(r) for r in X.RESIDUES), bare.str.len(), *places, np.ones(len(bare))]).astype(float)
    got = R.composition(texts, ends)
    assert got.dtype == want.dtype and np.array_equal(got, want) and R.composition(texts[:0], ends).shape == (0, want.shape[1])
