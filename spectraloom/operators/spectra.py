"""Fragment prediction by provider, theoretical ions, annotation, deconvolution, mass differences."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import kernels as K
from .joins import of_file, range_join


def delogged(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fragment_name, predicted) from arrays `b` and `y` of log2 intensities: b1/1, b2/1, ..."""

    def side(kind: str) -> DataFrame:
        return predictions.select(*keys, F.posexplode(kind).alias("i", "v")).select(*keys, X.fragment_name(F.lit(kind), F.col("i") + 1, F.lit(1)).alias("fragment_name"), X.delog(F.col("v")).alias("predicted"))

    return side("b").unionByName(side("y"))


def flat_provider(pdf: pd.DataFrame) -> pd.DataFrame:
    """The default fragment provider: every ion as likely as its share of a fixed slope along the peptide; deterministic."""
    n = pdf["peptide"].str.replace(r"\[.*?\]", "", regex=True).str.len().clip(lower=1)
    rows = [np.log2((np.arange(1, k) + 1.0) / (k + 1.0)).tolist() for k in n]
    return pd.DataFrame({"peptide": pdf["peptide"], "charge": pdf["charge"], "b": rows, "y": [r[::-1] for r in rows]})


def fitted_provider(psms: DataFrame, fragments: DataFrame, q: float = 0.01) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A provider fitted on confident PSMs: an ion is as strong as those cleaved between the same residues have been on average.

    The averages of log2 intensity over the PSM's maximum are taken by kind of ion and by the residues on both
    sides of the bond, of which there are at most 2 x 20 x 20, so the table is small whatever the training. A pair
    that was not seen has its kind's average; without any training the provider is `flat_provider`.
    """
    sure = psms.where((F.col("spectrum_q") < q) & F.col("peptide").isNotNull()).select("psm_id", X.base_sequence(F.col("peptide")).alias("s"))
    own = fragments.select("psm_id", "fragment_name", "fragment_intensity").join(sure, "psm_id")
    own = own.join(own.groupBy("psm_id").agg(F.max("fragment_intensity").alias("top")), "psm_id").where("fragment_intensity > 0")
    parts = [F.regexp_extract("fragment_name", "^([by])([0-9]+)/1$", k) for k in (1, 2)]
    at = F.when(parts[0] == "b", parts[1].try_cast("int")).otherwise(F.length("s") - parts[1].try_cast("int"))
    rows = own.where(parts[0] != "").select(parts[0].alias("kind"), F.substr("s", at, F.lit(1)).alias("left"), F.substr("s", at + 1, F.lit(1)).alias("right"), F.log2(F.col("fragment_intensity") / F.col("top")).alias("v"))
    known = rows.where(F.col("left").isin(*X.RESIDUES) & F.col("right").isin(*X.RESIDUES)).groupBy("kind", "left", "right").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    table = {(r["kind"], r["left"], r["right"]): (r["v"], r["n"]) for r in known.collect()}  # 800 rows at most
    if not table:
        return flat_provider
    mean = {k: sum(v * n for (kind, *_), (v, n) in table.items() if kind == k) / max(1, sum(n for (kind, *_), (_, n) in table.items() if kind == k)) for k in "by"}

    def provider(pdf: pd.DataFrame) -> pd.DataFrame:
        bare = pdf["peptide"].str.replace(r"\[.*?\]", "", regex=True)
        bonds = [list(zip(s, s[1:])) for s in bare]
        side = lambda kind, pairs: [float(table.get((kind, a, b), (mean[kind], 1))[0]) for a, b in pairs]
        return pd.DataFrame({"peptide": pdf["peptide"], "charge": pdf["charge"], "b": [side("b", p) for p in bonds], "y": [side("y", p[::-1]) for p in bonds]})

    return provider


def predict_fragments(psms: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame] = flat_provider) -> DataFrame:
    """(peptide, charge, fragment_name, predicted): distinct peptidoforms go to the provider in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield provider(pdf)[["peptide", "charge", "b", "y"]]

    asked = psms.select("peptide", F.col("charge").cast("int").alias("charge")).where("peptide IS NOT NULL AND charge IS NOT NULL").distinct()
    return delogged(asked.mapInPandas(run, "peptide string, charge int, b array<double>, y array<double>"), ["peptide", "charge"])


# Neutral losses in Da.
LOSSES = {"": 0.0, "-H2O": 18.0105646837, "-NH3": 17.0265491015}


def theoretical_ions(sequence: Column, max_charge: Column | None = None, losses: tuple[str, ...] = ("",)) -> Column:
    """array of struct(fragment_name, mz): b and y ions of an unmodified sequence, of charges 1 to max_charge (1 if not given), with the named neutral losses."""
    n = F.length(sequence)
    top = F.greatest(F.coalesce(max_charge.cast("int"), F.lit(1)), F.lit(1)) if max_charge is not None else F.lit(1)

    def ions(kind: str, loss: str) -> Column:
        def one(i: Column, z: Column, mass: Column) -> Column:
            mz = (mass + F.lit((0.0 if kind == "y" else -X.WATER) - LOSSES[loss])) / z + F.lit(X.PROTON)
            return F.struct(F.concat(F.lit(kind), i.cast("string"), F.lit(f"{loss}/"), z.cast("string")).alias("fragment_name"), mz.alias("mz"))

        def of_length(i: Column) -> Column:
            part = F.substr(sequence, F.lit(1), i) if kind == "b" else F.substr(sequence, n - i + 1, i)
            mass = F.array(X.mass_of(part))
            return F.flatten(F.transform(mass, lambda m: F.transform(F.sequence(F.lit(1), top), lambda z: one(i, z, m))))

        lengths = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), of_length)
        return F.when(n > 1, F.flatten(lengths)).otherwise(F.array().cast("array<struct<fragment_name:string,mz:double>>"))

    return F.concat(*(ions(kind, loss) for loss in losses for kind in "by"))


def annotate(psms: DataFrame, spectra: DataFrame, ppm: float = 20.0, max_charge: int = 1, losses: tuple[str, ...] = ("",)) -> DataFrame:
    """(psm_id, peptide, charge, fragment_name, fragment_intensity): the strongest peak within ppm of each theoretical ion.

    Ions have charges up to max_charge, but below the precursor's where that is 2 or more. Scans are told
    apart by file and scan id (see `of_file`). PSMs meet whole scans; ions and peaks are matched in Arrow batches
    by binary search, so neither is ever a row of a shuffle, and the tolerance does not multiply rows.
    """
    scans, rows = of_file(spectra.withColumnRenamed("scan_id", "scannr"), psms, ["scannr"])
    charges = F.greatest(F.least(F.lit(max_charge), F.greatest(F.col("charge").cast("int") - 1, F.lit(1))), F.lit(1))
    rows = rows.select("psm_id", "__file", "scannr", "peptide", "charge", X.base_sequence(F.col("peptide")).alias("__seq"), charges.alias("__top")).where("length(__seq) > 1")
    met = rows.join(scans.select("__file", "scannr", "mz", "intensity"), ["__file", "scannr"]).drop("__file", "scannr")
    kept = [f for f in met.schema.fields if f.name in ("psm_id", "peptide", "charge")]
    schema = T.StructType([*kept, T.StructField("fragment_name", T.StringType()), T.StructField("fragment_intensity", T.DoubleType())])
    shifts = [(loss, LOSSES[loss]) for loss in losses]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, values = matched_ions(batch, shifts, ppm)
            own = [batch.column(f.name).take(pa.array(at, pa.int64())) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(values, pa.float64(), mask=np.isneginf(values))], names=schema.names)

    found = met.mapInArrow(run, schema).groupBy("psm_id", "peptide", "charge", "fragment_name").agg(F.max("fragment_intensity").alias("fragment_intensity"))
    return found.withColumn("fragment_intensity", F.col("fragment_intensity").cast(spectra.schema["intensity"].dataType.elementType))


def matched_ions(batch: pa.RecordBatch, shifts: list[tuple[str, float]], ppm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fragment_name, intensity) of the ions of each row's __seq that meet one of its peaks; -inf if no such peak has an intensity.

    Sequences of a length are taken together. Masses are added in the order in which `theoretical_ions` adds them.
    """

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        values = np.array(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
        return np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan if name == "mz" else -np.inf, values), np.concatenate([[0], np.cumsum(sizes)])

    (mz, place), (own, own_place) = lists("mz"), lists("intensity")
    if len(place) != len(own_place) or (place != own_place).any():  # as arrays_zip has it: what one side lacks is null
        both = [(mz[a:b], own[c:d]) for a, b, c, d in zip(place, place[1:], own_place, own_place[1:])]
        own = np.concatenate([np.zeros(0), *(np.append(v[: len(m)], np.full(max(0, len(m) - len(v)), -np.inf)) for m, v in both)])
    inside = np.ones(max(len(mz) - 1, 0), dtype=bool)
    inside[place[1:-1][(place[1:-1] > 0) & (place[1:-1] < len(mz))] - 1] = False
    for k in np.unique(place.searchsorted(np.flatnonzero(inside & ~(mz[1:] >= mz[:-1])), "right") - 1):  # spectra out of order; null and NaN come last
        order = place[k] + np.argsort(mz[place[k] : place[k + 1]])
        mz[place[k] : place[k + 1]], own[place[k] : place[k + 1]] = mz[order], own[order]
    own = np.append(own, -np.inf)  # one more, so that every place is one

    groups: dict[tuple[int, int], list[int]] = {}
    sequences = batch.column("__seq").to_pylist()
    for k, (seq, top) in enumerate(zip(sequences, batch.column("__top").to_pylist())):
        groups.setdefault((len(seq), top), []).append(k)
    rows, names, values = [np.zeros(0, int)], [np.zeros(0, object)], [np.zeros(0)]
    for (n, top), members in groups.items():
        m = np.array([[X.RESIDUES.get(c, np.nan) for c in sequences[k]] for k in members])
        b = np.cumsum(np.column_stack([np.full(len(m), X.WATER), m]), axis=1)[:, 1:n]
        y = np.full(m.shape, X.WATER)
        for i in range(n):
            y[:, : i + 1] += m[:, i : i + 1]  # the suffixes from each place, up to i
        charge = np.arange(1, top + 1)
        base = np.stack([b, y[:, :0:-1]], axis=1)[:, None, :, :]
        change = np.array([[-X.WATER - mass, 0.0 - mass] for _, mass in shifts])[None, :, :, None]
        target = ((base + change)[..., None] / charge + X.PROTON).reshape(len(m), -1)
        named = np.array([f"{kind}{i}{loss}/{z}" for loss, _ in shifts for kind in "by" for i in range(1, n) for z in charge], dtype=object)
        tolerance = target * ppm * 1e-6
        low, high = target - tolerance, target + tolerance
        met = np.zeros((2, *target.shape), dtype=int)
        for j, k in enumerate(members):
            at = mz[place[k] : place[k + 1]]
            met[0, j], met[1, j] = at.searchsorted(low[j], "left"), at.searchsorted(high[j], "right")
        j, i = np.nonzero((met[0] < met[1]) & ~np.isnan(target))
        if len(j):
            k = np.array(members)[j]
            rows.append(k)
            names.append(named[i])
            values.append(np.maximum.reduceat(own, (met[:, j, i] + place[k]).T.ravel())[::2])
    return np.concatenate(rows), np.concatenate(names), np.concatenate(values)


def deconvolved(fragments: DataFrame, predictions: DataFrame, alpha: float = 0.1, least: float = 1e-10) -> DataFrame:
    """(scannr, peptidoform, coefficient): peptidoforms that a non-negative Lasso keeps to explain a scan's peaks.

    fragments: scannr, peak_identifier, peptidoform, fragment_name, fragment_intensity. Scans lie in order in their partition,
    and those of a few Arrow batches are solved together, so a scan costs no call of its own. A peak's intensity is that of its
    first row by peptidoform and fragment, the least of equal ones.
    """
    rows = fragments.join(predictions.select("peptidoform", "fragment_name", "predicted"), ["peptidoform", "fragment_name"], "left").fillna(0.0, ["predicted"])
    rows = rows.select("scannr", "peak_identifier", "peptidoform", "fragment_name", F.col("fragment_intensity").cast("double").alias("fragment_intensity"), F.col("predicted").cast("double").alias("predicted"))
    rows = rows.repartition("scannr").sortWithinPartitions("scannr", "peak_identifier", "peptidoform", "fragment_name", F.col("fragment_intensity").asc_nulls_last(), "predicted")

    most = LASSO_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                table = pa.Table.from_batches(held)
                scan = pc.rank(table["scannr"].combine_chunks(), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
                start = int(np.searchsorted(scan, scan[-1]))  # the last scan may go on
                if start:
                    yield from solved(table.slice(0, start), alpha, least).to_batches()
                    held = table.slice(start).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held), alpha, least).to_batches()

    return rows.mapInArrow(run, "scannr string, peptidoform string, coefficient double")


#: Rows of whole scans that are solved together; a scan of more rows is held alone.
LASSO_ROWS = 500_000


def solved(table: pa.Table, alpha: float, least: float) -> pa.Table:
    """The coefficients of the scans of a table that is in order of scan, peak, peptidoform, fragment and intensity."""
    table = table.filter(pc.and_(pc.is_valid(table["peak_identifier"]), pc.is_valid(table["peptidoform"]))).combine_chunks()
    if not table.num_rows:
        return pa.table({"scannr": pa.array([], pa.string()), "peptidoform": pa.array([], pa.string()), "coefficient": pa.array([], pa.float64())})
    dense = lambda name: pc.rank(table[name], "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1
    scan, peak, form = dense("scannr"), dense("peak_identifier"), dense("peptidoform")
    bounds = np.searchsorted(scan, np.arange(scan[-1] + 2))
    intensity, predicted = table["fragment_intensity"].to_numpy(), np.nan_to_num(table["predicted"].to_numpy())
    problems: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        peaks, i = np.unique(peak[low:high], return_inverse=True)
        forms, j = np.unique(form[low:high], return_inverse=True)
        x = np.bincount(i * len(forms) + j, predicted[low:high], len(peaks) * len(forms)).reshape(len(peaks), len(forms))
        y, v = np.zeros(len(peaks)), intensity[low:high]
        known = np.flatnonzero(~np.isnan(v))[::-1]  # the first of a peak is put last
        y[i[known]] = v[known]
        total = y.sum()
        problems.setdefault(tuple(1 << (size - 1).bit_length() for size in x.shape), []).append((low, x, y / total if total else y, forms))
    scans, found, weights = [], [], []
    for (height, width), same in problems.items():  # filled up to like sizes
        a, r = np.zeros((width, height, len(same))), np.zeros((height, len(same)))
        for k, (_, x, y, _) in enumerate(same):
            a[: x.shape[1], : len(y), k], r[: len(y), k] = (x - x.mean(axis=0)).T, y - y.mean()
        w = K.nn_lassos(a, r, np.array([len(p[2]) for p in same], dtype=float), alpha)
        at, kept = np.nonzero(w.T > least)
        scans.append(np.array([p[0] for p in same])[at])
        found.append(np.array([same[k][3][j] for k, j in zip(at, kept)], dtype=int))
        weights.append(w[kept, at])
    order = np.unique(form, return_index=True)[1]  # a row of each peptidoform
    return pa.table({"scannr": table["scannr"].take(pa.array(np.concatenate(scans))).cast(pa.string()), "peptidoform": table["peptidoform"].take(pa.array(order[np.concatenate(found)])).cast(pa.string()), "coefficient": pa.array(np.concatenate(weights))})


def mass_differences(peaks: DataFrame, keys: list[str], mz: str = "mz", tolerance: float = 0.5, residues: dict[str, float] | None = None) -> DataFrame:
    """(keys, low, high, residue, delta): pairs of peaks whose distance is closest to a residue's mass, within `tolerance`.

    One range join over the distances from the lightest to the heaviest residue, so a peak is a row of three at most on
    either side together, whatever the number of residues and the tolerance; the residue is told from the pair.
    """
    table = X.RESIDUES if residues is None else residues
    least, most = min(table.values(), default=0.0) - tolerance, max(table.values(), default=0.0) + tolerance
    slack = 1e-9 * (1 + F.abs(F.col("low")))  # what is near an end is judged by delta alone
    reach, points = peaks.select(*keys, F.col(mz).alias("low")), peaks.select(*keys, F.col(mz).alias("high"))
    pairs = range_join(points, reach, F.col("high"), F.col("low") + least - slack, F.col("low") + most + slack, max(most - least, 1e-6), keys, small=False)
    each = [(F.abs(F.col("high") - F.col("low") - F.lit(mass)), residue) for residue, mass in table.items()] or [(F.lit(float("inf")), "")]
    pairs = pairs.where(F.array_min(F.array(*(d for d, _ in each))) < tolerance)
    best = F.array_min(F.array(*(F.struct(d.alias("delta"), F.lit(residue).alias("residue")) for d, residue in each)))
    return pairs.withColumn("__best", best).select(*keys, "low", "high", "__best.residue", "__best.delta").distinct()


def random_spectra(spark: SparkSession, n: int, peaks: int = 50, seed: int = 1) -> DataFrame:
    """n seeded random spectra (scan_id, mz ascending, intensity) for trials of matching and deconvolution."""
    at = F.sequence(F.lit(0), F.lit(peaks - 1))
    share = lambda i, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", i), F.lit(1_000_000)) / 1e6
    mz = F.sort_array(F.transform(at, lambda i: F.lit(100.0) + share(i, 1) * 1900))
    return spark.range(n).select(F.concat(F.lit("scan="), F.col("id").cast("string")).alias("scan_id"), mz.alias("mz"), F.transform(at, lambda i: share(i, 2) * 1e4).alias("intensity"))
