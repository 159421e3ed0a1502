"""Column expressions: text of peptides and ions, masses, guarded statistics and array features. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import pearson_pvalue

# The mass-shift notations that are renamed, and their names.
MASS_SHIFTS = {
    "[+57.0215]": "[Carbamidomethyl]",
    "[+57.021465]": "[Carbamidomethyl]",
    "[+15.9949]": "[Oxidation]",
    "[-18.010565]": "[Glu->pyro-Glu]",
    "[-17.026548]": "[Gln->pyro-Glu]",
    "[+0.984016]": "[Deamidated]",
    "[+14.01565]": "[Methyl]",
    "[+27.994915]": "[Formyl]",
    "[+28.0313]": "[Dimethyl]",
    "[+79.96633]": "[Phospho]",
    "[+31.989829]": "[Dioxidation]",
    "[+31.989828]": "[Dioxidation]",
    "[+42.010565]": "[Acetyl]",
    "[+42.010567]": "[Acetyl]",
    "[+12.0000000]": "[Thiazolidine]",
    "[+12.000000]": "[Thiazolidine]",
    "[+12.00000]": "[Thiazolidine]",
    "[+12.0000]": "[Thiazolidine]",
    "[+12.000]": "[Thiazolidine]",
    "[+12.00]": "[Thiazolidine]",
    "[+12.0]": "[Thiazolidine]",
    "[-17.026549]": "[Gln->pyro-Glu]",
    "[+17.026549]": "[Ammonium]",
    "[+44.985078]": "[Nitro]",
    "[+44.985077]": "[Nitro]",
    "[+43.005814]": "[Carbamyl]",
    "[+114.042927]": "[GG]",
    "[+114.04293]": "[GG]",
    "[+114.03169]": "[Gluratylation]",
    "[+56.026215]": "[Delta:H(4)C(3)O(1)]",
    "[+71.03712]": "[Propionamide]",
}
# Masses in dalton.
PROTON = 1.007276466812
ISOTOPE_SPACING = 1.0033548378
WATER = 18.0105646837
# Monoisotopic residue masses.
RESIDUES = {
    "G": 57.02146372, "A": 71.03711378, "S": 87.03202840, "P": 97.05276384, "V": 99.06841390, "T": 101.04767846, "C": 103.00918447,
    "L": 113.08406396, "I": 113.08406396, "N": 114.04292744, "D": 115.02694302, "Q": 128.05857750, "K": 128.09496300, "E": 129.04259308,
    "M": 131.04048459, "H": 137.05891186, "F": 147.06841390, "R": 156.10111102, "Y": 163.06332852, "W": 186.07931294,
}


def replace_mass_shift(peptide: Column, shifts: dict[str, str] | None = None) -> Column:
    """Mass-shift notations as names. No name holds a notation, so the order makes no difference."""
    for notation, name in (MASS_SHIFTS if shifts is None else shifts).items():
        peptide = F.replace(peptide, F.lit(notation), F.lit(name))
    return peptide


def strip_modifications(peptide: Column) -> Column:
    return F.regexp_replace(peptide, r"\[.*?\]", "")


def base_sequence(peptide: Column) -> Column:
    """The part before the first bracket."""
    return F.substring_index(peptide, "[", 1)


def peptidoform(peptide: Column, charge: Column) -> Column:
    return F.concat(peptide, F.lit("/"), charge.cast("string"))


def fragment_name(kind: Column, ordinal: Column, charge: Column) -> Column:
    """b3/1 and the like; null if any part is."""
    return F.concat(kind, ordinal.cast("string"), F.lit("/"), charge.cast("string"))


def split_ion(label: Column) -> Column:
    """struct(kind, ordinal, charge) of an annotation such as b3, y12^2 or b3/1; charge 1 if not written."""
    charge = F.regexp_extract(label, r"[\^/](\d+)", 1)
    return F.struct(
        F.substring(label, 1, 1).alias("kind"),
        F.regexp_extract(label, r"^[a-z](\d+)", 1).try_cast("int").alias("ordinal"),
        F.coalesce(F.nullif(charge, F.lit("")).try_cast("int"), F.lit(1)).alias("charge"),
    )


def spec_id(psm_id: Column, filename: Column, scannr: Column) -> Column:
    return F.concat(psm_id.cast("string"), F.lit("|"), filename, F.lit("|"), scannr)


def label(is_decoy: Column) -> Column:
    """-1 for a decoy, else (also for null) 1."""
    return F.when(is_decoy, -1).otherwise(1)


def find(text: Column, part: str) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.locate(part, text) - 1


def precursor_mz(mass: Column, charge: Column) -> Column:
    return mass / charge + F.lit(PROTON)


def ppm_tolerance(mz: Column, ppm: float = 20.0) -> Column:
    return mz * F.lit(ppm) * F.lit(1e-6)


def ppm_error(observed: Column, expected: Column) -> Column:
    return safe_divide(observed - expected, expected) * F.lit(1e6)


def isotope_mz(mz: Column, charge: Column, step: int) -> Column:
    """m/z of the isotope peak `step` places from the monoisotopic one."""
    return mz + F.lit(ISOTOPE_SPACING * step) / charge


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def delog(value: Column) -> Column:
    return F.pow(F.lit(2.0), value)


def _spread(x: Column) -> Column:
    """Whether an aggregate's input varies by more than float noise."""
    return F.stddev_pop(x) > F.lit(1e-9) * (F.lit(1.0) + F.abs(F.avg(x)))


def safe_corr(x: Column, y: Column, otherwise: float | None = 0.0) -> Column:
    """Aggregate: Pearson over pairs without null; `otherwise` where either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.when(_spread(a) & _spread(b), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).otherwise(F.lit(otherwise).cast("double"))


def cosine(x: Column, y: Column) -> Column:
    """Aggregate: cosine of two vectors, 0 if either has no length."""
    length = F.sqrt(F.sum(x * x) * F.sum(y * y))
    return F.when(length > 0, F.sum(x * y) / length).otherwise(F.lit(0.0))


def percentile_of_sorted(ordered: Column, q: float) -> Column:
    """Linear interpolation at q/100*(n-1) of an ascending array; 0 if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(q / 100.0)
    low = F.floor(at).cast("int")
    left, right = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, left + (right - left) * (at - low)).otherwise(F.lit(0.0))


def percentiles(values: Column, qs: Sequence[float]) -> Column:
    """Array of percentiles of an unordered array."""
    return F.element_at(F.transform(F.array(F.sort_array(values)), lambda s: F.array(*(percentile_of_sorted(s, q) for q in qs))), 1)


def percentiles_with_index(values: Column, index: Column, qs: Sequence[float], positional: bool = False) -> Column:
    """Array of struct(value, index): percentiles of `values`, each with the entry of `index` at int(position).

    By value with the index carried along; positional=True takes the arrays in the order in which they come.
    """
    pairs = F.arrays_zip(values.alias("v"), index.alias("i"))
    pairs = F.transform(pairs, lambda p: F.struct(p["v"].alias("v"), p["i"].alias("i")))
    pairs = pairs if positional else F.sort_array(pairs)

    def each(s: Column) -> Column:
        v = F.transform(s, lambda p: p["v"])
        places = [F.floor((F.size(s) - 1) * F.lit(q / 100.0)).cast("int") for q in qs]
        return F.array(*(F.struct(percentile_of_sorted(v, q).alias("value"), F.coalesce(F.get(s, p)["i"].cast("double"), F.lit(0.0)).alias("index")) for q, p in zip(qs, places)))

    return F.element_at(F.transform(F.array(pairs), each), 1)


def top_values(values: Column, m: int) -> Column:
    """The m largest values, falling, filled up with zeros."""
    return F.slice(F.concat(F.sort_array(values, asc=False), F.array_repeat(F.lit(0.0), m)), 1, m)


def top_with_index(values: Column, index: Column, m: int) -> Column:
    """Array of m struct(value, index): the largest values, falling, with their entries of `index`; filled up with zeros."""
    pairs = F.sort_array(F.transform(F.arrays_zip(values.alias("v"), index.alias("i")), lambda p: F.struct(p["v"].cast("double").alias("value"), p["i"].cast("double").alias("index"))), asc=False)
    return F.slice(F.concat(pairs, F.array_repeat(F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("index")), m)), 1, m)


def feature_columns(values: Column, name: str, labels: Sequence, method: str, index: Column | None = None) -> dict[str, Column]:
    """Columns {name}_{label}, and {name}_{label}_idx with an index: "percentile" (labels are percentages) or "top" (as many as labels). 0 for an empty array; ValueError for another method."""
    if method not in ("percentile", "top"):
        raise ValueError(f"unknown method: {method}")
    n = len(labels)
    if index is None:
        found = percentiles(values, labels) if method == "percentile" else top_values(values, n)
        return {f"{name}_{v}": F.coalesce(F.get(found, F.lit(i)), F.lit(0.0)) for i, v in enumerate(labels)}
    found = percentiles_with_index(values, index, labels) if method == "percentile" else top_with_index(values, index, n)
    out = {f"{name}_{v}": F.coalesce(F.get(found, F.lit(i))["value"], F.lit(0.0)) for i, v in enumerate(labels)}
    return out | {f"{name}_{v}_idx": F.coalesce(F.get(found, F.lit(i))["index"], F.lit(0.0)) for i, v in enumerate(labels)}


def peaks_between(mz: Column, intensity: Column, low: Column, high: Column) -> Column:
    """array of struct(m, i): the peaks from low to high, both included."""
    return F.filter(F.zip_with(mz, intensity, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda p: p["m"].between(low, high))


def strongest(peaks: Column, target: Column, ppm: float) -> Column:
    """Largest intensity of such peaks within ppm of target (both ends included), 0 without one."""
    tolerance = ppm_tolerance(target, ppm)
    hits = F.filter(peaks, lambda p: p["m"].between(target - tolerance, target + tolerance))
    return F.coalesce(F.array_max(F.transform(hits, lambda p: p["i"])), F.lit(0.0)).cast("double")


def peak_intensity(mz: Column, intensity: Column, target: Column, ppm: float = 20.0) -> Column:
    """Largest intensity among peaks within ppm of target (both ends included), 0 without one."""
    tolerance = ppm_tolerance(target, ppm)
    return strongest(peaks_between(mz, intensity, target - tolerance, target + tolerance), target, ppm)


def isotope_peaks(mz: Column, intensity: Column, target: Column, charge: Column, ppm: float = 20.0) -> dict[str, Column]:
    """Intensities of the peaks M-1, M and M+1. The spectrum is passed through once, for what lies around all three."""
    low, high = isotope_mz(target, charge, -1), isotope_mz(target, charge, 1)
    reach = ppm_tolerance(high, ppm)

    def three(near: Column) -> Column:
        return F.array(*(strongest(near, isotope_mz(target, charge, s), ppm) for s in (-1, 0, 1)))

    found = F.element_at(F.transform(F.array(peaks_between(mz, intensity, low - reach, high + reach)), three), 1)
    return {n: F.coalesce(F.get(found, F.lit(k)), F.lit(0.0)) for k, n in enumerate(("M-1", "M", "M+1"))}


def mass_of(sequence: Column) -> Column:
    """Monoisotopic mass of an unmodified sequence; null with an unknown residue."""
    masses = F.create_map(*(F.lit(v) for kv in RESIDUES.items() for v in kv))
    return F.aggregate(F.array_remove(F.split(sequence, ""), ""), F.lit(WATER), lambda s, x: s + F.element_at(masses, x))


@F.pandas_udf(T.DoubleType())
def corr_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-tailed p of a Pearson correlation r of n pairs, null where it has none."""
    p = pearson_pvalue(r.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan))
    return pd.Series(p).where(~np.isnan(p))
