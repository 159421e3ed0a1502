"""Schemas of the entities, and a check for required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

PSM = _schema(
    psm_id=_L, filename=_S, scannr=_S, peptide=_S, stripped_peptide=_S, proteins=_S, num_proteins=_I, rank=_I, is_decoy=_B,
    expmass=_D, calcmass=_D, charge=_I, peptide_len=_I, missed_cleavages=_I, semi_enzymatic=_B, ms2_intensity=_D, isotope_error=_D,
    precursor_ppm=_D, fragment_ppm=_D, hyperscore=_D, delta_next=_D, delta_best=_D, rt=_D, aligned_rt=_D, predicted_rt=_D,
    delta_rt_model=_D, ion_mobility=_D, predicted_mobility=_D, delta_mobility=_D, matched_peaks=_I, longest_b=_I, longest_y=_I,
    longest_y_pct=_D, matched_intensity_pct=_D, scored_candidates=_I, poisson=_D, sage_discriminant_score=_D, posterior_error=_D,
    spectrum_q=_D, peptide_q=_D, protein_q=_D, reporter_ion_intensity=T.ArrayType(_D), fragment_intensity=_D,
)
FRAGMENT = _schema(
    psm_id=_L, fragment_type=_S, fragment_ordinals=_I, fragment_charge=_I, fragment_mz_experimental=_D, fragment_mz_calculated=_D,
    fragment_intensity=_D, peptide=_S, charge=_I, rt=_D, scannr=_S, peak_identifier=_I,
)
SPECTRUM = _schema(file=_S, scan_id=_S, scan_index=_L, ms_level=_I, rt=_D, mz=T.ArrayType(_D), intensity=T.ArrayType(_D), target_mz=_D, lower_offset=_D, upper_offset=_D)
PEPTIDE = _schema(protein=_S, start=_I, end=_I, id=_S, peptide=_S)
PREDICTION = _schema(peptidoform=_S, fragment_name=_S, predicted=_D)
RT_PREDICTION = _schema(peptide=_S, rt_predictions=_D)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself; ValueError that names what is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df
