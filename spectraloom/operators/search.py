"""Search results per retention-time partition as one set-based plan: candidates, unique ids, top fragments, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from .aggregates import max_fragment_per_peptide, max_fragment_per_psm
from .joins import interval_overlap_join, range_join, rt_bin, running_offset
from .spectra import annotate


def candidates(peptides: DataFrame, partitions: DataFrame, width: float) -> DataFrame:
    """Peptides by partition: those whose predicted interval overlaps [upper - width, upper] (partitions: part, upper)."""
    windows = partitions.withColumn("lower", F.col("upper") - width)
    return interval_overlap_join(peptides, windows, "predictions_lower", "predictions_upper", "lower", "upper", max(width, 1e-9))


def combined(psms: DataFrame, fragments: DataFrame, part: str = "part") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(fragments, psms, top fragment per PSM, top fragment per peptide) of all partitions with ids made unique.

    Fragments follow their PSMs' offset, which is taken from the PSM table alone.
    """
    unique = running_offset(psms.withColumn("__old", F.col("psm_id")), part)
    moved = fragments.withColumnRenamed("psm_id", "__old").join(unique.select(part, "__old", "psm_id"), [part, "__old"]).drop("__old")
    top = max_fragment_per_psm(moved)
    return moved, unique.drop("__old"), top, max_fragment_per_peptide(top)


def check_integrity(fragments: DataFrame, psms: DataFrame) -> None:
    """ValueError if fragments and PSMs have different numbers of distinct peptides."""
    n, m = (df.select("peptide").distinct().count() for df in (fragments, psms))
    if n != m:
        raise ValueError(f"{n} distinct peptides in the fragments, {m} in the PSMs")


def windowed_search(spectra: DataFrame, peptides: DataFrame, interval: float, width: float, charges: tuple[int, ...] = (2, 3), ppm: float = 20.0, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(psms, fragments) of a search by retention-time partitions, with psm_id counted through the partitions.

    peptides: peptide, is_decoy, predictions_lower and _upper in seconds. A partition's peptides are those
    whose interval overlaps it; of these a scan meets the ones whose precursor lies in its isolation window,
    by a range join within the partition. A match has `least` annotated fragments or more. Its hyperscore
    is the logarithm of the factorials of b and y matches and of their intensities; a scan and peptide have
    one PSM, of the best charge.
    """
    scans = spectra.where("ms_level = 2 AND target_mz > 0").withColumn("part", rt_bin(F.col("rt"), interval))
    parts = scans.select("part", F.col("part").alias("upper")).distinct()
    own = candidates(peptides, parts, width).select("part", "peptide", "is_decoy").distinct()
    mass = X.mass_of(X.base_sequence(F.col("peptide")))
    ions = own.select("*", F.explode(F.array(*(F.lit(z) for z in charges))).alias("charge")).withColumn("calcmass", mass).where("calcmass IS NOT NULL")
    windows = scans.select("part", "file", "scan_id", "rt", (F.col("target_mz") - F.col("lower_offset")).alias("low"), (F.col("target_mz") + F.col("upper_offset")).alias("high"))
    met = range_join(ions.withColumn("mz", X.precursor_mz(F.col("calcmass"), F.col("charge"))), windows, F.col("mz"), F.col("low"), F.col("high"), 10.0, ["part"])
    named = met.select("part", F.xxhash64("file", "scan_id", "peptide", "charge").alias("match"), "peptide", "is_decoy", "charge", "calcmass", "file", F.col("scan_id").alias("scannr"), F.col("rt"))
    found = annotate(named.select(F.col("match").alias("psm_id"), F.col("file").alias("filename"), "scannr", "peptide", "charge"), scans, ppm)
    of = lambda kind: F.col("fragment_name").startswith(kind)
    n = lambda kind: F.least(F.count_if(of(kind)), F.lit(20))
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("fragment_intensity"))), F.lit(0.0))
    score = F.ln(F.factorial(n("b")).cast("double")) + F.ln(F.factorial(n("y")).cast("double")) + F.log1p(total("b")) + F.log1p(total("y"))
    scored = found.groupBy("psm_id").agg(F.count(F.lit(1)).alias("matched_peaks"), score.alias("hyperscore")).where(F.col("matched_peaks") >= least)
    psms = named.join(scored.withColumnRenamed("psm_id", "match"), "match")
    best = psms.groupBy("part", "file", "scannr", "peptide").agg(F.min_by(F.struct("match", "is_decoy", "charge", "calcmass", "rt", "matched_peaks", "hyperscore"), F.struct(-F.col("hyperscore"), F.col("charge"))).alias("b"))
    best = best.select("part", F.col("file").alias("filename"), "scannr", "peptide", "b.*")
    # ids count within a partition, then the partitions are told apart by their offsets
    at = W.partitionBy("part").orderBy("filename", "scannr", "peptide")
    unique = running_offset(best.withColumn("psm_id", F.row_number().over(at).cast("long") - 1), "part")
    fragments = found.withColumnRenamed("psm_id", "match").join(unique.select("match", F.col("psm_id")), "match").select("psm_id", "fragment_name", "fragment_intensity")
    return unique.drop("match"), fragments
