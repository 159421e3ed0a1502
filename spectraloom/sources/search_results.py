"""The loader of search results: PSMs and matched fragments from Parquet to four related tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import replace_mass_shift
from ..operators.aggregates import max_fragment_per_peptide, max_fragment_per_psm
from ..operators.filters import below_q, first_rows, members
from ..schemas import require_columns


class SearchResults(NamedTuple):
    fragments: DataFrame
    psms: DataFrame
    fragment_max: DataFrame
    fragment_max_peptide: DataFrame


def load(psms: DataFrame, fragments: DataFrame, q: float = 1.0) -> SearchResults:
    """Deduplicated PSMs below q with their fragments.

    The first PSM (by psm_id) of each scan and peptide is kept before the q filter applies; mass shifts get
    names; fragments get their PSM's peptide, charge and rt; PSMs get the intensity of their top fragment.
    Without a PSM all four tables are empty, with their columns.
    """
    require_columns(psms, "psm_id", "scannr", "peptide", "spectrum_q", "charge", "rt")
    require_columns(fragments, "psm_id", "fragment_intensity")
    kept = below_q(first_rows(psms, ["scannr", "peptide"], "psm_id"), q).withColumn("peptide", replace_mass_shift(F.col("peptide")))
    own = kept.select("psm_id", "peptide", "charge", F.col("rt").cast("double").alias("rt"))
    found = members(fragments, kept, "psm_id").join(own, "psm_id", "left")
    top = max_fragment_per_psm(found)
    psms_out = kept.join(top.select("psm_id", "fragment_intensity"), "psm_id", "left")
    return SearchResults(found, psms_out, top, max_fragment_per_peptide(top))


def read(spark: SparkSession, psm_paths: list[str], fragment_paths: list[str], q: float = 1.0) -> SearchResults:
    return load(spark.read.parquet(*psm_paths), spark.read.parquet(*fragment_paths), q)
