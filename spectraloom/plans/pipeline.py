"""From search results and spectra to the wide feature table and its q-values: one lazy plan, materialised where it is written."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import digest as D
from ..operators import features as P
from ..operators import fragments as M
from ..operators import retention_time as R
from ..operators import search as E
from ..operators import spectra as S
from ..operators.aggregates import with_counts
from ..operators.filters import near_apex, without_residue
from ..operators.precursor import precursor_intensities
from ..operators.rescoring import dense_network, linear_model, rescored, tdc_qvalues
from ..sources import mzml, search_results, tables

log = logging.getLogger("spectraloom")


def with_apex(fragments: DataFrame, fragment_max_peptide: DataFrame, width: float = 3.0) -> DataFrame:
    """Fragments near their peptide's apex, the rt of its most intense fragment, with rt_max_peptide_sub."""
    apex = fragment_max_peptide.select("peptide", F.col("rt").cast("double").alias("rt_max_peptide_sub"))
    return near_apex(fragments.withColumn("rt", F.col("rt").cast("double")).join(apex, "peptide", "left"), width)


def correlation_features(fragments: DataFrame, fragment_max_peptide: DataFrame, predictions: DataFrame, width: float = 3.0) -> DataFrame:
    """The 53 correlation features of each peptidoform with predictions and fragments near its apex."""
    near = with_apex(fragments, fragment_max_peptide, width)
    return M.correlation_row(M.matrices(near, predictions))


def feature_table(results: search_results.SearchResults, spectra: DataFrame, config: EngineConfig = EngineConfig(), rt_predictions: DataFrame | None = None, fragment_predictions: DataFrame | None = None, provider: Callable = S.flat_provider) -> DataFrame:
    """The exported table from loaded results: rt features, counts, precursor peaks, collapsed columns, correlations."""
    psms = without_residue(results.psms)
    if rt_predictions is None:
        _, model, _ = R.retrained(psms)
        rt_predictions = R.predict_rt(psms, model)
    psms = with_counts(R.rt_features(psms, rt_predictions, config.rt_limit), least=config.min_count)
    psms = precursor_intensities(psms, spectra, config.ppm)
    predictions = S.predict_fragments(psms, provider) if fragment_predictions is None else fragment_predictions
    return P.pin_table(psms, correlation_features(results.fragments, results.fragment_max_peptide, predictions, config.apex_width))


def rt_provider(config: EngineConfig) -> R.RtProvider:
    return R.CompositionRt(ends=2 if config.rt_predictor == "ends" else 0)


def searched(spark: SparkSession, spectra: DataFrame, psms: DataFrame, config: EngineConfig) -> search_results.SearchResults:
    """Results of the windowed search: peptides of the FASTA file, where the first search's PSMs predict them to elute.

    Retention times of PSMs are in minutes, those of spectra in seconds. Both searches' columns are alike; what
    only the first engine reports is 0.
    """
    peptides, width = peptide_windows(tables.read_fasta(spark, config.fasta_file), psms, config)
    # a peptide of a target and a decoy counts as a target
    peptides = peptides.groupBy("peptide").agg(F.min(F.col("protein").startswith("rev_")).alias("is_decoy"), F.min("predictions_lower").alias("predictions_lower"), F.max("predictions_upper").alias("predictions_upper"))
    found, fragments = E.windowed_search(spectra, peptides, config.rt_interval, max(config.rt_interval, width), ppm=config.ppm)
    extra = {c: F.lit(0.0) for c in {*P.MAX_COLUMNS, *P.MIN_COLUMNS} - {*found.columns, "rt", "spectrum_q", "fragment_intensity", "rt_predictions", "rt_prediction_error_abs", "rt_prediction_error_abs_relative"} if not c.startswith("precursor_intensity")}
    named = {"proteins": F.col("peptide"), "num_proteins": F.lit(1), "expmass": F.col("calcmass"), "peptide_len": F.length("peptide"), "missed_cleavages": F.lit(0), "rt": F.col("rt") / 60.0}
    judged = tdc_qvalues(found.withColumns({**extra, **named}), "hyperscore").withColumnRenamed("q_value", "spectrum_q").drop("part")
    return search_results.load(judged, fragments)


def peptide_windows(proteins: DataFrame, psms: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, float]:
    """Digested peptides of targets and decoys with predicted rt and its bounds in seconds, and the width between the bounds."""
    peptides = D.digest(D.with_decoys(proteins), config.min_len, config.max_len, config.missed_cleavages)
    _, model, width = R.retrained(psms, rt_provider(config))
    predicted = peptides.join(R.predict_rt(peptides, model), "peptide")
    return R.rt_bounds(predicted, width), width * 60.0


def run(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """Reads the inputs named in the settings, writes the feature table and returns it with scores and q-values.

    The stages' results are cached as the settings say; with remove_intermediate_files the caches go in the
    end, and the returned table is read from result_dir/rescored.
    """
    began = time.time()

    def cache(read: bool, write: bool) -> tables.StageCache:
        return tables.StageCache(spark, f"{config.result_dir}/cache", read, write)

    inputs = {"psms": config.psm_path, "fragments": config.fragment_path, "fdr": config.fdr_init_search}
    found = search_results.read(spark, [config.psm_path], [config.fragment_path], config.fdr_init_search)
    search = cache(config.read_search_cache, config.write_search_cache)
    always = cache(config.read_search_cache, True)
    results = search_results.SearchResults(*(search.get(f"search_{n}", inputs, lambda n=n: getattr(found, n)) for n in found._fields))
    spectra = mzml.read_mzml(spark, config.mzml_path)
    if config.search_mode == "windowed":
        inputs |= {"fasta": config.fasta_file, "window": config.rt_interval, "lengths": [config.min_len, config.max_len, config.missed_cleavages], "mode": config.search_mode}
        again = search_results.SearchResults(*searched(spark, spectra, without_residue(results.psms), config))
        results = search_results.SearchResults(*(always.get(f"windowed_{n}", inputs, lambda n=n: getattr(again, n)) for n in again._fields))
    psms = without_residue(results.psms)

    def predicted_rt() -> DataFrame:
        first, second, _ = R.retrained(psms, rt_provider(config))
        known = spark.read.parquet(config.known_rt).select("peptide", "rt_predictions") if config.known_rt else None
        return tables.cached_predictions(psms.select("peptide").distinct(), known, "peptide", lambda asked: R.predict_rt(asked, second if config.transfer_learn else first))

    def predicted_ions() -> DataFrame:
        provider = S.fitted_provider(results.psms, results.fragments) if config.fragment_predictor == "fitted" else S.flat_provider
        keys = ["peptide", "charge"]
        known = spark.read.parquet(config.known_fragments).select(*keys, "fragment_name", "predicted") if config.known_fragments else None
        asked = psms.select("peptide", F.col("charge").cast("int").alias("charge")).distinct()
        return tables.cached_predictions(asked, known, keys, lambda new: S.predict_fragments(new, provider))

    predictors = {"transfer": config.transfer_learn, "rt_model": config.rt_predictor, "ions": config.fragment_predictor, "known": [config.known_rt, config.known_fragments]}
    rt = cache(config.read_rt_cache, config.write_rt_cache).get("rt", {**inputs, **predictors}, predicted_rt)
    ions = cache(config.read_fragment_cache, config.write_fragment_cache).get("ions", {**inputs, **predictors}, predicted_ions)
    settings = {**inputs, **predictors, "mzml": config.mzml_path, "rt": config.rt_limit, "apex": config.apex_width, "ppm": config.ppm, "count": config.min_count}
    features = cache(config.read_correlation_cache, True)
    # written always: the PIN file, the scaler, every fit and every q-value read it
    pin = features.get("features", settings, lambda: feature_table(results, spectra, config, rt, ions))
    tables.write_pin(pin, f"{config.result_dir}/outfile.pin")
    log.info("feature table written after %.1f s", time.time() - began)
    names = [c for c in pin.columns if c not in P.NOT_FEATURES]
    out = rescored(pin, names, model=dense_network if config.model_type == "network" else linear_model, rounds=config.rescoring_rounds)
    out.write.mode("overwrite").parquet(f"{config.result_dir}/rescored")
    if config.remove_intermediate_files:
        features.clear()
    elif not config.write_correlation_cache:
        features.drop("features", settings)
    return spark.read.parquet(f"{config.result_dir}/rescored")
