"""Structured Streaming forms of operators that order spectra in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import rt_bin


def binned(spectra: DataFrame, interval: float = 120.0) -> DataFrame:
    """A stream of spectra with rt_part, the right-closed retention-time bin: stateless."""
    return spectra.withColumn("rt_part", rt_bin(F.col("rt"), interval))


def bin_counts(spectra: DataFrame, interval: float = 120.0) -> DataFrame:
    """Running number of spectra and highest rt for each file and bin (update or complete mode)."""
    return binned(spectra, interval).groupBy("file", "rt_part").agg(F.count(F.lit(1)).alias("n"), F.max("rt").alias("rt_max"))


def carry_ms1(spectra: DataFrame) -> DataFrame:
    """MS2 spectra of a stream with the last MS1 scan of their file before them; state is one scan id per file.

    Files come in order of scan_index, batch by batch; within a batch rows are put in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("scan_index").itertuples():
            if r.ms_level == 1:
                last = r.scan_id
            elif last is not None:
                rows.append((key[0], r.scan_id, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["file", "scan_id", "ms1_scan_id"])

    return spectra.select("file", "scan_id", "scan_index", "ms_level").groupBy("file").applyInPandasWithState(run, "file string, scan_id string, ms1_scan_id string", "last string", "append", GroupStateTimeout.NoTimeout)
