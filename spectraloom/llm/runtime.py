"""Session helpers of the text operators: lineage cuts in the shared folder, checked broadcasts, block counts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20  # text that one grouped task call holds at once
BROADCAST_BYTES = 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the folder named by spark.checkpoint.dir and return it without lineage.

    A session on this machine alone (tests, a laptop) may name no folder and gets a temporary one; a
    cluster must name one that all its machines share.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spectraloom-checkpoint-"))
    return df.checkpoint()


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` materialised, with a broadcast hint if it takes `limit` bytes at most by count; else Spark shuffles it.

    A column counts as 16 bytes a row, a string or array also as its own bytes (8 an element).
    """
    out = cut(df)
    own = [F.octet_length(F.col(c)) if t == "string" else F.size(F.col(c)) * 8 for c, t in out.dtypes if t == "string" or t.startswith("array")]
    rows, more = out.agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(c, F.lit(0)).cast("long") for c in own), F.lit(0).cast("long")))).first()
    return F.broadcast(out) if rows * 16 * len(out.columns) + (more or 0) <= limit else out


def block_count(spark: SparkSession, size: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for `size` bytes; at least one for each core, so that small inputs use them all."""
    return max(-(-size // block_bytes), spark.sparkContext.defaultParallelism, 1)
