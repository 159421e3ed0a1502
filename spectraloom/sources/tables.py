"""Text formats: FASTA, TSV, CSV, PIN; Parquet checkpoints of stages and prediction caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, sequence): identifier is the whole header line without '>'. Entries split at line starts, so files split across tasks."""
    entry = F.regexp_replace("value", r"^\s*>", "")
    rows = spark.read.option("lineSep", "\n>").text(path).select(entry.alias("e")).where(F.trim("e") != "")
    return rows.select(F.trim(F.regexp_extract("e", r"^([^\r\n]*)", 1)).alias("identifier"), F.regexp_replace(F.regexp_replace("e", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))


def fasta_lines(peptides: DataFrame) -> DataFrame:
    """(value): the two lines of each (id, peptide)."""
    return peptides.select(F.concat(F.lit(">"), "id", F.lit("\n"), "peptide").alias("value"))


def write_fasta(peptides: DataFrame, path: str) -> None:
    fasta_lines(peptides).write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Arrays go as JSON. one_file is for exchange with tools that want a single file; only the writing is then one task."""
    flat = df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes))
    (flat.repartition(1) if one_file else flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pin(pin: DataFrame, path: str, one_file: bool = True) -> None:
    """One file by default, as rescoring tools read it; else a folder of parts."""
    write_tsv(pin, path, one_file)


read_pin = read_tsv


class StageCache:
    """Stage results as Parquet, keyed by a digest of the stage's inputs and settings, so that a changed setting is a miss."""

    def __init__(self, spark: SparkSession, root: str, read: bool = True, write: bool = True):
        self.spark, self.root, self.read, self.write = spark, root.rstrip("/"), read, write

    def path(self, stage: str, settings: dict) -> str:
        return f"{self.root}/{stage}-{hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]}"

    def exists(self, path: str) -> bool:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        p = jvm.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def clear(self) -> None:
        """Removes everything under the root, for runs that keep no intermediate files."""
        self._remove(self.root)

    def drop(self, stage: str, settings: dict) -> None:
        """Removes one result."""
        self._remove(self.path(stage, settings))

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def get(self, stage: str, settings: dict, make) -> DataFrame:
        path = self.path(stage, settings)
        if self.read and self.exists(path):
            return self.spark.read.parquet(path)
        out = make()
        if not self.write:
            return out
        out.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def cached_predictions(asked: DataFrame, known: DataFrame | None, key: str | list[str], predict) -> DataFrame:
    """Known predictions of the asked keys, and new ones for the keys that are not known."""
    if known is None:
        return predict(asked)
    keys = [key] if isinstance(key, str) else key
    new = asked.join(known.select(*keys).distinct(), keys, "left_anti")
    return known.join(asked.select(*keys).distinct(), keys, "left_semi").unionByName(predict(new))
