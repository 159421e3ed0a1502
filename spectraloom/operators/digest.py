"""Tryptic digestion of protein sequences, with decoys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaved(sequence: Column) -> Column:
    """Pieces of a sequence cut after K or R unless P follows."""
    return F.array_remove(F.split(sequence, r"(?<=[KR])(?!P)"), "")


def with_decoys(proteins: DataFrame, method: str = "reverse", prefix: str = "rev_", kinds: tuple[str, ...] = ("original", "decoy"), seed: int = 1) -> DataFrame:
    """(protein, sequence) of the wanted kinds; the name is the identifier up to the first blank."""
    if method not in ("reverse", "scramble"):
        raise ValueError("the decoy method is reverse or scramble")
    name = F.element_at(F.split("identifier", r"\s+"), 1)
    mixed = F.reverse("sequence") if method == "reverse" else F.array_join(F.transform(F.sort_array(F.transform(F.split("sequence", ""), lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col("identifier"), i).alias("o"), x.alias("x")))), lambda s: s["x"]), "")
    rows = {"original": F.struct(name.alias("protein"), F.col("sequence")), "decoy": F.struct(F.concat(F.lit(prefix), name).alias("protein"), mixed.alias("sequence"))}
    return proteins.select(F.inline(F.array(*(rows[k] for k in kinds))))


def digest(proteins: DataFrame, min_len: int = 5, max_len: int = 50, missed: int = 2, first_occurrence: bool = False) -> DataFrame:
    """(protein, start, end, id, peptide) of (protein, sequence): up to `missed` missed cleavages, without X, by length.

    Offsets are the peptide's own; first_occurrence=True gives those of its first occurrence in the sequence.
    """
    p = proteins.select("protein", "sequence", cleaved(F.col("sequence")).alias("pieces"))
    p = p.withColumn("ends", F.transform("pieces", lambda x, i: F.aggregate(F.slice("pieces", 1, i + 1), F.lit(0), lambda s, y: s + F.length(y))))
    p = p.where(F.size("pieces") > 0).select("protein", "sequence", "pieces", "ends", F.posexplode("pieces").alias("at", "piece"))
    p = p.withColumn("more", F.explode(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("pieces") - 1 - F.col("at")))))
    p = p.withColumns({"peptide": F.array_join(F.slice("pieces", F.col("at") + 1, F.col("more") + 1), ""), "own": F.get("ends", F.col("at")) - F.length("piece")})
    start = F.expr("locate(peptide, sequence)") - 1 if first_occurrence else F.col("own")
    p = p.where(~F.col("peptide").contains("X") & F.length("peptide").between(min_len, max_len)).withColumn("start", start)
    p = p.withColumn("end", F.col("start") + F.length("peptide"))
    return p.select("protein", "start", "end", F.concat_ws("|", "protein", "start", "end").alias("id"), "peptide")
