"""Mixing sources to target weights: temperature on token shares, a bisected exponent, budgets realised as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import word_count
from .runtime import cut, sized


@dataclass(frozen=True)
class Mixture:
    """Targets of a mixture.

    entropy: wanted entropy of the weights as a share of its maximum, log(number of sources); None: no target.
    repeats: the most often that a source's tokens may be gone through; a budget beyond that is an error.
    budget: tokens to draw; None: as many as one pass over the corpus has. cover: draw so many that every
    source is gone through once at least (budget is then ignored).
    """

    entropy: float | None = 0.95
    repeats: float = 4.0
    budget: int | None = None
    cover: bool = False
    blocks: int = 4096
    seed: int = 1


HALVINGS = 6  # bisection steps that one pass over the source totals settles
PASSES = 5


def exponent(totals: DataFrame, mixture: Mixture) -> tuple[float, float, int]:
    """(exponent, sum of p**exponent, budget in tokens) from totals (source, tokens).

    The exponent is the largest that meets the entropy target, raised where needed to the smallest that
    keeps every source within the repetition limit; 1 leaves the shares as they are. Only sums over the
    sources come to the driver, never the sources. ValueError if no weights keep the budget within the limit.
    """
    some = totals.where("tokens > 0")
    n, total, least, most = some.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0, 0.0, 0
    low_p, high_p = least / total, most / total
    p = F.col("tokens") / F.lit(float(total))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        row = some.agg(*(F.sum(F.pow(p, F.lit(a))) for a in exponents), *(F.sum(F.pow(p, F.lit(a)) * F.ln(p)) for a in exponents)).first()
        return list(zip(row[: len(exponents)], row[len(exponents) :]))

    def bisect(fits) -> float:
        """Smallest exponent in [0, 1] that fits, for a condition that holds from some exponent on."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            step = (high - low) / 2**HALVINGS
            grid = [low + step * i for i in range(1, 2**HALVINGS)]
            good = [fits(a, z, t) for a, (z, t) in zip(grid, sums(grid))]
            at = good.index(True) if True in good else len(grid)
            low, high = (grid[at - 1] if at else low), (grid[at] if at < len(grid) else high)
        return high

    def budget_at(a: float, z: float) -> float:
        return total * z / high_p ** (a - 1) if mixture.cover else float(total if mixture.budget is None else mixture.budget)

    if budget_at(1.0, 1.0) > mixture.repeats * total * (1 + 1e-9):  # shares as they are repeat the sources least
        raise ValueError(f"{budget_at(1.0, 1.0):.0f} tokens are more than {mixture.repeats:g} times the {total} there are")
    within = bisect(lambda a, z, t: low_p ** (a - 1) / z * budget_at(a, z) / total <= mixture.repeats)
    flat = 0.0
    if mixture.entropy is not None:
        goal = mixture.entropy * math.log(n)
        flat = bisect(lambda a, z, t: math.log(z) - a * t / z < goal)  # entropy falls as the exponent rises
    a = max(within, flat)
    z = sums([a])[0][0]
    return a, z, math.ceil(budget_at(a, z) - 1e-6)


def unit_order(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


OUTPUTS = ("n_tokens", "block", "block_rank", "copies")


def mix_sources(docs: DataFrame, mixture: Mixture = Mixture(), tokens: Column | None = None) -> DataFrame:
    """All rows and columns of `docs` with n_tokens, block, block_rank and copies (how often the mixture takes the row).

    A source of weight w gets floor(w * budget) tokens: whole passes first, then blocks in the order of a
    seeded permutation until the rest is used up; the block at the limit is cut between documents, in the
    order of a hash. A source is dealt to `blocks` blocks by doc_id (by text where that is null), so no step
    holds a source's rows together: block totals are counted, and only the one block at the limit is put in
    order, to find the last document that it gives. `docs` is not shuffled if the table of blocks is small.

    Tokens are words unless given. Null source is a source. Null or empty text has no tokens; sources
    without tokens get weight 0 and copies 0. Rows that share a doc_id share their block and are told apart
    by text only; equal rows tie and are taken together or not at all. An empty table stays empty. A budget
    that no weights can meet within the repetition limit raises ValueError. Columns of `docs` named like
    one of the four results are replaced; other columns may have any name but one that begins with __mix.
    """
    docs = docs.drop(*OUTPUTS)
    count = F.coalesce(word_count(F.col("text")) if tokens is None else tokens, F.lit(0)).cast("long")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), "text")).otherwise(F.xxhash64(F.lit(mixture.seed), "doc_id"))
    dealt = docs.withColumn("block", F.pmod(key, F.lit(mixture.blocks)).cast("long"))
    counted = dealt.select(F.col("source").alias("__mix_source"), F.col("block").alias("__mix_block"), count.alias("n_tokens"))
    block = cut(counted.groupBy("__mix_source", "__mix_block").agg(F.sum("n_tokens").alias("tokens")))
    totals = cut(block.groupBy("__mix_source").agg(F.sum("tokens").alias("tokens")))
    a, z, budget = exponent(totals, mixture)
    grand = totals.agg(F.sum("tokens")).first()[0] or 1
    share = F.pow(F.col("tokens") / F.lit(float(grand)), F.lit(a)) / F.lit(z or 1.0)
    plan = totals.select(F.col("__mix_source").alias("__mix_s"), F.col("tokens").alias("total"), F.when(F.col("tokens") > 0, F.floor(share * F.lit(float(budget)) + F.lit(1e-6))).otherwise(0).alias("wanted"))
    order = W.partitionBy("__mix_source").orderBy(F.xxhash64(F.lit(mixture.seed), F.col("__mix_source"), F.col("__mix_block")), "__mix_block")
    ranked = block.select("*", F.row_number().over(order).cast("long").alias("__mix_rank"), (F.sum("tokens").over(order) - F.col("tokens")).alias("before"))
    ranked = ranked.join(plan, ranked["__mix_source"].eqNullSafe(plan["__mix_s"]))
    passes = F.when(F.col("total") > 0, F.floor(F.col("wanted") / F.col("total"))).otherwise(0).cast("long")
    ranked = ranked.withColumn("passes", passes).withColumn("left", (F.col("wanted") - F.col("passes") * F.col("total") - F.col("before")).cast("long"))
    whole = (F.col("left") > 0) & (F.col("left") >= F.col("tokens"))
    steps = cut(ranked.select("__mix_source", "__mix_block", F.col("__mix_rank").alias("block_rank"), (F.col("passes") + whole.cast("long")).alias("__mix_copies"), F.when((F.col("left") > 0) & ~whole, F.col("left")).alias("__mix_left")))

    def at(left: DataFrame, right: DataFrame) -> Column:
        return left["source"].eqNullSafe(right["__mix_source"]) & (left["block"] == right["__mix_block"])

    # the block at the limit of each source: its documents in order give up to the last one that fits
    place = F.struct(F.xxhash64(F.lit(mixture.seed + 1), "doc_id").alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"))
    limit = steps.where(F.col("__mix_left").isNotNull()).select("__mix_source", "__mix_block", "__mix_left")
    cut_here = dealt.join(F.broadcast(limit) if limit.count() <= 100_000 else limit, at(dealt, limit)).select("__mix_source", "__mix_left", place.alias("place"), count.alias("n_tokens"))
    so_far = F.sum("n_tokens").over(W.partitionBy("__mix_source").orderBy("place"))  # ties are one step
    upto = cut_here.select("__mix_source", "place", "__mix_left", so_far.alias("n")).where("n <= __mix_left").groupBy("__mix_source").agg(F.max("place").alias("__mix_upto"))
    upto = upto.withColumnRenamed("__mix_source", "__mix_s")
    steps = steps.join(upto, steps["__mix_source"].eqNullSafe(upto["__mix_s"]) & steps["__mix_left"].isNotNull(), "left")
    steps = sized(steps.select("__mix_source", "__mix_block", "block_rank", "__mix_copies", "__mix_upto"))
    got = dealt.join(steps, at(dealt, steps))
    copies = F.col("__mix_copies") + F.coalesce((place <= F.col("__mix_upto")).cast("long"), F.lit(0))
    return got.select(*(F.col(f"`{c}`") for c in docs.columns), count.alias("n_tokens"), "block", "block_rank", copies.alias("copies"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", *OUTPUTS)
