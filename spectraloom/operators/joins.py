"""Joins that need a rewrite in Spark: ranges, intervals, carry-forward, running ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side is broadcast only below this size, by the optimizer's estimate and by its rows; above, both sides are shuffled on the bucket.
BROADCAST_BYTES = 32 << 20
#: Ranges of a bucket that meet a point in one task; a bucket with more is cut into pieces of about so many.
PIECE_RANGES = 1 << 16


def is_small(df: DataFrame) -> bool:
    """Whether df is proven small enough to broadcast.

    The optimizer's estimate is of compressed files and can be a hundredth of the rows' size in memory, so a side that
    passes it is counted as well, up to the first row too many. A row is taken to have its types' default size.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return False
    most = BROADCAST_BYTES // (df._jdf.schema().defaultSize() + 32)
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """A hint to broadcast a side that is proven small and to merge any other, which Spark's own estimate might broadcast."""
    return df.hint("broadcast" if is_small(df) else "merge")


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float, on: list[str] = [], how: str = "inner", small: bool = True) -> DataFrame:
    """Rows of both sides with low <= at <= high (and equal `on` columns).

    Ranges are dealt to every bucket of `width` that they touch and points to their own, so the join has an
    equality that hashes; each pair comes once. Choose a width near the usual length of a range. Ranges that are not
    small meet the points packed (`packed_pairs`). small=False never broadcasts or packs the ranges: for those that
    are as many as the points and hardly ever equal.
    """
    p = points.withColumn("__bucket", F.floor(at / width).cast("long")).withColumn("__at", at)
    r = ranges.withColumns({"__low": low, "__high": high}).where("__low <= __high")
    r = r.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__low") / width).cast("long"), F.floor(F.col("__high") / width).cast("long"))))
    few = small and is_small(r)
    if small and not few and how == "inner":
        return packed_pairs(p, r, points.columns, ranges.columns, on)
    pairs = p.join(r.hint("broadcast" if few else "merge"), [*on, "__bucket"], "inner").where("__at between __low and __high")
    if how == "left_semi":
        return pairs.select(*points.columns).distinct()
    return pairs.drop("__bucket", "__at", "__low", "__high")


def packed_pairs(p: DataFrame, r: DataFrame, points: list[str], ranges: list[str], on: list[str]) -> DataFrame:
    """The pairs of a range join by shuffles alone; both sides have their columns and `on`, __bucket and __at or __low, __high.

    Equal ranges of a bucket become one row with an array of what they carry: a point is compared with each range once and
    its pairs are the elements. A bucket of very many ranges is cut into pieces, which its points meet in several tasks, so
    neither arrays nor the rows that a merge holds of a key grow with the table. Only the extent and counts of the ranges
    reach the driver; points outside that extent are not shuffled.
    """
    keys = [*on, "__bucket"]
    counts = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"), F.min("__low").alias("__low"), F.max("__high").alias("__high"))
    cut = F.col("__count") > PIECE_RANGES
    total, hot, least, most = counts.agg(F.coalesce(F.sum("__count"), F.lit(0)), F.count_if(cut), F.min("__low"), F.max("__high")).first()
    p = p.where(F.col("__at").between(F.lit(least), F.lit(most)))
    if hot:
        pieces = counts.where(cut).select(*keys, F.ceil(F.col("__count") / PIECE_RANGES).cast("int").alias("__pieces"))
        pieces = pieces.hint("broadcast" if hot <= 100_000 else "merge")
        p, r = (df.join(pieces, keys, "left").withColumn("__pieces", F.coalesce("__pieces", F.lit(1))) for df in (p, r))
        p = p.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
        r = r.withColumn("__piece", F.pmod(F.xxhash64(*ranges), F.col("__pieces")).cast("int"))
        keys = [*keys, "__piece"]
    n = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PIECE_RANGES))
    carried = [c for c in ranges if c not in on]
    packed = r.repartition(n, *keys).groupBy(*keys, "__low", "__high").agg(F.collect_list(F.struct(F.lit(0).alias("__one"), *carried)).alias("__packed"))
    pairs = p.repartition(n, *keys).join(packed.hint("merge"), keys).where("__at between __low and __high")
    return pairs.select(*on, *(c for c in points if c not in on), F.inline("__packed").alias("__one", *carried)).drop("__one")


def interval_overlap_join(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str, width: float) -> DataFrame:
    """Pairs of rows whose closed intervals overlap.

    Both sides are dealt to the buckets they touch; of a pair's common buckets only the first counts, which
    is the bucket of the greater lower end.
    """

    def dealt(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        span = F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))
        return df.where(F.col(low) <= F.col(high)).withColumn(name, F.explode(span))

    a, b = dealt(left, left_low, left_high, "__a"), dealt(right, right_low, right_high, "__b")
    start = F.greatest(F.col(left_low), F.col(right_low))
    met = (F.col("__a") == F.col("__b")) & (start <= F.least(F.col(left_high), F.col(right_high))) & (F.col("__a") == F.floor(start / width))
    return a.join(maybe_broadcast(b), met).drop("__a", "__b")


def ppm_range_join(peaks: DataFrame, targets: DataFrame, mz: str = "mz", target: str = "target_mz", ppm: float = 20.0, on: list[str] = [], width: float = 0.05) -> DataFrame:
    """Peaks within ppm of a target, both ends included."""
    tolerance = F.col(target) * F.lit(ppm) * F.lit(1e-6)
    return range_join(peaks, targets, F.col(mz), F.col(target) - tolerance, F.col(target) + tolerance, width, on)


def carry_forward(df: DataFrame, partition: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`name`: the latest non-null `value` up to each row in its partition."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def ms1_of_ms2(spectra: DataFrame) -> DataFrame:
    """MS2 spectra with ms1_scan_id, the last MS1 spectrum before each in its file; those before any MS1 go."""
    carried = carry_forward(spectra, ["file"], ["scan_index"], F.when(F.col("ms_level") == 1, F.col("scan_id")), "ms1_scan_id")
    return carried.where("ms_level = 2 AND ms1_scan_id IS NOT NULL")


def base_name(path: Column) -> Column:
    """The last part of a path, without its scheme and folders."""
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def of_file(scans: DataFrame, psms: DataFrame, scan: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with __file, by which scans of equal ids in different files are told apart.

    scans has `file`; psms are of the file that their `filename` names, folders apart. PSMs without that
    column are taken to be of the first file, by name, that has their scan. Scans without `file` are of one file.
    """
    if "file" not in scans.columns:
        return scans.withColumn("__file", F.lit("")), psms.withColumn("__file", F.lit(""))
    if "filename" in psms.columns:
        return scans.withColumn("__file", base_name(F.col("file"))), psms.withColumn("__file", base_name(F.col("filename")))
    first = scans.groupBy(*scan).agg(F.min("file").alias("file"))
    return scans.join(first, [*scan, "file"], "left_semi").withColumn("__file", F.lit("")), psms.withColumn("__file", F.lit(""))


def running_offset(df: DataFrame, part: str, column: str = "psm_id") -> DataFrame:
    """Ids made unique over parts: each part starts after the greatest id of the parts before it.

    One small aggregate and a window over the parts alone, one row each, of which a run has some hundred at
    most; the rows themselves are not put in order.
    """
    tops = df.groupBy(part).agg((F.max(column) + 1).alias("__size"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select(part, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    return df.join(offsets, part).withColumn(column, F.col(column) + F.col("__offset")).drop("__offset")


def rt_bin(rt: Column, interval: float = 120.0) -> Column:
    """Upper end of the right-closed bin of `interval` that holds rt; the first bin also holds 0."""
    return F.greatest(F.ceil(rt / interval), F.lit(1)) * F.lit(interval)


def isolation_groups(spectra: DataFrame) -> DataFrame:
    """(window, scan_ids): spectra by isolation window "low|high" rounded to 3 places; those without a target go."""
    low = F.round(F.col("target_mz") - F.col("lower_offset"), 3)
    high = F.round(F.col("target_mz") + F.col("upper_offset"), 3)
    window = F.concat_ws("|", low.cast("string"), high.cast("string"))
    return spectra.where("target_mz is not null and target_mz <> 0").groupBy(window.alias("window")).agg(F.sort_array(F.collect_list("scan_id")).alias("scan_ids"))
