"""Queries over the driver's tables, one for each operator, each with the SQL that must give the same rows.

The tables stand in for search output: orders are PSMs, lineitem rows are matched fragments, customers are
retention-time predictions, events are scans in order, embeddings are intensity vectors. Floats are rounded
in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregates as A
from ..operators import digest as D
from ..operators import features as P
from ..operators import filters as L
from ..operators import fragments as M
from ..operators import joins as J
from ..operators import precursor as I
from ..operators import rescoring as Q
from ..operators import retention_time as R
from ..operators import search as E
from ..operators import spectra as S
from ..sources import search_results, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PSM = """
psm AS (SELECT o_orderkey AS psm_id, 'P' || o_custkey AS peptide, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END AS charge,
  o_totalprice / 1000 AS rt, CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS spectrum_q, o_custkey % 7 = 0 AS is_decoy, o_orderpriority AS filename,
  'scan=' || (o_custkey % 50) AS scannr, 500 + o_totalprice / 100 AS calcmass, o_totalprice / 5000 AS hyperscore FROM orders)"""
FRAG = """
frag AS (SELECT l_orderkey AS psm_id, l_returnflag || l_linenumber || '/1' AS fragment_name, l_extendedprice AS fragment_intensity, l_quantity AS predicted FROM lineitem)"""
OWN = """
own AS (SELECT peptide, charge, frag.*, rt FROM frag JOIN psm USING (psm_id))"""
RTP = """
rtp AS (SELECT 'P' || c_custkey AS peptide, 250 + c_acctbal / 50 AS rt_predictions FROM customer)"""
VEC = """
vec AS (SELECT vec_id // 20 AS grp, vec_id, i AS dim, CASE WHEN abs(e) < 0.02 THEN 0 ELSE e END AS x
  FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding[1:64])::DOUBLE AS e FROM embeddings) WHERE e IS NOT NULL)"""


def query(name: str, sql: str | None = None, *ctes: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = ("WITH" + ",".join(ctes) + "\n" if ctes else "") + sql
        return f

    return register


def r(c: Column, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)


NUDGE = 1 + 1e-11  # halves, which sums in another order miss on either side, all round up


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def psm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("psm_id"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("peptide"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(4).alias("charge"),
        (F.col("o_totalprice") / 1000).alias("rt"),
        ((F.col("o_orderkey") % 1000).cast("double") / 1000).alias("spectrum_q"),
        (F.col("o_custkey") % 7 == 0).alias("is_decoy"),
        F.col("o_orderpriority").alias("filename"),
        F.concat(F.lit("scan="), (F.col("o_custkey") % 50).cast("string")).alias("scannr"),
        (F.lit(500) + F.col("o_totalprice") / 100).alias("calcmass"),
        (F.col("o_totalprice") / 5000).alias("hyperscore"),
    )


def frag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("psm_id"),
        X.fragment_name(F.col("l_returnflag"), F.col("l_linenumber"), F.lit(1)).alias("fragment_name"),
        F.col("l_extendedprice").alias("fragment_intensity"),
        F.col("l_quantity").alias("predicted"),
    )


def own(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with their PSM's peptide, charge and rt."""
    return frag(spark, d).join(psm(spark, d).select("psm_id", "peptide", "charge", "rt"), "psm_id")


def rtp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("peptide"), (F.lit(250) + F.col("c_acctbal") / 50).alias("rt_predictions"))


def vec(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the vectors, twenty vectors to a group, small ones as 0."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).cast("long").alias("grp"), "vec_id", F.posexplode("embedding").alias("dim", "e"))
    e = F.col("e").cast("double")
    return rows.select("grp", "vec_id", F.col("dim").cast("long").alias("dim"), F.when(F.abs(e) < 0.02, 0.0).otherwise(e).alias("x"))


# --- sources and formats


@query("scan_parquet", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 50")
def _(spark, d):
    return table(spark, d, "events").where("value > 50").select("event_id", "user_id", "event_type", "value")


@query(
    "psm_load",
    """, m AS (SELECT psm.*, row_number() OVER (PARTITION BY scannr, peptide ORDER BY psm_id) AS n FROM psm),
k AS (SELECT psm_id, replace(peptide || '[+15.9949]', '[+15.9949]', '[Oxidation]') AS peptide, charge, rt FROM m WHERE n = 1 AND spectrum_q < 0.5)
SELECT k.*, (SELECT max(fragment_intensity) FROM frag WHERE frag.psm_id = k.psm_id) AS fragment_intensity FROM k""",
    PSM,
    FRAG,
)
def _(spark, d):
    p = psm(spark, d).withColumn("peptide", F.concat("peptide", F.lit("[+15.9949]")))
    return search_results.load(p, frag(spark, d), 0.5).psms.select("psm_id", "peptide", "charge", "rt", "fragment_intensity")


@query("rt_partition", "SELECT greatest(ceil(rt / 60), 1) * 60.0::DOUBLE AS rt_part, count(*) AS n, min(rt) AS rt_min, max(rt) AS rt_max FROM psm GROUP BY 1", PSM)
def _(spark, d):
    binned = psm(spark, d).withColumn("rt_part", J.rt_bin(F.col("rt"), 60.0).cast("double"))
    return binned.groupBy("rt_part").agg(F.count(F.lit(1)).alias("n"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"))


@query(
    "isolation_window_groups",
    """SELECT round(400 + (event_id % 50) * 12.5::DOUBLE - 6.25, 3)::DOUBLE::VARCHAR || '|' || round(400 + (event_id % 50) * 12.5::DOUBLE + 6.25, 3)::DOUBLE::VARCHAR AS "window",
array_to_string(list_sort(list('scan=' || event_id)), ',') AS scan_ids FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def _(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'")
    target = F.lit(400.0) + (F.col("event_id") % 50) * F.lit(12.5)
    s = e.select(F.concat(F.lit("scan="), F.col("event_id").cast("string")).alias("scan_id"), target.alias("target_mz"), F.lit(6.25).alias("lower_offset"), F.lit(6.25).alias("upper_offset"))
    return J.isolation_groups(s).select("window", F.array_join("scan_ids", ",").alias("scan_ids"))


@query("fasta_format", "SELECT '>p|' || p_partkey || chr(10) || upper(replace(p_name, ' ', '')) AS value FROM part")
def _(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p|"), F.col("p_partkey").cast("string")).alias("id"), F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("peptide"))
    return tables.fasta_lines(p)


# --- filters and projections


@query("filter_q", "SELECT psm_id, spectrum_q FROM psm WHERE spectrum_q < 0.01", PSM)
def _(spark, d):
    return L.below_q(psm(spark, d), 0.01).select("psm_id", "spectrum_q")


@query("filter_not_contains", "SELECT psm_id, peptide FROM psm WHERE peptide NOT LIKE '%7%'", PSM)
def _(spark, d):
    return L.without_residue(psm(spark, d), "7").select("psm_id", "peptide")


APEX = """
tops AS (SELECT DISTINCT ON (psm_id) * FROM own ORDER BY psm_id, fragment_intensity DESC, fragment_name, predicted),
apex AS (SELECT DISTINCT ON (peptide) peptide, rt AS rt_max FROM tops ORDER BY peptide, fragment_intensity DESC, psm_id)"""


def near(spark, d, width=60.0):
    from .pipeline import with_apex

    f = own(spark, d).select("psm_id", "fragment_name", "fragment_intensity", "predicted", "peptide", "charge", "rt")
    return with_apex(f, A.max_fragment_per_peptide(A.max_fragment_per_psm(f)), width)


@query("apex_rt_filter", "SELECT psm_id, fragment_name, fragment_intensity, rt, rt_max AS rt_max_peptide_sub FROM own JOIN apex USING (peptide) WHERE abs(rt - rt_max) < 60", PSM, FRAG, OWN, APEX)
def _(spark, d):
    return near(spark, d).select("psm_id", "fragment_name", "fragment_intensity", "rt", "rt_max_peptide_sub")


@query("semi_join_fragments", "SELECT psm_id, fragment_name, fragment_intensity FROM frag WHERE psm_id IN (SELECT psm_id FROM psm WHERE spectrum_q < 0.01)", PSM, FRAG)
def _(spark, d):
    return L.members(frag(spark, d), L.below_q(psm(spark, d), 0.01), "psm_id").select("psm_id", "fragment_name", "fragment_intensity")


@query("label_case", "SELECT psm_id, CASE WHEN is_decoy THEN -1 ELSE 1 END AS label, psm_id || '|' || filename || '|' || scannr AS spec_id FROM psm", PSM)
def _(spark, d):
    return psm(spark, d).select("psm_id", X.label(F.col("is_decoy")).alias("label"), X.spec_id(F.col("psm_id"), F.col("filename"), F.col("scannr")).alias("spec_id"))


@query("fill_missing", "SELECT psm_id, coalesce(CASE WHEN charge = 2 THEN NULL ELSE rt END, 0.0) AS rt FROM psm", PSM)
def _(spark, d):
    return psm(spark, d).select("psm_id", F.when(F.col("charge") == 2, F.when(F.col("psm_id") % 2 == 0, F.lit(float("nan")))).otherwise(F.col("rt")).alias("rt")).fillna(0.0)


@query("dedup_first", "SELECT psm_id, scannr, peptide FROM psm QUALIFY row_number() OVER (PARTITION BY scannr, peptide ORDER BY psm_id) = 1", PSM)
def _(spark, d):
    return L.first_rows(psm(spark, d), ["scannr", "peptide"], "psm_id").select("psm_id", "scannr", "peptide")


@query(
    "qc_psm",
    """SELECT count(*) FILTER (psm_id % 11 = 0) AS bad_peptide, count(*) FILTER (charge - 3 <= 0) AS bad_charge,
count(*) FILTER (rt - 100 < 0) AS bad_rt, count(*) FILTER (spectrum_q * 2 > 1) AS bad_q FROM psm""",
    PSM,
)
def _(spark, d):
    p = psm(spark, d).select(F.when(F.col("psm_id") % 11 != 0, F.col("peptide")).alias("peptide"), (F.col("charge") - 3).alias("charge"), (F.col("rt") - 100).alias("rt"), (F.col("spectrum_q") * 2).alias("spectrum_q"))
    return L.findings(p, L.PSM_CHECKS)


@query("qc_fragment", "SELECT count(*) FILTER (lower(l_returnflag) NOT IN ('a', 'b', 'c', 'x', 'y', 'z')) AS bad_type, count(*) FILTER (l_extendedprice - 5000 < 0) AS bad_intensity FROM lineitem")
def _(spark, d):
    f = table(spark, d, "lineitem").select(F.lower("l_returnflag").alias("fragment_type"), (F.col("l_extendedprice") - 5000).alias("fragment_intensity"))
    return L.findings(f, L.FRAGMENT_CHECKS)


# --- joins


@query("join_left_fragments", "SELECT frag.psm_id, fragment_name, fragment_intensity, peptide, charge, rt FROM frag LEFT JOIN psm USING (psm_id)", PSM, FRAG)
def _(spark, d):
    return frag(spark, d).join(psm(spark, d), "psm_id", "left").select("psm_id", "fragment_name", "fragment_intensity", "peptide", "charge", "rt")


def windows(spark, d):
    peptides = rtp(spark, d).select("peptide", (F.col("rt_predictions") - 5).alias("predictions_lower"), (F.col("rt_predictions") + 5).alias("predictions_upper"))
    parts = table(spark, d, "nation").select(F.col("n_nationkey").alias("part"), (F.lit(230.0) + F.col("n_nationkey") * 9).alias("upper"))
    return E.candidates(peptides, parts, 12.0)


@query(
    "interval_overlap_join",
    """SELECT peptide, n_nationkey AS part FROM rtp JOIN nation ON greatest(rt_predictions - 5, 230.0 + n_nationkey * 9 - 12.0) <= least(rt_predictions + 5, 230.0 + n_nationkey * 9)""",
    RTP,
)
def _(spark, d):
    return windows(spark, d).select("peptide", "part")


@query(
    "ppm_range_join",
    """SELECT l_orderkey AS scan, l_linenumber AS n, 100 + l_extendedprice / 100 AS mz, p_partkey AS target FROM lineitem JOIN part
ON 100 + l_extendedprice / 100 BETWEEN p_retailprice / 2 - p_retailprice / 2 * 20.0::DOUBLE * 1e-6 AND p_retailprice / 2 + p_retailprice / 2 * 20.0::DOUBLE * 1e-6""",
)
def _(spark, d):
    peaks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("n"), (F.lit(100) + F.col("l_extendedprice") / 100).alias("mz"))
    targets = table(spark, d, "part").select(F.col("p_partkey").alias("target"), (F.col("p_retailprice") / 2).alias("target_mz"))
    return J.ppm_range_join(peaks, targets).select("scan", "n", "mz", "target")


@query("anti_join_orphans", "SELECT psm_id, peptide FROM psm WHERE psm_id NOT IN (SELECT l_orderkey FROM lineitem)", PSM)
def _(spark, d):
    return L.orphans(psm(spark, d), frag(spark, d), "psm_id").select("psm_id", "peptide")


# --- aggregates


@query("first_entry", "SELECT DISTINCT ON (peptide, charge) peptide, charge, psm_id, scannr, rt FROM psm ORDER BY peptide, charge, rt, psm_id", PSM)
def _(spark, d):
    return A.first_entry(psm(spark, d), ["peptide", "charge"], ["psm_id", "scannr", "rt"], "rt", "psm_id")


@query("peptide_count_filter", "SELECT psm_id, peptide, count(*) OVER (PARTITION BY peptide) AS count FROM psm QUALIFY count(*) OVER (PARTITION BY peptide) >= 12", PSM)
def _(spark, d):
    return A.with_counts(psm(spark, d), least=12).select("psm_id", "peptide", "count")


@query("max_fragment_per_psm", "SELECT DISTINCT ON (psm_id) * FROM frag ORDER BY psm_id, fragment_intensity DESC, fragment_name, predicted", FRAG)
def _(spark, d):
    return A.max_fragment_per_psm(frag(spark, d))


@query("max_fragment_per_peptide", "SELECT DISTINCT ON (peptide) peptide, psm_id, fragment_name, fragment_intensity FROM own ORDER BY peptide, fragment_intensity DESC, psm_id, fragment_name", PSM, FRAG, OWN)
def _(spark, d):
    return A.max_fragment_per_peptide(own(spark, d).select("peptide", "psm_id", "fragment_name", "fragment_intensity"))


@query(
    "collapse_features",
    """SELECT peptide, charge, max(hyperscore) AS hyperscore_max, min(rt) AS rt_min, min(hyperscore) AS hyperscore_min, round(avg(spectrum_q), 6) + 0.0 AS spectrum_q_mean,
round(sum(rt), 2) + 0.0 AS rt_sum FROM psm GROUP BY ALL""",
    PSM,
)
def _(spark, d):
    out = A.collapse(psm(spark, d), ["peptide", "charge"], ["hyperscore"], ["rt", "hyperscore"], ["spectrum_q"], ["rt"])
    return out.withColumns({"spectrum_q_mean": r(F.col("spectrum_q_mean")), "rt_sum": r(F.col("rt_sum"), 2)})


@query("rt_error_p95", "SELECT round(quantile_cont(abs(rt - rt_predictions), 0.95), 5) + 0.0 AS p95 FROM psm JOIN rtp USING (peptide)", PSM, RTP)
def _(spark, d):
    return A.percentile(psm(spark, d).join(rtp(spark, d), "peptide"), F.abs(F.col("rt") - F.col("rt_predictions")), 95, "p95").select(r(F.col("p95"), 5).alias("p95"))


@query(
    "pivot_intensity",
    """SELECT l_orderkey AS psm_id, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0), 4) + 0.0 AS "A", round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 0), 4) + 0.0 AS "N",
round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0), 4) + 0.0 AS "R" FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    out = A.pivot_sum(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "psm_id"), "psm_id", "l_returnflag", "l_extendedprice", ["A", "N", "R"])
    return out.select("psm_id", *(r(F.col(c), 4).alias(c) for c in "ANR"))


@query("nonzero_counts", "SELECT l_orderkey AS psm_id, count(*) FILTER (l_discount <> 0) AS non_zero_count FROM lineitem GROUP BY 1")
def _(spark, d):
    return A.non_zero_counts(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "psm_id"), ["psm_id"], "l_discount")


@query("integrity_distinct", "SELECT (SELECT count(DISTINCT peptide) FROM psm) AS psm_peptides, (SELECT count(DISTINCT peptide) FROM own) AS fragment_peptides, (SELECT count(DISTINCT psm_id) FROM frag) AS fragment_psms", PSM, FRAG, OWN)
def _(spark, d):
    return A.distinct_counts(psm_peptides=(psm(spark, d), "peptide"), fragment_peptides=(own(spark, d), "peptide"), fragment_psms=(frag(spark, d), "psm_id"))


@query("groupby_multi_agg", 'SELECT event_type, max(value) AS "max", round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, round(sum(value), 4) + 0.0 AS "sum", count(*) AS n FROM events GROUP BY 1')
def _(spark, d):
    out = A.multi_agg(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({"mean": r(F.col("mean")), "std": r(F.col("std")), "sum": r(F.col("sum"), 4)})


# --- fragment intensity


@query("best_peak_per_fragment", "SELECT psm_id, fragment_name, max(fragment_intensity) AS fragment_intensity FROM frag GROUP BY ALL", FRAG)
def _(spark, d):
    return M.best_peaks(frag(spark, d), [])


PRED = """
pred AS (SELECT peptide, charge, fragment_name, round(avg(predicted), 6) AS predicted FROM own WHERE fragment_name LIKE 'A%' OR fragment_name LIKE 'N%' GROUP BY ALL)"""
NORM = """
norm AS (SELECT peptide, charge, fragment_name, coalesce(predicted / nullif(max(predicted) OVER (PARTITION BY peptide, charge), 0), 0) AS p FROM pred)"""
LONG = """
seen AS (SELECT peptide, charge, psm_id, fragment_name, max(fragment_intensity) AS i FROM own GROUP BY ALL),
names AS (SELECT n.*, coalesce(p, 0) AS p FROM (SELECT peptide, charge, fragment_name FROM seen UNION SELECT peptide, charge, fragment_name FROM norm) n
  LEFT JOIN norm USING (peptide, charge, fragment_name) WHERE (peptide, charge) IN (SELECT (peptide, charge) FROM norm)),
long AS (SELECT peptide, charge, psm_id, fragment_name, coalesce(coalesce(i, 0) / nullif(max(coalesce(i, 0)) OVER (PARTITION BY peptide, charge, psm_id), 0), 0) AS x, p,
  max((i IS NOT NULL)::INT) OVER (PARTITION BY peptide, charge, fragment_name) AS observed
  FROM (SELECT DISTINCT peptide, charge, psm_id FROM seen) JOIN names USING (peptide, charge) LEFT JOIN seen USING (peptide, charge, psm_id, fragment_name))"""


def predictions(spark, d):
    f = own(spark, d).where(F.col("fragment_name").like("A%") | F.col("fragment_name").like("N%"))
    return f.groupBy("peptide", "charge", "fragment_name").agg(F.round(F.avg("predicted"), 6).alias("predicted"))


def with_rt_max(spark, d):
    """Fragments with rt_max_peptide_sub, the rt of their peptide's most intense fragment."""
    f = own(spark, d).select("psm_id", "fragment_name", "fragment_intensity", "predicted", "peptide", "charge", "rt")
    tops = A.max_fragment_per_peptide(A.max_fragment_per_psm(f)).select("peptide", F.col("rt").alias("rt_max_peptide_sub"))
    return f.drop("predicted").join(tops, "peptide", "left")


def matrices(spark, d):
    return M.matrices(own(spark, d).drop("predicted", "rt"), predictions(spark, d))


@query("pred_normalise", "SELECT peptide, charge, fragment_name, round(p, 6) + 0.0 AS predicted FROM norm", PSM, FRAG, OWN, PRED, NORM)
def _(spark, d):
    return M.normalised_predictions(predictions(spark, d)).withColumn("predicted", r(F.col("predicted")))


@query("cosine_similarity", "SELECT psm_id, round(coalesce(sum(fragment_intensity * predicted) / nullif(sqrt(sum(fragment_intensity * fragment_intensity) * sum(predicted * predicted)), 0), 0), 6) + 0.0 AS cosine FROM frag GROUP BY 1", FRAG)
def _(spark, d):
    return frag(spark, d).groupBy("psm_id").agg(r(X.cosine(F.col("fragment_intensity"), F.col("predicted"))).alias("cosine"))


def corr_sql(x: str, y: str, other: str) -> str:
    guard = " AND ".join(f"stddev_pop({v}) > 1e-9 * (1 + abs(avg({v})))" for v in (x, y))
    return f"CASE WHEN {guard} THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE {other} END"


@query("psm_pred_corr", f"SELECT peptide, charge, psm_id, round({corr_sql('x', 'p', '0.0')}, 6) + 0.0 AS correlation, count(*) FILTER (x <> 0) AS n_observed FROM long GROUP BY ALL", PSM, FRAG, OWN, PRED, NORM, LONG)
def _(spark, d):
    return M.psm_scores(matrices(spark, d)).withColumn("correlation", r(F.col("correlation")))


@query(
    "l1_pred_error",
    f""", s AS (SELECT peptide, charge, sum(abs(x - p)) AS dev, count(DISTINCT psm_id) AS n, sum(CASE WHEN observed = 0 THEN p ELSE 0 END) AS unseen, sum(CASE WHEN observed = 1 THEN p ELSE 0 END) AS seen FROM long GROUP BY ALL)
SELECT peptide, charge, round(dev / n, 6) + 0.0 AS l1, round((dev + unseen / n) / n, 6) + 0.0 AS l1_total, round(seen / n * {NUDGE}, 6) + 0.0 AS sum_predicted FROM s""",
    PSM, FRAG, OWN, PRED, NORM, LONG,
)
def _(spark, d):
    return M.deviation(matrices(spark, d)).select("peptide", "charge", *(r(F.col(c)).alias(c) for c in ("l1", "l1_total")), r(F.col("sum_predicted") * NUDGE).alias("sum_predicted"))


@query(
    "apex_scores",
    f"""SELECT peptide, charge, round({corr_sql('coalesce(p, 0)', 'fragment_intensity', '0.0')}, 6) + 0.0 AS apex_correlation,
round(coalesce(sum(coalesce(p, 0) * fragment_intensity) / nullif(sqrt(sum(coalesce(p, 0) * coalesce(p, 0)) * sum(fragment_intensity * fragment_intensity)), 0), 0), 6) + 0.0 AS apex_cosine
FROM own JOIN apex USING (peptide) LEFT JOIN norm USING (peptide, charge, fragment_name)
WHERE rt = rt_max AND (peptide, charge) IN (SELECT (peptide, charge) FROM norm) GROUP BY ALL""",
    PSM, FRAG, OWN, APEX, PRED, NORM,
)
def _(spark, d):
    out = M.apex_scores(M.matrices(with_rt_max(spark, d), predictions(spark, d)))
    return out.withColumns({c: r(F.col(c)) for c in ("apex_correlation", "apex_cosine")})


def pairs_sql(entity: str, axis: str, keep: str) -> str:
    return f"""SELECT a.grp, a.{entity} AS a, b.{entity} AS b, round({corr_sql('a.x', 'b.x', 'NULL')}, 6) + 0.0 AS correlation, count(*) AS n
FROM vec a JOIN vec b ON a.grp = b.grp AND a.{axis} = b.{axis} AND a.{entity} < b.{entity} WHERE {keep} GROUP BY ALL"""


def pairs(spark, d, entity, axis, keep):
    return M.pair_correlations(vec(spark, d), entity, axis, ["grp"], keep).withColumn("correlation", r(F.col("correlation")))


@query("psm_corr_matrix", pairs_sql("vec_id", "dim", "true"), VEC)
def _(spark, d):
    return pairs(spark, d, "vec_id", "dim", "all")


@query("frag_corr_matrix", pairs_sql("dim", "vec_id", "true"), VEC)
def _(spark, d):
    return pairs(spark, d, "dim", "vec_id", "all")


@query("corr_ignore_zeros", pairs_sql("vec_id", "dim", "a.x <> 0 AND b.x <> 0"), VEC)
def _(spark, d):
    return pairs(spark, d, "vec_id", "dim", "both")


@query("corr_ignore_both_missing", pairs_sql("vec_id", "dim", "a.x <> 0 OR b.x <> 0"), VEC)
def _(spark, d):
    return pairs(spark, d, "vec_id", "dim", "any")


@query(
    "corr_pvalue",
    f""", c AS (SELECT peptide, {corr_sql('rt', 'spectrum_q', 'NULL')} AS r, count(*) AS n FROM psm GROUP BY 1),
t AS (SELECT peptide, r, n, n - 2 AS f, 1 - r * r AS k FROM c),
-- the distribution of t with whole degrees of freedom is a finite sum of powers of 1 - r^2
u AS (SELECT *, list_transform(range(0, CASE WHEN f % 2 = 0 THEN f // 2 ELSE (f - 1) // 2 END), lambda i: k ** i * list_product(list_transform(range(1, i + 1), lambda j: CASE WHEN f % 2 = 0 THEN (2 * j - 1) / (2 * j) ELSE 2 * j / (2 * j + 1) END)::DOUBLE[] || [1.0::DOUBLE])) AS terms FROM t WHERE n > 2)
SELECT peptide, round(r, 6) + 0.0 AS r, n, round(CASE WHEN n <= 2 OR r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0
  WHEN f % 2 = 0 THEN 1 - abs(r) * list_sum(terms) ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(k) * coalesce(list_sum(terms), 0)) END, 6) + 0.0 AS p FROM t LEFT JOIN (SELECT peptide, terms FROM u) USING (peptide)""",
    PSM,
)
def _(spark, d):
    p = psm(spark, d).groupBy("peptide").agg(X.safe_corr(F.col("rt"), F.col("spectrum_q"), None).alias("r"), F.count(F.lit(1)).alias("n"))
    return p.select("peptide", r(F.col("r")).alias("r"), "n", r(X.corr_pvalue(F.col("r"), F.col("n"))).alias("p"))


# --- distribution and top-k features

QS = (0, 25, 50, 75, 100)


def scores(spark, d):
    return psm(spark, d).groupBy("peptide").agg(F.collect_list("hyperscore").alias("v"), F.sort_array(F.collect_list(F.struct("psm_id", "hyperscore"))).alias("s"))


@query("percentile_features", "SELECT peptide, " + ", ".join(f"round(quantile_cont(hyperscore, {q / 100}), 9) + 0.0 AS p{q}" for q in QS) + " FROM psm GROUP BY 1", PSM)
def _(spark, d):
    return scores(spark, d).select("peptide", X.percentiles(F.col("v"), QS).alias("p")).select("peptide", *(r(F.get("p", F.lit(i)), 9).alias(f"p{q}") for i, q in enumerate(QS)))


@query(
    "percentile_idx_features",
    ", s AS (SELECT peptide, list_sort(list((hyperscore, psm_id))) AS v FROM psm GROUP BY 1) SELECT peptide, "
    + ", ".join(f"v[1 + floor((len(v) - 1) * {q / 100})::INT][2]::DOUBLE AS i{q}" for q in QS)
    + " FROM s",
    PSM,
)
def _(spark, d):
    both = X.percentiles_with_index(F.transform("s", lambda x: x["hyperscore"]), F.transform("s", lambda x: x["psm_id"]), QS)
    return scores(spark, d).select("peptide", both.alias("p")).select("peptide", *(F.get("p", F.lit(i))["index"].alias(f"i{q}") for i, q in enumerate(QS)))


@query("topk_features", ", s AS (SELECT peptide, list_sort(list(hyperscore), 'DESC') AS v FROM psm GROUP BY 1) SELECT peptide, " + ", ".join(f"coalesce(v[{i}], 0.0) AS top{i}" for i in range(1, 6)) + " FROM s", PSM)
def _(spark, d):
    return scores(spark, d).select("peptide", X.top_values(F.col("v"), 5).alias("t")).select("peptide", *(F.get("t", F.lit(i)).alias(f"top{i + 1}") for i in range(5)))


TEN = range(1, 11)


def corr_columns() -> list[str]:
    """SQL of the 53 columns, from the lists and quantiles of the CTEs below."""
    out = []
    for t, n in (("ps", "matrix_psm_ids"), ("fs", "matrix_frag_ids"), ("ss", "individual")):
        out += [f"round(coalesce({t}.q[{k + 1}], 0), 6) + 0.0 AS distribution_correlation_{n}_{q}" for k, q in enumerate(QS)]
        out += [f"round(coalesce({t}.v[{i}], 0), 6) + 0.0 AS top_correlation_{n}_{i}" for i in TEN]
    out += [f"ss.w[1 + floor((len(ss.w) - 1) * {q / 100})::INT][2]::DOUBLE AS distribution_correlation_individual_{q}_index" for q in QS]
    return [*out, "round(coalesce(ap.c, 0), 6) + 0.0 AS top_correlation_cos_1", "round(l1, 6) + 0.0 AS mse_avg_pred_intens_1", "round(l1_total, 6) + 0.0 AS mse_avg_pred_intens_total_1"]


QUANTS = "[" + ", ".join(str(q / 100) for q in QS) + "]"
#: Correlations are rounded before they are put in order, so that both sides tie alike.
CORR = f"""
sc AS (SELECT peptide, charge, psm_id, {corr_sql('x', 'p', '0.0')} AS c, count(*) FILTER (x <> 0) AS n FROM long GROUP BY ALL),
pp AS (SELECT a.peptide, a.charge, {corr_sql('a.x', 'b.x', 'NULL')} AS c FROM long a JOIN long b ON a.peptide = b.peptide AND a.charge = b.charge AND a.fragment_name = b.fragment_name AND a.psm_id <> b.psm_id GROUP BY a.peptide, a.charge, a.psm_id, b.psm_id),
fp AS (SELECT a.peptide, a.charge, {corr_sql('a.x', 'b.x', 'NULL')} AS c FROM long a JOIN long b ON a.peptide = b.peptide AND a.charge = b.charge AND a.psm_id = b.psm_id AND a.fragment_name <> b.fragment_name
  WHERE a.observed = 1 AND b.observed = 1 GROUP BY a.peptide, a.charge, a.fragment_name, b.fragment_name),
ps AS (SELECT peptide, charge, list_sort(list(c * c) FILTER (c IS NOT NULL), 'DESC') AS v, quantile_cont(c * c, {QUANTS}) AS q FROM pp GROUP BY ALL),
fs AS (SELECT peptide, charge, list_sort(list(c * c) FILTER (c IS NOT NULL), 'DESC') AS v, quantile_cont(c * c, {QUANTS}) AS q FROM fp GROUP BY ALL),
ss AS (SELECT peptide, charge, list_sort(list(c), 'DESC') AS v, quantile_cont(round(c, 9), {QUANTS}) AS q, list_sort(list((round(c, 9), n))) AS w FROM sc GROUP BY ALL),
un AS (SELECT peptide, charge, sum(p) AS unseen FROM (SELECT DISTINCT peptide, charge, fragment_name, p FROM long WHERE observed = 0) GROUP BY ALL),
dv AS (SELECT peptide, charge, sum(abs(x - p)) / count(DISTINCT psm_id) AS l1, (sum(abs(x - p)) + coalesce(any_value(unseen), 0)) / count(DISTINCT psm_id) AS l1_total FROM long LEFT JOIN un USING (peptide, charge) GROUP BY ALL),
ap AS (SELECT peptide, charge, {corr_sql('coalesce(p, 0)', 'fragment_intensity', '0.0')} AS c FROM own JOIN apex USING (peptide) LEFT JOIN norm USING (peptide, charge, fragment_name)
  WHERE rt = rt_max AND (peptide, charge) IN (SELECT (peptide, charge) FROM norm) GROUP BY ALL),
cf AS (SELECT peptide, charge, {", ".join(corr_columns())}
  FROM dv JOIN ss USING (peptide, charge) LEFT JOIN ps USING (peptide, charge) LEFT JOIN fs USING (peptide, charge) LEFT JOIN ap USING (peptide, charge))"""


def corr_rows(spark, d):
    out = M.correlation_row(M.matrices(with_rt_max(spark, d), predictions(spark, d)))
    return out.select("peptide", "charge", *(r(F.col(n)).alias(n) for n in out.columns[2:]))


@query("correlation_feature_row", "SELECT * FROM cf", PSM, FRAG, OWN, APEX, PRED, NORM, LONG, CORR)
def _(spark, d):
    return corr_rows(spark, d)


def wide_psms(spark, d):
    """PSMs with every column that is collapsed, filled from the PSM's own numbers."""
    p = psm(spark, d)
    have = {c: F.col("hyperscore") * (i + 1) for i, c in enumerate(sorted({*P.MAX_COLUMNS, *P.MIN_COLUMNS} - set(p.columns)))}
    first = {"num_proteins": F.lit(1), "proteins": F.col("peptide"), "expmass": F.col("calcmass"), "peptide_len": F.length("peptide"), "missed_cleavages": F.lit(0)}
    return p.withColumns({**have, **first})


def wide_sql() -> str:
    have = sorted({*P.MAX_COLUMNS, *P.MIN_COLUMNS} - {"spectrum_q", "rt", "hyperscore"})
    return ", ".join(f'hyperscore * {i + 1} AS "{c}"' for i, c in enumerate(have))


def row_sql() -> str:
    kinds = (("max", P.MAX_COLUMNS, "max"), ("min", P.MIN_COLUMNS, "min"), ("mean", P.MEAN_COLUMNS, "avg"), ("sum", P.SUM_COLUMNS, "sum"))
    return ", ".join(f'round({f}("{c}") * {NUDGE}, 5) + 0.0 AS "{c}_{n}"' for n, cs, f in kinds for c in cs)


WIDE = f"""
wp AS (SELECT *, {wide_sql()}, 1 AS num_proteins, peptide AS proteins, calcmass AS expmass, length(peptide) AS peptide_len, 0 AS missed_cleavages FROM psm),
f1 AS (SELECT DISTINCT ON (peptide, charge) peptide, charge, psm_id, filename, scannr, num_proteins, proteins, expmass, calcmass, CASE WHEN is_decoy THEN -1 ELSE 1 END AS is_decoy, peptide_len, missed_cleavages,
  psm_id || '|' || filename || '|' || scannr AS "SpecId" FROM wp ORDER BY peptide, charge, rt, psm_id),
pr AS (SELECT * FROM f1 JOIN (SELECT peptide, charge, {row_sql()} FROM wp GROUP BY ALL) USING (peptide, charge))"""


def rounded(df: DataFrame) -> DataFrame:
    """Collapsed columns rounded as the SQL has them."""
    return df.select(*((r(F.col(f"`{c}`") * NUDGE, 5) if c.endswith(("_max", "_min", "_mean", "_sum")) else F.col(f"`{c}`")).alias(c) for c in df.columns))


@query("peptidoform_feature_row", "SELECT * FROM pr", PSM, WIDE)
def _(spark, d):
    return rounded(P.peptidoform_row(wide_psms(spark, d)))


@query(
    "feature_table",
    "SELECT "
    + ", ".join(f'"{c}" AS "{P.PIN_NAMES[c]}"' for c in P.PIN_NAMES)
    + " , pr.* EXCLUDE (scannr, "
    + ", ".join(P.PIN_NAMES)
    + "), cf.* EXCLUDE (peptide, charge) FROM pr JOIN cf USING (peptide, charge)",
    PSM, FRAG, OWN, APEX, PRED, NORM, LONG, CORR, WIDE,
)
def _(spark, d):
    return rounded(P.pin_table(wide_psms(spark, d), corr_rows(spark, d)))


# --- windows and order


@query(
    "ms1_carry_forward",
    """, c AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM e)
SELECT user_id AS file, event_id AS scan_id, m AS ms1_scan_id FROM c WHERE event_type <> 'error' AND m IS NOT NULL""",
    "\ne AS (SELECT * FROM events)",
)
def _(spark, d):
    level = F.when(F.col("event_type") == "error", 1).otherwise(2)
    s = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("scan_id"), F.col("event_id").alias("scan_index"), level.alias("ms_level"))
    return J.ms1_of_ms2(s).select("file", "scan_id", "ms1_scan_id")


@query("peak_identifier", "SELECT l_orderkey, l_linenumber, l_extendedprice, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS peak_identifier FROM lineitem")
def _(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return A.dense_ranks(f, ["l_orderkey"], F.col("l_extendedprice"), "peak_identifier").withColumn("peak_identifier", F.col("peak_identifier").cast("long"))


@query(
    "psm_id_offset",
    """, m AS (SELECT filename, max(psm_id) + 1 AS s FROM psm GROUP BY 1), o AS (SELECT filename, coalesce(sum(s) OVER (ORDER BY filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM m)
SELECT filename, peptide, rt, psm_id + o AS psm_id FROM psm JOIN o USING (filename)""",
    PSM,
)
def _(spark, d):
    return J.running_offset(psm(spark, d), "filename").select("filename", "peptide", "rt", "psm_id")


@query("rank_feature", "SELECT psm_id, row_number() OVER (PARTITION BY charge ORDER BY hyperscore, psm_id) - 1 AS rank FROM psm", PSM)
def _(spark, d):
    return A.ranks(psm(spark, d), ["charge"], "hyperscore", "psm_id").select("psm_id", "rank")


# --- sets and counts


@query("peptide_intersect", "SELECT peptide FROM psm WHERE charge = 2 INTERSECT SELECT peptide FROM psm WHERE charge = 4", PSM)
def _(spark, d):
    p = psm(spark, d)
    return L.common(p.where("charge = 2"), p.where("charge = 4"), "peptide")


@query("peptide_except", "SELECT peptide FROM psm WHERE charge = 2 EXCEPT SELECT peptide FROM psm WHERE charge = 4", PSM)
def _(spark, d):
    p = psm(spark, d)
    return L.only_first(p.where("charge = 2"), p.where("charge = 4"), "peptide")


@query("union_partitions", "SELECT psm_id, peptide, NULL::DOUBLE AS rt FROM psm WHERE charge = 2 UNION ALL SELECT psm_id, peptide, rt FROM psm WHERE charge <> 2", PSM)
def _(spark, d):
    p = psm(spark, d).select("psm_id", "peptide", "rt", "charge")
    return L.concat(p.where("charge = 2").drop("rt"), p.where("charge <> 2")).select("psm_id", "peptide", "rt")


@query("qvalue_threshold_counts", "SELECT t AS threshold, (SELECT count(*) FROM psm WHERE spectrum_q <= t) AS n FROM (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25])::DOUBLE AS t)", PSM)
def _(spark, d):
    return L.threshold_counts(psm(spark, d), "spectrum_q")


@query("feature_histogram", "SELECT is_decoy, floor(hyperscore / 5)::BIGINT AS bin, count(*) AS n FROM psm GROUP BY ALL", PSM)
def _(spark, d):
    return L.histogram(psm(spark, d), "hyperscore", 5.0, "is_decoy")


# --- scalar functions


@query(
    "replace_mass_shift",
    """SELECT p_partkey, 'PEP' || CASE p_size % 4 WHEN 0 THEN '[Oxidation]' WHEN 1 THEN '[Acetyl]' WHEN 2 THEN '[Thiazolidine]' ELSE '[+1.5]' END || 'TIDE[Phospho]' AS peptide FROM part""",
)
def _(spark, d):
    shift = F.element_at(F.array(*map(F.lit, ("[+15.9949]", "[+42.010567]", "[+12.000]", "[+1.5]"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.replace_mass_shift(F.concat(F.lit("PEP"), shift, F.lit("TIDE[+79.96633]"))).alias("peptide"))


@query("fragment_name", "SELECT l_orderkey, l_linenumber, lower(l_returnflag) || l_linenumber || '/' || (l_quantity % 3 + 1)::INT AS name, lower(l_returnflag) AS kind, l_linenumber AS ordinal, (l_quantity % 3 + 1)::INT AS charge FROM lineitem")
def _(spark, d):
    name = X.fragment_name(F.lower("l_returnflag"), F.col("l_linenumber"), (F.col("l_quantity") % 3 + 1).cast("int"))
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))
    return out.select("*", X.split_ion(F.col("name")).alias("s")).select("l_orderkey", "l_linenumber", "name", "s.kind", "s.ordinal", "s.charge")


@query("strip_modifications", "SELECT p_partkey, p_name || 'TIDE' AS bare, p_name AS base FROM part WHERE p_name NOT LIKE '%[%'")
def _(spark, d):
    modified = F.concat("p_name", F.lit("[Acetyl]TI[+1.5]DE"))
    return table(spark, d, "part").where(~F.col("p_name").contains("[")).select("p_partkey", X.strip_modifications(modified).alias("bare"), X.base_sequence(modified).alias("base"))


@query("string_locate", "SELECT p_partkey, instr(p_name, 'e') - 1 AS at, length(p_name) BETWEEN 5 AND 50 AS fits, reverse(p_name) AS backwards FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.find(F.col("p_name"), "e").cast("long").alias("at"), F.length("p_name").between(5, 50).alias("fits"), F.reverse("p_name").alias("backwards"))


@query(
    "delog_predictions",
    """SELECT vec_id, kind || (i + 1) || '/1' AS fragment_name, round(pow(2, e), 6) + 0.0 AS predicted FROM
(SELECT vec_id, 'b' AS kind, unnest(range(32)) AS i, unnest(embedding[1:32])::DOUBLE AS e FROM embeddings UNION ALL SELECT vec_id, 'y', unnest(range(32)), unnest(embedding[33:64])::DOUBLE FROM embeddings)""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).cast("array<double>").alias("b"), F.slice("embedding", 33, 32).cast("array<double>").alias("y"))
    return S.delogged(v, ["vec_id"]).withColumn("predicted", r(F.col("predicted")))


@query("precursor_mz", "SELECT psm_id, round(calcmass / charge + 1.007276466812::DOUBLE, 6) + 0.0 AS mz, round(calcmass * 20.0::DOUBLE * 1e-6, 8) + 0.0 AS tolerance, round(calcmass + 1.0033548378::DOUBLE / charge, 6) + 0.0 AS next_isotope FROM psm", PSM)
def _(spark, d):
    m, z = F.col("calcmass"), F.col("charge")
    return psm(spark, d).select("psm_id", r(X.precursor_mz(m, z)).alias("mz"), r(X.ppm_tolerance(m), 8).alias("tolerance"), r(X.isotope_mz(m, z, 1)).alias("next_isotope"))


@query("ppm_error", "SELECT psm_id, round((rt - rt_predictions) / rt_predictions * 1e6, 4) + 0.0 AS ppm FROM psm JOIN rtp USING (peptide)", PSM, RTP)
def _(spark, d):
    return psm(spark, d).join(rtp(spark, d), "peptide").select("psm_id", r(X.ppm_error(F.col("rt"), F.col("rt_predictions")), 4).alias("ppm"))


@query("safe_divide", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) + 0.0 AS ratio FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(X.safe_divide(F.col("l_tax"), F.col("l_discount"))).alias("ratio"))


# --- statistics


@query("iqr_outliers", ", q AS (SELECT charge, quantile_cont(hyperscore, 0.25) AS a, quantile_cont(hyperscore, 0.75) AS b FROM psm GROUP BY 1) SELECT psm_id, charge FROM psm JOIN q USING (charge) WHERE hyperscore < a - (b - a) * 0.5 OR hyperscore > b + (b - a) * 0.5", PSM)
def _(spark, d):
    return A.iqr_outliers(psm(spark, d), ["charge"], "hyperscore", 0.5).select("psm_id", "charge")


@query("zscore_outliers", ", s AS (SELECT charge, avg(hyperscore) AS m, stddev_pop(hyperscore) AS v FROM psm GROUP BY 1) SELECT psm_id, charge FROM psm JOIN s USING (charge) WHERE abs(hyperscore - m) > 1.5 * v", PSM)
def _(spark, d):
    return A.zscore_outliers(psm(spark, d), ["charge"], "hyperscore", 1.5).select("psm_id", "charge")


@query(
    "rt_linear_fit",
    """, j AS (SELECT rt, rt_predictions AS p FROM psm JOIN rtp USING (peptide)), f AS (SELECT regr_slope(rt, p) AS s, regr_intercept(rt, p) AS i FROM j)
SELECT round(any_value(s), 6) + 0.0 AS slope, round(any_value(i), 4) + 0.0 AS intercept, round(sqrt(avg(pow(rt - (s * p + i), 2))), 4) + 0.0 AS rmse FROM j, f""",
    PSM, RTP,
)
def _(spark, d):
    out = A.linear_fit(psm(spark, d).join(rtp(spark, d), "peptide"), "rt", "rt_predictions")
    return out.select(r(F.col("slope")).alias("slope"), r(F.col("intercept"), 4).alias("intercept"), r(F.col("rmse"), 4).alias("rmse"))


@query("log_corr", f"SELECT charge, round({corr_sql('ln(rt)', 'ln(calcmass)', '0.0')}, 6) + 0.0 AS correlation FROM psm GROUP BY 1", PSM)
def _(spark, d):
    return psm(spark, d).groupBy("charge").agg(r(X.safe_corr(F.ln("rt"), F.ln("calcmass"))).alias("correlation"))


@query(
    "spearman",
    f""", k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM li)
SELECT l_returnflag, round({corr_sql('a', 'b', '0.0')}, 6) + 0.0 AS rho FROM k GROUP BY 1""",
    "\nli AS (SELECT * FROM lineitem)",
)
def _(spark, d):
    f = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    f = A.average_ranks(A.average_ranks(f, ["l_returnflag"], "l_quantity", "a"), ["l_returnflag"], "l_extendedprice", "b")
    return f.groupBy("l_returnflag").agg(r(X.safe_corr(F.col("a"), F.col("b"))).alias("rho"))


@query("relative_intensity_filter", ", s AS (SELECT psm_id, fragment_name, fragment_intensity / max(fragment_intensity) OVER (PARTITION BY psm_id) AS v FROM frag) SELECT psm_id, fragment_name, round(v, 6) + 0.0 AS relative_intensity FROM s WHERE v > 0.5", FRAG)
def _(spark, d):
    return A.relative_intensity(frag(spark, d), ["psm_id"], "fragment_intensity", 0.5).select("psm_id", "fragment_name", r(F.col("relative_intensity")).alias("relative_intensity"))


RES = "\nres AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in X.RESIDUES.items()) + ") t(residue, mass))"


@query(
    "mass_difference_match",
    """, p AS (SELECT DISTINCT l_orderkey, 100 + l_extendedprice / 100 AS mz FROM lineitem)
SELECT a.l_orderkey, a.mz AS low, b.mz AS high, arg_min(residue, (abs(b.mz - a.mz - mass), residue)) AS residue, round(min(abs(b.mz - a.mz - mass)), 6) + 0.0 AS delta
FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.mz > a.mz JOIN res ON abs(b.mz - a.mz - mass) < 0.5 GROUP BY a.l_orderkey, a.mz, b.mz""",
    RES,
)
def _(spark, d):
    peaks = table(spark, d, "lineitem").select("l_orderkey", (F.lit(100) + F.col("l_extendedprice") / 100).alias("mz")).distinct()
    return S.mass_differences(peaks, ["l_orderkey"]).withColumn("delta", r(F.col("delta")))


# --- digestion


def proteins(spark, d):
    """Sequences from the letters of part names."""
    return table(spark, d, "part").select(F.concat(F.lit("sp"), F.col("p_partkey").cast("string"), F.lit(" part")).alias("identifier"), F.upper(F.replace(F.concat("p_name", "p_type"), F.lit(" "), F.lit("K"))).alias("sequence"))


PROT = """
prot AS (SELECT 'sp' || p_partkey AS protein, upper(replace(p_name || p_type, ' ', 'K')) AS sequence FROM part)"""


@query("decoy_union", "SELECT protein, sequence FROM prot UNION ALL SELECT 'rev_' || protein, reverse(sequence) FROM prot", PROT)
def _(spark, d):
    return D.with_decoys(proteins(spark, d))


@query(
    "tryptic_digest",
    """, s AS (SELECT protein, sequence FROM prot UNION ALL SELECT 'rev_' || protein, reverse(sequence) FROM prot),
c AS (SELECT protein, sequence, list_concat([0], list_filter(range(1, length(sequence)), lambda i: sequence[i] IN ('K', 'R') AND sequence[i + 1] <> 'P'), [length(sequence)]) AS cut FROM s),
p AS (SELECT protein, sequence, cut, unnest(range(1, len(cut))) AS i FROM c),
m AS (SELECT protein, sequence, cut[i] AS a, unnest(cut[i + 1 : i + 3]) AS b FROM p)
SELECT protein, a AS start, b AS "end", protein || '|' || a || '|' || b AS id, sequence[a + 1 : b] AS peptide FROM m WHERE b - a BETWEEN 5 AND 50 AND sequence[a + 1 : b] NOT LIKE '%X%'""",
    PROT,
)
def _(spark, d):
    return D.digest(D.with_decoys(proteins(spark, d))).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


# --- precursors


def spectra(spark, d):
    """A file per user, scans in event order, MS1 scans with the peaks of a vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.transform("embedding", lambda x, i: F.lit(100.0) + i.cast("double") * F.lit(0.5)).alias("mz"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("intensity"))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("string").alias("scan_id"), F.col("event_id").alias("scan_index"), F.when(F.col("event_type") == "error", 1).otherwise(2).alias("ms_level"), "event_id")
    n = v.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    e = e.crossJoin(F.broadcast(n)).withColumn("k", F.col("event_id") % F.col("n"))  # a table of one row
    return e.join(v, e["k"] == v["v"]).select("file", "scan_id", "scan_index", "ms_level", "mz", "intensity")


SPECTRA = """
sp AS (SELECT user_id, event_id, event_type, embedding[1:64] AS e FROM events JOIN embeddings ON event_id % (SELECT count(*) FROM embeddings) = vec_id)"""


def peak_sql(target: str) -> str:
    return f"coalesce((SELECT max(abs(e[j + 1]::DOUBLE)) FROM (SELECT unnest(range(64)) AS j) WHERE 100 + j * 0.5::DOUBLE BETWEEN {target} - {target} * 5000.0::DOUBLE * 1e-6 AND {target} + {target} * 5000.0::DOUBLE * 1e-6), 0.0)"


@query("isotope_peaks", "SELECT event_id::VARCHAR AS scan_id, " + ", ".join(f"round({peak_sql(f'(115 + {s} * (1.0033548378::DOUBLE / 2))')}, 6) + 0.0 AS {n}" for s, n in ((-1, "below"), (0, "main"), (1, "above"))) + " FROM sp WHERE event_type = 'error'", SPECTRA)
def _(spark, d):
    p = X.isotope_peaks(F.col("mz"), F.col("intensity"), F.lit(115.0), F.lit(2), 5000.0)
    return spectra(spark, d).where("ms_level = 1").select("scan_id", *(r(p[k]).alias(n) for k, n in (("M-1", "below"), ("M", "main"), ("M+1", "above"))))


def precursor_sql() -> str:
    mz = "(mass / charge + 1.007276466812::DOUBLE)"
    out = []
    for name, step in (("M-1", -1), ("M", 0), ("M+1", 1)):
        t = f"({mz} + {step} * 1.0033548378::DOUBLE / charge)"
        out.append(f'coalesce(max(v) FILTER (m BETWEEN {t} - {t} * 5000.0::DOUBLE * 1e-6 AND {t} + {t} * 5000.0::DOUBLE * 1e-6), 0.0) AS "precursor_intensity_{name}"')
    return ", ".join(out)


@query(
    "precursor_intensity",
    f""", c AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM sp),
l AS (SELECT c.user_id % 3 AS file, c.event_id // 3 AS scan, max(c.m) AS ms1 FROM c WHERE event_type <> 'error' AND m IS NOT NULL AND user_id < 3 GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT psm_id, charge, psm_id % 3 AS file, psm_id // 3 AS scan, 100 * charge + rt / 20 AS mass FROM psm),
w AS (SELECT q.psm_id, q.mass, q.charge, 100 + j * 0.5::DOUBLE AS m, round(abs(e[j + 1]::DOUBLE), 6) AS v FROM q JOIN l USING (file, scan) JOIN sp ON sp.event_id = l.ms1, (SELECT unnest(range(64)) AS j))
SELECT q.psm_id, x.* EXCLUDE (psm_id) REPLACE ({", ".join(f'round(coalesce("precursor_intensity_{n}", 0), 6) + 0.0 AS "precursor_intensity_{n}"' for n in ("M-1", "M", "M+1"))})
FROM q LEFT JOIN (SELECT psm_id, {precursor_sql()} FROM w GROUP BY psm_id, mass, charge) x USING (psm_id)""",
    PSM, SPECTRA,
)
def _(spark, d):
    """Scan ids repeat: the events of three users are three files, and a PSM's file is its id modulo 3."""
    s = spectra(spark, d).where("file in ('0', '1', '2')")
    # only MS2 scans whose number is theirs alone in the file, as events are numbered over all users
    number = F.floor(F.col("scan_index") / 3).cast("string")
    twice = s.where("ms_level = 2").groupBy("file", number.alias("n")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    named = s.withColumn("n", F.when(F.col("ms_level") == 2, number).otherwise(F.concat(F.lit("ms1-"), F.col("scan_id"))))
    named = named.join(twice.drop("c"), ["file", "n"], "left_anti").withColumn("scan_id", F.col("n")).withColumn("file", F.concat(F.lit("file:/run/"), F.col("file")))
    id_ = F.col("psm_id")
    p = psm(spark, d).select("psm_id", "charge", (id_ % 3).cast("string").alias("filename"), F.floor(id_ / 3).cast("string").alias("scannr"), (F.lit(100) * F.col("charge") + F.col("rt") / 20).alias("calcmass"))
    out = I.precursor_intensities(p, named, 5000.0)
    return out.select("psm_id", *(r(F.col(f"`precursor_intensity_{n}`")).alias(f"precursor_intensity_{n}") for n in ("M-1", "M", "M+1")))


# --- retention time


@query(
    "rt_features",
    """, j AS (SELECT psm_id, psm.peptide, rt, rt_predictions, abs(rt - rt_predictions) AS e, (SELECT max(rt) FROM psm) AS m FROM psm LEFT JOIN rtp USING (peptide))
SELECT psm_id, peptide, rt, rt_predictions, round(e, 7) + 0.0 AS rt_prediction_error_abs, round(e / m, 7) + 0.0 AS rt_prediction_error_abs_relative FROM j WHERE e / m < 0.15""",
    PSM, RTP,
)
def _(spark, d):
    out = R.rt_features(psm(spark, d), rtp(spark, d), 0.15)
    return out.select("psm_id", "peptide", "rt", "rt_predictions", *(r(F.col(c), 7).alias(c) for c in ("rt_prediction_error_abs", "rt_prediction_error_abs_relative")))


@query("rt_bounds", "SELECT peptide, round(rt_predictions * 60, 6) + 0.0 AS predictions, round(rt_predictions * 60 - 60, 6) + 0.0 AS predictions_lower, round(rt_predictions * 60 + 60, 6) + 0.0 AS predictions_upper FROM rtp", RTP)
def _(spark, d):
    return R.rt_bounds(rtp(spark, d), 2.0).select("peptide", *(r(F.col(c)).alias(c) for c in ("predictions", "predictions_lower", "predictions_upper")))


@query("training_below_percentile", ", t AS (SELECT DISTINCT ON (peptide) peptide, rt FROM psm WHERE spectrum_q < 0.1 ORDER BY peptide, hyperscore DESC, psm_id, rt) SELECT peptide, rt FROM t WHERE rt < (SELECT quantile_cont(rt, 0.9) FROM t)", PSM)
def _(spark, d):
    rows = R.training_rows(psm(spark, d).withColumnRenamed("hyperscore", "fragment_intensity"), 0.1)
    return R.below_percentile(rows, "rt", 90).select("peptide", "rt")


@query("rt_prediction")
def _(spark, d):
    p = psm(spark, d).withColumnRenamed("hyperscore", "fragment_intensity").withColumn("peptide", F.translate("peptide", "0123456789", "GASPVTCLNK"))
    _, model, _ = R.retrained(p, q=0.5)
    return R.predict_rt(p, model).select("peptide", r(F.col("rt_predictions"), 4).alias("rt_predictions"))


# --- deconvolution, search, rescoring


@query("lasso_deconvolution")
def _(spark, d):
    f = A.dense_ranks(own(spark, d), ["psm_id"], F.col("fragment_name"), "peak_identifier")
    f = f.select(F.floor(F.col("psm_id") / 30).cast("string").alias("scannr"), "peak_identifier", X.peptidoform(F.col("peptide"), F.col("charge")).alias("peptidoform"), "fragment_name", "fragment_intensity")
    p = M.normalised_predictions(predictions(spark, d)).select(X.peptidoform(F.col("peptide"), F.col("charge")).alias("peptidoform"), "fragment_name", "predicted")
    return S.deconvolved(f, p, 0.001).withColumn("coefficient", r(F.col("coefficient")))


@query(
    "tdc_qvalue",
    """, s AS (SELECT hyperscore AS k, count(*) FILTER (is_decoy) AS dn, count(*) FILTER (NOT is_decoy) AS t FROM psm GROUP BY 1),
f AS (SELECT k, least((sum(dn) OVER w + 1) / greatest(sum(t) OVER w, 1), 1.0) AS f FROM s WINDOW w AS (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT k, min(f) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS q FROM f)
SELECT psm_id, round(q, 6) + 0.0 AS q_value FROM psm JOIN q ON hyperscore = k""",
    PSM,
)
def _(spark, d):
    return Q.tdc_qvalues(psm(spark, d), "hyperscore").select("psm_id", r(F.col("q_value")).alias("q_value"))


@query("rescoring")
def _(spark, d):
    p = psm(spark, d).select("psm_id", F.concat(F.col("psm_id").cast("string"), F.lit("|"), "filename").alias("SpecId"), X.label(F.col("is_decoy")).alias("Label"), "hyperscore", "rt", (F.col("charge") * 1.0).alias("z"))
    return Q.rescored(p, ["hyperscore", "rt", "z"]).select("psm_id", r(F.col("score"), 3).alias("score"), r(F.col("q_value"), 3).alias("q_value"))


def ion_sql(kind: str, losses: dict[str, float]) -> str:
    part = "left(seq, i)" if kind == "b" else "right(seq, i)"
    mass = f"list_sum(list_transform(string_split({part}, ''), lambda x: masses[x]))"
    return " UNION ALL ".join(
        f"SELECT psm_id, peptide, charge, '{kind}' || i || '{loss}/' || z AS fragment_name, ({mass} + {0.0 if kind == 'b' else X.WATER}::DOUBLE - {d}::DOUBLE) / z + {X.PROTON}::DOUBLE AS t FROM len_, m_ WHERE z <= least(2, greatest(charge - 1, 1))"
        for loss, d in losses.items()
    )


@query(
    "fragment_annotation",
    f""", aq AS (SELECT psm_id, charge, translate(peptide, '0123456789', 'GASPVTCLNK') AS peptide FROM psm),
len_ AS (SELECT psm_id, peptide, charge, peptide AS seq, i, z FROM aq, (SELECT unnest(range(1, 20)) AS i), (SELECT unnest([1, 2]) AS z) WHERE i < length(peptide)),
m_ AS (SELECT MAP {{{", ".join(f"'{k}': {v}::DOUBLE" for k, v in X.RESIDUES.items())}}} AS masses),
ions AS ({ion_sql('b', S.LOSSES)} UNION ALL {ion_sql('y', S.LOSSES)}),
pk AS (SELECT event_id AS psm_id, 100 + j * 0.5::DOUBLE AS m, abs(e[j + 1]::DOUBLE) AS v FROM sp, (SELECT unnest(range(64)) AS j))
SELECT ions.psm_id, peptide, charge, fragment_name, round(max(v), 6) + 0.0 AS fragment_intensity FROM ions JOIN pk USING (psm_id) WHERE m BETWEEN t - t * 5000.0::DOUBLE * 1e-6 AND t + t * 5000.0::DOUBLE * 1e-6 GROUP BY ALL""",
    PSM, SPECTRA,
)
def _(spark, d):
    p = psm(spark, d).select("psm_id", F.col("psm_id").cast("string").alias("scannr"), F.translate("peptide", "0123456789", "GASPVTCLNK").alias("peptide"), "charge")
    return S.annotate(p, spectra(spark, d), 5000.0, 2, tuple(S.LOSSES)).withColumn("fragment_intensity", r(F.col("fragment_intensity")))


@query(
    "windowed_search",
    """, m AS (SELECT filename, max(psm_id) + 1 AS s FROM psm GROUP BY 1), o AS (SELECT filename, coalesce(sum(s) OVER (ORDER BY filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM m),
u AS (SELECT peptide, psm_id + o AS psm_id, fragment_name, fragment_intensity FROM frag JOIN psm USING (psm_id) JOIN o USING (filename))
SELECT DISTINCT ON (psm_id) psm_id, peptide, fragment_name, fragment_intensity FROM u ORDER BY psm_id, fragment_intensity DESC, fragment_name""",
    PSM, FRAG,
)
def _(spark, d):
    p = psm(spark, d).withColumnRenamed("filename", "part")
    f = frag(spark, d).join(p.select("psm_id", "part", "peptide"), "psm_id").select("part", "peptide", "psm_id", "fragment_name", "fragment_intensity")
    return E.combined(p.select("part", "psm_id", "peptide"), f)[2].select("psm_id", "peptide", "fragment_name", "fragment_intensity")
