"""Fragment-intensity features per peptidoform, in long form: apex scores, PSM-to-prediction correlations, correlation matrices.

All scores come from one form, `matrices`: a row for each peptidoform with its PSMs' intensities, the
prediction and the apex spectrum as arrays in the order of fragment names. Nothing is pivoted, so
peptidoforms may have any fragments, and what a score does not need is pruned from the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import kernels as K

KEYS = ["peptide", "charge"]


def best_peaks(fragments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The greatest intensity for each PSM and fragment."""
    return fragments.groupBy(*keys, "psm_id", "fragment_name").agg(F.max("fragment_intensity").alias("fragment_intensity"))


def normalised_predictions(predictions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Predictions over their peptidoform's maximum, 0 if that is 0."""
    return predictions.withColumn("predicted", X.safe_divide(F.col("predicted"), F.max("predicted").over(W.partitionBy(*keys))))


#: A key's members are cut into pieces of about so many, and of so many rows; tasks take two pieces at a time.
PIECE_MEMBERS, PIECE_ROWS = 1000, 1_000_000


def pair_correlations(long: DataFrame, entity: str, axis: str, keys: list[str] = KEYS, keep: str = "all", piece_members: int = PIECE_MEMBERS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Correlations of all pairs of an entity (PSMs or fragments) along the other axis: (keys, a, b, correlation, n), a < b.

    keep: "all" positions, "both" where both differ from 0, "any" where one does. Null where fewer than two
    positions are left or one side does not vary. The output has a row for each pair by its nature; for
    peptidoforms with very many members use `corr_features`, which keeps only what features need.

    Entries are shuffled once, by key, and pairs are made from arrays in the task, so no pair of entries is a row. The
    members of a large key are dealt to pieces, and each two pieces are a group of their own: that repeats the entries
    of such keys, but bounds a task's memory and lets many tasks share a key.
    """
    rows = long.select(*keys, F.col(entity).alias("__e"), F.col(axis).alias("__axis"), F.col("x").cast("double").alias("__x")).dropna(subset=[*keys, "__e", "__axis"])
    pieces = F.ceil(F.greatest(F.approx_count_distinct("__e") / piece_members, F.count(F.lit(1)) / piece_rows)).cast("int")
    large = rows.groupBy(*keys).agg(pieces.alias("__pieces")).where("__pieces > 1")  # at most a row for each so many members or rows of the table
    rows = rows.join(F.broadcast(large), keys, "left").withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))
    rows = rows.withColumn("__own", F.pmod(F.xxhash64("__e"), F.col("__pieces")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces")
    rows = rows.withColumns({"__first": F.least("__own", "__other"), "__second": F.greatest("__own", "__other")}).drop("__other")
    fields = {f.name: f for f in rows.schema.fields}
    member = fields["__e"].dataType
    schema = T.StructType([*(fields[k] for k in keys), *(T.StructField(n, t) for n, t in (("a", member), ("b", member), ("correlation", T.DoubleType()), ("n", T.LongType())))])

    def run(table: pa.Table) -> pa.Table:
        members = pc.unique(table["__e"].combine_chunks())
        members = members.take(pc.sort_indices(members))
        e = pc.index_in(table["__e"].combine_chunks(), members).to_numpy()
        t = table["__axis"].combine_chunks().dictionary_encode().indices.to_numpy()
        piece = np.zeros(len(members), dtype=int)
        piece[e] = table["__own"].to_numpy()
        missing = table["__x"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        a, b, r, n = K.pair_correlations(e, t, np.where(missing, 0.0, table["__x"].to_numpy()), missing, piece if table["__first"][0] != table["__second"][0] else None, keep)
        own = [pa.repeat(table[k][0], len(a)).cast(table.schema.field(k).type) for k in keys]
        return pa.table([*own, members.take(pa.array(a)), members.take(pa.array(b)), pa.array(r, mask=n < 0), pa.array(np.abs(n))], names=schema.names)

    return rows.groupBy(*keys, "__first", "__second").applyInArrow(run, schema)


def unit_vector(x: Column) -> Column:
    """An array centred and scaled to length 1, so that the product of two is their correlation; null if it does not vary."""
    n = F.size(x)
    add = lambda s, v: s + v
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), add), n)

    def scaled(m: Column) -> Column:
        centred = F.transform(x, lambda v: v - m)
        length = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v))
        return F.when(length > F.sqrt(n.cast("double")) * 1e-9 * (1 + F.abs(m)), F.transform(centred, lambda v: v / length))

    return F.element_at(F.transform(F.array(mean), scaled), 1)


def matrices(fragments: DataFrame, predictions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per peptidoform: psms (array of struct(psm_id, x)), p, observed and apex (array of struct(q, i)).

    x is the intensity over the PSM's maximum, 0 for fragments that the PSM lacks but another PSM of the
    peptidoform or the prediction has; p is the prediction over its maximum, 0 without one; observed is 1
    where a PSM has the fragment. All are in the order of fragment names. apex has the prediction and the
    intensity of each peak of the PSMs at the apex (rt is rt_max_peptide_sub, as doubles), and is empty if the
    fragments lack these columns. Peptidoforms without any prediction go.

    Both tables are dealt by peptidoform once; all groups that follow lie in place.
    """
    at_apex = F.lit(False)
    if {"rt", "rt_max_peptide_sub"} <= set(fragments.columns):
        at_apex = F.coalesce(F.col("rt").cast("double") == F.col("rt_max_peptide_sub").cast("double"), F.lit(False))
    seen = fragments.select(*keys, "psm_id", "fragment_name", "fragment_intensity", at_apex.alias("a")).repartition(*keys)
    seen = seen.groupBy(*keys, "psm_id", "fragment_name").agg(F.max("fragment_intensity").alias("fragment_intensity"), F.collect_list(F.when(F.col("a"), F.col("fragment_intensity").cast("double"))).alias("peaks"))
    entries = F.sort_array(F.collect_list(F.struct("fragment_name", "fragment_intensity", "peaks")))
    by_psm = seen.groupBy(*keys, "psm_id").agg(entries.alias("f"))
    rows = by_psm.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("psm_id", "f"))).alias("psms"))
    p = predictions.select(*keys, "fragment_name", "predicted").repartition(*keys)
    p = p.groupBy(*keys, "fragment_name").agg(F.max("predicted").alias("predicted")).groupBy(*keys)
    p = p.agg(F.map_from_entries(F.collect_list(F.struct("fragment_name", "predicted"))).alias("__p"))
    out = rows.join(p, keys).withColumn("__seen", F.array_distinct(F.flatten(F.transform("psms", lambda r: F.transform(r["f"], lambda e: e["fragment_name"])))))
    out = out.withColumns({"__names": F.sort_array(F.array_union("__seen", F.map_keys("__p"))), "__top": F.array_max(F.map_values("__p"))})

    def vector(r: Column) -> Column:
        filled = F.transform(F.array(F.map_from_arrays(r["f"]["fragment_name"], r["f"]["fragment_intensity"])), lambda m: F.transform("__names", lambda n: F.coalesce(m[n], F.lit(0.0))))
        return F.element_at(F.transform(filled, lambda v: F.transform(F.array(F.array_max(v)), lambda top: F.transform(v, lambda e: X.safe_divide(e, top)))), 1)[0]

    share = lambda n: X.safe_divide(F.coalesce(F.col("__p")[n], F.lit(0.0)), F.col("__top"))
    return out.select(
        *keys,
        F.transform("psms", lambda r: F.struct(r["psm_id"].alias("psm_id"), vector(r).alias("x"))).alias("psms"),
        F.transform("__names", share).alias("p"),
        F.transform("__names", lambda n: F.array_contains(F.col("__seen"), n).cast("int")).alias("observed"),
        F.flatten(F.flatten(F.transform("psms", lambda r: F.transform(r["f"], lambda e: F.transform(e["peaks"], lambda i: F.struct(share(e["fragment_name"]).alias("q"), i.alias("i"))))))).alias("apex"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def added(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def psm_scores(m: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Correlation with the prediction and number of observed fragments of each PSM, from `matrices`."""
    own = corr_features(m.select(*keys, "psms", "p", "observed"), keys, pairs=False).select(*keys, F.inline(F.arrays_zip(F.transform("psms", lambda r: r["psm_id"]).alias("psm_id"), F.col("c").alias("correlation"), F.col("n").alias("n"))))
    return own.select(*keys, "psm_id", "correlation", F.col("n").cast("long").alias("n_observed"))


def deviation(m: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean absolute deviation sums: l1 over all fragments, l1_total with the unobserved predictions once more, and the sum of observed predictions."""
    gaps = F.transform("psms", lambda r: added(F.zip_with(r["x"], F.col("p"), lambda x, p: F.abs(x - p))))
    of = lambda flag: added(F.zip_with("p", "observed", lambda p, o: F.when(o == flag, p).otherwise(0.0)))
    rows = m.select(*keys, added(gaps).alias("d"), F.size("psms").alias("n"), of(0).alias("unseen"), of(1).alias("seen"))
    return rows.select(*keys, (F.col("d") / F.col("n")).alias("l1"), ((F.col("d") + F.col("unseen")) / F.col("n")).alias("l1_total"), F.col("seen").alias("sum_predicted"))


def apex_scores(m: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pearson and cosine of the apex spectrum's intensities with the predictions; peptidoforms without an apex peak go."""
    q, i = F.transform("apex", lambda e: e["q"]), F.transform("apex", lambda e: e["i"])
    units = m.where(F.size("apex") > 0).select(*keys, q.alias("q"), i.alias("i"), unit_vector(q).alias("uq"), unit_vector(i).alias("ui"))
    length = F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("i"), F.col("i")))
    return units.select(*keys, F.coalesce(dot(F.col("uq"), F.col("ui")), F.lit(0.0)).alias("apex_correlation"), F.when(length > 0, dot(F.col("q"), F.col("i")) / length).otherwise(0.0).alias("apex_cosine"))


def corr_features(m: DataFrame, keys: list[str] = KEYS, pairs: bool = True) -> DataFrame:
    """The columns of `matrices`, and psm_matrix, fragment_matrix (ascending squared correlations between PSMs and between
    observed fragments; not without `pairs`), c and n (each PSM's correlation with the prediction and its number of observed fragments).

    Vectors are multiplied as matrices in Arrow batches: no pairs of rows. A peptidoform's row holds all its PSMs.
    """
    doubles = T.ArrayType(T.DoubleType())
    added = ["psm_matrix", "fragment_matrix", "c", "n"] if pairs else ["c", "n"]
    schema = T.StructType([*m.schema.fields, *(T.StructField(name, doubles) for name in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            psms = batch.column("psms")
            x = psms.flatten().field("x")
            sizes = psms.value_lengths().to_numpy()
            width = batch.column("p").value_lengths().to_numpy()
            values, p, observed = x.flatten().to_numpy(zero_copy_only=False), batch.column("p").flatten().to_numpy(zero_copy_only=False), batch.column("observed").flatten().to_numpy(zero_copy_only=False)
            places, at = np.concatenate([[0], np.cumsum(sizes * width)]), np.concatenate([[0], np.cumsum(width)])
            made: dict[str, list[np.ndarray]] = {name: [] for name in added}
            for k, (rows, columns) in enumerate(zip(sizes, width)):
                own, seen = values[places[k] : places[k + 1]].reshape(rows, columns), observed[at[k] : at[k + 1]] == 1
                for name, found in zip(added, K.matrix_features(own, p[at[k] : at[k + 1]], seen, pairs)):
                    made[name].append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(lists(made[name]) for name in added)], names=schema.names)

    return m.mapInArrow(run, schema)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of doubles as one list column."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0), *arrays])))


QUANTILES = (0, 25, 50, 75, 100)
TOP = 10


def correlation_row(m: DataFrame, keys: list[str] = KEYS, positional: bool = False) -> DataFrame:
    """53 features of a peptidoform: percentiles and top ten of three sets of correlations, the apex score and deviations, from `matrices`."""
    q, i = F.transform("apex", lambda e: e["q"]), F.transform("apex", lambda e: e["i"])
    gaps = F.transform("psms", lambda r: added(F.zip_with(r["x"], F.col("p"), lambda x, p: F.abs(x - p))))
    unseen = added(F.zip_with("p", "observed", lambda p, o: F.when(o == 0, p).otherwise(0.0)))
    rows = corr_features(m, keys).withColumns({"__gap": added(gaps), "__unseen": unseen, "__n": F.size("psms"), "__uq": unit_vector(q), "__ui": unit_vector(i)})
    rows = rows.withColumns({"l1": F.col("__gap") / F.col("__n"), "l1_total": (F.col("__gap") + F.col("__unseen")) / F.col("__n"), "apex_correlation": dot(F.col("__uq"), F.col("__ui"))})
    # correlations that differ by float noise tie, and ties go by the number of observed fragments
    individual = X.percentiles_with_index(F.transform("c", lambda c: F.round(c, 9)), F.col("n"), QUANTILES, positional)
    out = rows.withColumns({"__psm": X.percentiles(F.col("psm_matrix"), QUANTILES), "__frag": X.percentiles(F.col("fragment_matrix"), QUANTILES), "__ind": individual})
    out = out.withColumns({"__tp": X.top_values(F.col("psm_matrix"), TOP), "__tf": X.top_values(F.col("fragment_matrix"), TOP), "__ti": X.top_values(F.col("c"), TOP)})
    features = {}
    for i, q in enumerate(QUANTILES):
        features[f"distribution_correlation_matrix_psm_ids_{q}"] = F.get("__psm", F.lit(i))
        features[f"distribution_correlation_matrix_frag_ids_{q}"] = F.get("__frag", F.lit(i))
        features[f"distribution_correlation_individual_{q}"] = F.get("__ind", F.lit(i))["value"]
        features[f"distribution_correlation_individual_{q}_index"] = F.get("__ind", F.lit(i))["index"]
    for i in range(TOP):
        features[f"top_correlation_matrix_psm_ids_{i + 1}"] = F.get("__tp", F.lit(i))
        features[f"top_correlation_matrix_frag_ids_{i + 1}"] = F.get("__tf", F.lit(i))
        features[f"top_correlation_individual_{i + 1}"] = F.get("__ti", F.lit(i))
    features["top_correlation_cos_1"] = F.coalesce("apex_correlation", F.lit(0.0))
    features["mse_avg_pred_intens_1"] = F.col("l1")
    features["mse_avg_pred_intens_total_1"] = F.col("l1_total")
    return out.select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in features.items()))
