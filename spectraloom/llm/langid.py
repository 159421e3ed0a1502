"""Language ID: the language family first, then one-versus-one linear support vector machines inside the family."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H

DIMS = 2048
ORDERS = (1, 2, 3, 4)
LETTER = regex.compile(r"\p{L}")
TRAIN_ROWS = 1200  # documents of each language that training may look at; a bound, not a share
TRAIN_TOTAL = 20_000  # documents over all languages, 8 KB of features each on the driver


def features(text: bytes) -> np.ndarray:
    """Hashed shares of the byte n-grams of the whole text (ASCII letters in lower case), square-rooted."""
    out = np.zeros(DIMS)
    for at in range(0, max(1, len(text)), H.CHUNK):
        data = np.frombuffer(text[at : at + H.CHUNK + max(ORDERS) - 1].lower(), dtype=np.uint8).astype(np.uint64)
        code = np.zeros(len(data), dtype=np.uint64)
        for n in ORDERS:
            size = min(len(data) - n + 1, H.CHUNK)
            if size <= 0:
                break
            code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
            out += np.bincount((code[:size] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).view(np.int64), minlength=DIMS)
    total = out.sum()
    return np.sqrt(out / total) if total else out


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM: hinge loss, stochastic subgradient, averaged over the second half."""
    rng = np.random.default_rng(seed)
    w, kept, n_kept, step = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0, 0
    for r in range(rounds):
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(x) // 16)):
            step += 1
            rate = 1.0 / (penalty * (step + 1000))
            own = x[part].astype(np.float64)  # only a part of the rows is ever widened
            wrong = y[part] * (own @ w[:-1] + w[-1]) < 1
            w *= 1 - rate * penalty
            if wrong.any():
                w[:-1] += rate / len(part) * (y[part][wrong] @ own[wrong])
                w[-1] += rate / len(part) * y[part][wrong].sum()
            if r >= rounds // 2:
                kept += w
                n_kept += 1
    return kept / max(n_kept, 1)


def families(means: np.ndarray, n: int) -> list[list[int]]:
    """Average-linkage groups of languages by the cosine of their mean features, down to n groups."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > n:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    """Languages, their families, a one-versus-rest SVM for each family and a one-versus-one SVM for each pair inside one."""

    langs: list[str]
    groups: list[list[int]]
    family: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score in 0..1 for every row of features."""
        x = np.hstack([x, np.ones((len(x), 1))])
        lang, score = np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        side = x @ self.family.T
        chosen = side.argmax(axis=1)
        if len(self.groups) > 1:
            score *= squash(side.max(axis=1))
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(chosen == g)
            votes, margin = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                m = x[rows] @ self.pairs[a, b]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] += m
                margin[:, j] -= m
            best = (votes + 1e-3 * np.tanh(margin)).argmax(axis=1)
            lang[rows] = np.array(members)[best]
            if len(members) > 1:
                score[rows] *= squash(margin[np.arange(len(rows)), best] / (len(members) - 1))
        return lang, score


def squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * margin, -50, 50)))


def fit(x: np.ndarray, lang: np.ndarray, names: list[str]) -> Model:
    means = np.stack([x[lang == i].mean(axis=0, dtype=np.float64) for i in range(len(names))])
    groups = families(means, max(1, round(math.sqrt(len(names)))))
    group_of = np.zeros(len(names), dtype=np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    family = np.zeros((len(groups), x.shape[1] + 1))
    if len(groups) > 1:
        family = np.stack([train_svm(x, np.where(group_of[lang] == g, 1.0, -1.0)) for g in range(len(groups))])
    pairs = {}
    for members in groups:
        for a, b in combinations(members, 2):
            rows = (lang == a) | (lang == b)
            pairs[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))
    return Model(names, groups, family, pairs)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> Model | None:
    """A model from (doc_id, text, lang), from about `rows_per_lang` rows of each language at most, taken by a hash of id and text.

    Every language is learned; TRAIN_TOTAL bounds the rows over all of them, but for one row each. Rows with a
    null lang are left out, a null text is an empty one, repeated rows are taken together or not at all; the
    order of rows makes no difference. None if there is no labelled row.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    rows_per_lang = max(1, min(rows_per_lang, TRAIN_TOTAL // len(counts)))
    share = F.element_at(F.create_map(*(F.lit(v) for name, n in sorted(counts.items()) for v in (name, min(1.0, rows_per_lang / n)))), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    # the first row in the order of hashes is taken in any case
    first = labelled.groupBy("lang").agg(F.min(place).alias("first"))
    taken = labelled.join(F.broadcast(first), "lang")  # a row for each language, as `counts` has
    taken = taken.where((place < share * 1_000_003) | (place == F.col("first"))).select("lang", "text")

    def run(batches):
        for batch in batches:
            x = [features(bytes(t)).astype(np.float32).tobytes() for t in H.text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(x, pa.binary())], names=["lang", "x"])

    rows = taken.mapInArrow(run, "lang string, x binary").toArrow()
    seen = rows["lang"].to_pylist()
    x = np.empty((rows.num_rows, DIMS), dtype=np.float32)
    for i, v in enumerate(rows["x"]):
        x[i] = np.frombuffer(v.as_buffer(), dtype=np.float32)
    del rows
    order = np.lexsort((np.array([hash_of(r) for r in x]), np.array(seen)))  # the same model whatever the order of rows
    names = sorted(set(seen))
    at = {n: i for i, n in enumerate(names)}
    return fit(x[order], np.array([at[seen[i]] for i in order]), names)


def hash_of(row: np.ndarray) -> float:
    return float(row.astype(np.float64) @ np.arange(1, len(row) + 1))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the whole text and nothing else.

    `und` with score 0 where text is null or has no letter, or nothing could be learned. Repeated rows come
    back repeated, a null doc_id is carried through, an empty table gives an empty result; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights for each pair of a family's languages

    def run(batches):
        for batch in batches:
            texts = [bytes(t) for t in H.text_bytes(batch["text"])]
            lang, score = np.array(["und"] * len(texts), dtype=object), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if shared.value and LETTER.search(t.decode("utf-8", "replace"))]
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                found, sure = shared.value.predict(np.stack([features(texts[i]) for i in part]))
                lang[part], score[part] = np.array(shared.value.langs, dtype=object)[found], sure
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return identify(docs, train(labelled)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
