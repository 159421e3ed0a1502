"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash, joined to each block's n-grams and summed per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .exchange import FAN_OUT, Kind, ask_rows, exchange, levels, packed, unpacked
from .runtime import block_count

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 12 << 20
OUT = "doc_id long, n_words long, log10_score double, n_trigram long, n_bigram long, n_unigram long"


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def run(batches):
        size = words = 0
        for batch in batches:
            texts = H.text_bytes(batch["text"])
            size += sum(map(len, texts))
            for t in texts:
                for piece in H.pieces(t):
                    words += len(H.word_spans(np.frombuffer(piece, dtype=np.uint8))[0])
        yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64()), "words": pa.array([words], pa.int64())})

    row = docs.select("text").mapInArrow(run, "size long, words long").agg(F.sum("size"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def backoff_scores(docs: DataFrame, min_count: int = 2, block_bytes: int = BLOCK_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, n_words, log10_score, n_trigram, n_bigram, n_unigram) for every row.

    Counts of all 1-, 2- and 3-grams come from all rows, windows never cross texts. The count tables keep
    2- and 3-grams seen `min_count` times or more. A word's score is its 3-gram's count over the count of
    the 2-gram before it if the table has the 3-gram; else 0.4 times its 2-gram's count over the count of
    the word before it if the table has the 2-gram; else 0.4 times 0.4 times its share of all words. The
    first word has its share, the second starts from its 2-gram. log10_score is the sum of the logarithms,
    n_trigram, n_bigram and n_unigram tell which table gave how many words their score.

    Null and empty texts have no words and score 0. A null doc_id is carried through; repeated rows count
    and come back repeatedly. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    size, total = corpus_size(docs)
    blocks = block_count(spark, size, block_bytes)
    ranges = levels(max(blocks, spark.sparkContext.defaultParallelism), fan_out)  # for each order
    buckets = ranges[0]

    def grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return H.window_hashes(words, counts, n)

    def ask(table: pa.Table) -> pa.Table:
        words, counts = H.word_hashes(unpacked(table))
        asked = []
        for n in range(1, ORDER + 1):
            distinct, times = np.unique(grams(words, counts, n)[0], return_counts=True)
            edges = H.bucket_edges(distinct, buckets)
            asked += [((n - 1) * buckets + b, H.pack_sorted(distinct[s:e]), H.pack_counts(times[s:e])) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        return ask_rows(table["block"][0].as_py(), asked)

    def finish(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        words, counts = H.word_hashes(unpacked(table))
        count_at = []  # by order, at each window's first word
        for n in range(1, ORDER + 1):
            hashes, starts = grams(words, counts, n)
            distinct, place = np.unique(hashes, return_inverse=True)
            del hashes
            edges = H.bucket_edges(distinct, buckets)
            totals = np.zeros(len(distinct), dtype=np.int64)
            for b in range(buckets):
                if edges[b + 1] > edges[b]:
                    totals[edges[b] : edges[b + 1]] = H.unpack_counts(got[(n - 1) * buckets + b])
            at = np.zeros(len(words) + 1, dtype=np.int64)
            at[starts] = totals[place]
            count_at.append(at)
            del distinct, place, totals, starts
        one, two, three = count_at
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        g = np.arange(len(words))
        score = np.log10(np.maximum(one[g], 1) / max(total, 1)) + np.minimum(place, 2) * np.log10(BACKOFF)
        used = np.ones(len(words), dtype=np.int64)
        by_two = np.flatnonzero((place >= 1) & (two[g - 1] >= min_count))
        score[by_two] = np.log10(two[by_two - 1] / one[by_two - 1]) + (place[by_two] >= 2) * np.log10(BACKOFF)
        used[by_two] = 2
        by_three = np.flatnonzero((place >= 2) & (three[g - 2] >= min_count))
        score[by_three] = np.log10(three[by_three - 2] / two[by_three - 2])
        used[by_three] = 3
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = [np.bincount(owner, weights=score, minlength=len(counts))] + [np.bincount(owner[used == n], minlength=len(counts)) for n in (3, 2, 1)]
        return pa.table(
            [table["doc_id"].combine_chunks(), pa.array(counts, pa.int64()), pa.array(sums[0], pa.float64())] + [pa.array(s.astype(np.int64)) for s in sums[1:]],
            names=["doc_id", "n_words", "log10_score", "n_trigram", "n_bigram", "n_unigram"],
        )

    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    return exchange(packed(dealt), ask, TOTALS, finish, OUT, ranges, fan_out)


def _totals(place: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, place, number)
    return out


def _answer(hashes: list[np.ndarray], numbers: list[np.ndarray]) -> list[np.ndarray]:
    """The count table of a hash range, then every block's n-grams joined to it."""
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    table, count = every[first], np.add.reduceat(np.concatenate(numbers)[order], first)
    return [count[np.searchsorted(table, h)] for h in hashes]


#: Asks how often a hash occurs in all blocks.
TOTALS = Kind(_answer, lambda hashes, place, told: np.split(told[place], np.cumsum([len(h) for h in hashes])[:-1]), _totals)


def op10(spark, sf_dir: str) -> DataFrame:
    return backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("log10_score", F.round("log10_score", 4) + F.lit(0.0))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT c, count(*) AS n FROM t GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c HAVING count(*) >= 2),
n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
s AS (
  SELECT t.doc_id, t.i, n3.n AS n3, p2.n AS p2, n2.n AS n2, p1.n AS p1, n1.n AS n1, (SELECT count(*) FROM t) AS total
  FROM t LEFT JOIN n3 ON n3.a = t.a AND n3.b = t.b AND n3.c = t.c
         LEFT JOIN n2 p2 ON p2.b = t.a AND p2.c = t.b
         LEFT JOIN n2 ON n2.b = t.b AND n2.c = t.c
         LEFT JOIN n1 p1 ON p1.c = t.b
         JOIN n1 ON n1.c = t.c)
SELECT d.doc_id, count(s.i) AS n_words,
       round(coalesce(sum(CASE WHEN s.n3 IS NOT NULL THEN log10(s.n3 / s.p2)
                WHEN s.n2 IS NOT NULL THEN log10(s.n2 / s.p1) + CASE WHEN s.i > 2 THEN log10(0.4) ELSE 0 END
                ELSE log10(s.n1 / s.total) + least(s.i - 1, 2) * log10(0.4) END), 0), 4) + 0.0::DOUBLE AS log10_score,
       count(s.n3) AS n_trigram, count(s.i) FILTER (s.n3 IS NULL AND s.n2 IS NOT NULL) AS n_bigram,
       count(s.i) FILTER (s.n3 IS NULL AND s.n2 IS NULL) AS n_unigram
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
