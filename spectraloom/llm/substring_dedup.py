"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark; repeated windows merge into removal intervals."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .exchange import FAN_OUT, Kind, ask_rows, exchange, levels, packed, unpacked
from .runtime import BLOCK_BYTES, block_count

OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def repeated_windows(docs: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that also starts in a document with a smaller doc_id.

    Words are runs of [^\\x20\\x09-\\x0D]. Returns a row per input row: doc_id, n_words, n_removed, spans
    (maximal removed word intervals, end exclusive) and kept_text (kept words joined by one space).

    Documents are dealt to blocks that are ranges of doc_id, so whether a smaller document has a window
    is answered by "does a smaller block have it"; inside a block it is compared directly.

    Null text has no words. A null doc_id is smaller and greater than nothing: the row loses no word and
    makes no other row lose one. Rows that share a doc_id are one document to others and lose nothing to
    each other. Texts shorter than the window are kept whole. An empty table gives an empty result.
    Other columns are ignored. 64-bit hashes: n distinct windows collide with probability n**2 / 2**65.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull())
    n_docs, size = known.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    blocks = min(block_count(spark, int(size or 0), block_bytes), max(1, n_docs))
    ranges = levels(max(blocks // 4, spark.sparkContext.defaultParallelism), fan_out)
    buckets = ranges[0]
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = np.array((known.agg(F.percentile_approx("doc_id", cuts, 20 * blocks)).first()[0] or []) if cuts else [], dtype=np.int64)
    shared = spark.sparkContext.broadcast(bounds)  # one long for each block

    def hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[memoryview]]:
        texts = unpacked(table)
        words, counts = H.word_hashes(texts)
        found, starts = H.window_hashes(words, counts, window)
        return found, starts, np.repeat(table["doc_id"].to_numpy(), counts), counts, texts

    def ask(table: pa.Table) -> pa.Table:
        distinct = np.unique(hashes(table)[0])
        edges = H.bucket_edges(distinct, buckets)
        return ask_rows(table["block"][0].as_py(), [(b, H.pack_sorted(distinct[s:e]), b"") for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s])

    def finish(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        found, starts, owner, counts, texts = hashes(table)
        distinct, place = np.unique(found, return_inverse=True)
        edges = H.bucket_edges(distinct, buckets)
        before = np.zeros(len(distinct), dtype=bool)
        for b, bits in got.items():
            before[edges[b] : edges[b + 1]] = H.unpack_counts(bits) > 0
        first = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(first, place, owner[starts])
        hit = starts[before[place] | (owner[starts] > first[place])]
        cover = np.zeros(len(owner) + 1, dtype=np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        out, at = [], 0
        for i, (doc, n) in enumerate(zip(table["doc_id"].to_pylist(), counts.tolist())):
            out.append(_row(doc, bytes(texts[i]).split(), removed[at : at + n]))
            at += n
        return pa.Table.from_pylist(out, schema=ARROW)

    def alone(batches):
        for batch in batches:
            words = [bytes(t).split() for t in H.text_bytes(batch["text"])]
            yield pa.RecordBatch.from_pylist([_row(None, w, np.zeros(len(w), dtype=bool)) for w in words], schema=ARROW)

    dealt = packed(known, lambda ids: np.searchsorted(shared.value, ids, side="right"))
    return exchange(dealt, ask, EARLIER, finish, OUT, ranges, fan_out).unionByName(docs.where(F.col("doc_id").isNull()).mapInArrow(alone, OUT))


def earlier(hashes: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    """For each entry of the parts: whether a part before has the same hash."""
    order = np.argsort(place, kind="stable")  # equal hashes stay in the order of blocks
    later = np.zeros(len(place), dtype=bool)
    later[order[1:]] = place[order[1:]] == place[order[:-1]]
    return np.split(later, np.cumsum([len(h) for h in hashes])[:-1])


def _answer(hashes: list[np.ndarray], _: list[np.ndarray]) -> list[np.ndarray]:
    return earlier(hashes, np.concatenate(hashes))


def _split(hashes: list[np.ndarray], place: np.ndarray, told: np.ndarray) -> list[np.ndarray]:
    before = np.split(told[place] > 0, np.cumsum([len(h) for h in hashes])[:-1])
    return [a | b for a, b in zip(before, earlier(hashes, place))]


#: Asks whether a smaller block has a hash.
EARLIER = Kind(_answer, _split, lambda place, number, n: np.ones(n, dtype=np.int64))
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def _row(doc: int | None, words: list[bytes], removed: np.ndarray) -> dict:
    edge = np.diff(removed.astype(np.int8), prepend=0, append=0)
    spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    kept = compress(words, ~removed) if spans else words
    return {"doc_id": doc, "n_words": len(words), "n_removed": int(removed.sum()), "spans": spans, "kept_text": b" ".join(kept).decode()}


def op4(spark, sf_dir: str) -> DataFrame:
    out = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM p) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT t.doc_id, count(*) - count(g.i) AS kept, count(g.i) AS n_removed, string_agg(x, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS s
  FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
