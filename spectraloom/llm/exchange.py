"""Block exchange: every block of documents asks hash-range buckets about its own hashes and gets an answer.

Shuffling a row for each window of a corpus costs several times the corpus. Here a block (a few
megabytes of documents) sorts its distinct hashes, cuts them into ranges of the hash space and sends
each range as one packed row; the task of a range sees every block's part and answers each with a
packed row in the same order. A hash is sent once by a block however often it occurs there, so no
hash is hot, and a task holds one range or one block, never a key's rows. Both uses of the blocks
read the same shuffle of the documents.

A block asks FAN_OUT ranges at most, so rows grow with the blocks alone. Where the hash space needs more
ranges, FAN_OUT neighbouring blocks' rows of one range are merged and ask FAN_OUT finer ranges for all of
them, and so on: each level passes the merged hashes on once, with as many rows as the one before at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H

ROWS = "block long, bucket long, ask binary, extra binary"
ANSWERS = "block long, bucket long, answer binary"


def packed(docs: DataFrame, place: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, block, packed) from (doc_id, text) and either a column `block` or a function of the ids.

    Texts go through the shuffle zstd-compressed; null stays null.
    """

    def run(batches):
        zipper = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            null = batch["text"].is_null().to_pylist()
            texts = pa.array([None if n else zipper.compress(t) for t, n in zip(H.text_bytes(batch["text"]), null)], pa.binary())
            block = batch["block"] if place is None else pa.array(place(batch["doc_id"].to_numpy()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], block, texts], names=["doc_id", "block", "packed"])

    return docs.select("doc_id", "text", *(["block"] if place is None else [])).mapInArrow(run, "doc_id long, block long, packed binary")


def unpacked(table: pa.Table) -> list[memoryview]:
    """Texts of a table of `packed` rows as UTF-8 bytes; null as empty."""
    unzipper = zstandard.ZstdDecompressor()
    return [memoryview(b"" if t is None else unzipper.decompress(t)) for t in table["packed"].to_pylist()]


def ask_rows(block: int, asked: list[tuple[int, bytes, bytes]]) -> pa.Table:
    """asked: bucket, packed hashes, packed extras."""
    return pa.table(
        {
            "block": pa.array([block] * len(asked), pa.int64()),
            "bucket": pa.array([a[0] for a in asked], pa.int64()),
            "ask": pa.array([a[1] for a in asked], pa.binary()),
            "extra": pa.array([a[2] for a in asked], pa.binary()),
        }
    )


FAN_OUT = 256


@dataclass(frozen=True)
class Kind:
    """What is asked about hashes. A part is what a block asks: ascending distinct hashes and a number for each.

    answer: an array for each part, in the order of blocks; the parts of one range are all there.
    split: an array for each part, from the same parts and what was told about their distinct hashes.
    merge: the numbers of the parts' distinct hashes, where `place` says which of them each entry is.
    """

    answer: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]
    split: Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]
    merge: Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def parts_of(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], list[np.ndarray]]:
    """Rows by block, with their hashes and numbers."""
    table = table.sort_by("block")
    hashes = [H.unpack_sorted(x) for x in table["ask"].to_pylist()]
    return table, hashes, [H.unpack_counts(x) if x else np.ones(len(h), dtype=np.int64) for x, h in zip(table["extra"].to_pylist(), hashes)]


def levels(buckets: int, fan_out: int = FAN_OUT) -> list[int]:
    """Ranges that a block, then a merged block, cuts its hashes into: at most fan_out each, `buckets` or more together."""
    out = []
    while buckets > 1 or not out:
        out.append(min(buckets, fan_out))
        buckets = -(-buckets // fan_out)
    return out


def merged(asked: DataFrame, kind: Kind, ranges: int, finer: int, fan_out: int) -> DataFrame:
    """The next level's questions: groups of `fan_out` blocks ask `finer` parts of each of `ranges` ranges as one block."""

    def merge(table: pa.Table) -> pa.Table:
        group, bucket = table["group"][0].as_py(), table["bucket"][0].as_py()
        _, hashes, numbers = parts_of(table)
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        number = kind.merge(place, np.concatenate(numbers), len(distinct))
        at = bucket % ranges
        firsts = [((at * finer + k) << 64) // (ranges * finer) for k in range(finer)]
        edges = np.append(np.searchsorted(distinct, np.array(firsts, dtype=np.uint64)), len(distinct))
        return ask_rows(group, [(bucket * finer + k, H.pack_sorted(distinct[s:e]), H.pack_counts(number[s:e])) for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s])

    return grouped(asked, fan_out).groupBy("group", "bucket").applyInArrow(merge, ROWS)


def grouped(asked: DataFrame, fan_out: int) -> DataFrame:
    return asked.withColumn("group", F.floor(F.col("block") / fan_out))


def answered(asked: DataFrame, kind: Kind, cuts: list[int], fan_out: int) -> DataFrame:
    """(block, bucket, answer) for all questions; cuts: `levels`, of which the first is done."""
    if len(cuts) == 1:

        def answers(table: pa.Table) -> pa.Table:
            table, hashes, numbers = parts_of(table)
            return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array([H.pack_counts(x) for x in kind.answer(hashes, numbers)], pa.binary())})

        return asked.groupBy("bucket").applyInArrow(answers, ANSWERS)

    finer = cuts[1]

    def split(table: pa.Table, got: pa.Table) -> pa.Table:
        table, hashes, _ = parts_of(table)
        got = got.sort_by("bucket")
        told = [H.unpack_counts(x) for x in got["answer"].to_pylist()]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        out = kind.split(hashes, place, np.concatenate(told))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array([H.pack_counts(x) for x in out], pa.binary())})

    above = answered(merged(asked, kind, cuts[0], finer, fan_out), kind, [cuts[0] * finer, *cuts[2:]], fan_out)
    above = above.select(F.col("block").alias("group"), F.floor(F.col("bucket") / finer).alias("of"), "bucket", "answer")
    return grouped(asked, fan_out).groupBy("group", "bucket").cogroup(above.groupBy("group", "of")).applyInArrow(split, ANSWERS)


def exchange(blocks: DataFrame, ask: Callable[[pa.Table], pa.Table], kind: Kind, finish: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str, cuts: list[int], fan_out: int = FAN_OUT) -> DataFrame:
    """blocks has a column `block`; ask and finish run once for each block and cut the hash space into cuts[0] ranges (see `levels`).

    A bucket is a range's number, plus cuts[0] for every further kind of hash that a block asks about.
    """

    def finished(docs: pa.Table, got: pa.Table) -> pa.Table:
        return finish(docs, dict(zip(got["bucket"].to_pylist(), got["answer"].to_pylist())))

    asked = blocks.groupBy("block").applyInArrow(ask, ROWS)
    return blocks.groupBy("block").cogroup(answered(asked, kind, cuts, fan_out).groupBy("block")).applyInArrow(finished, schema)
