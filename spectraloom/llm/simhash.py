"""SimHash near-dedup: a byte-position inverted index with count filtering finds every pair of fingerprints within the radius."""

from __future__ import annotations

import string
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .components import components
from .quality import let, words
from .runtime import cut, sized

SEED = 42
RADIUS = 3
BYTES = 8
SHARED = BYTES - RADIUS  # pairs within the radius differ in 3 bytes at most, so they share 5
#: Sets of four byte positions whose numbers cancel out under XOR. Any five of the eight positions hold
#: one of these sets, so pairs that share five bytes meet in at least one list.
INDEXED = tuple(c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash over XXH64 of the `shingle`-word shingles, repeats included."""
    split = text.lower().split()
    if not split:
        return 0
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    if len(split) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(split) - shingle + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's 64 bits as a signed long. Null, empty and blank texts get zero."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(bytes(t), shingle) for t in H.text_bytes(batch["text"])], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def tallied_pairs(lists: np.ndarray, positions: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints in the same list that reach the guaranteed minimum of shared positional bytes and lie within the radius.

    A list holds distinct fingerprints that share the bytes at the four positions with a bit in `positions`.
    An inverted index over the other positions, a posting for each (list, position, byte), gives the hits:
    two members of a posting share that byte. Hits are tallied per pair, pairs with fewer than the minimum
    are never compared, and each other pair is verified by its Hamming distance once, at its first hit.
    """
    least = BYTES - radius - 4
    bit = np.uint8(1) << np.arange(BYTES, dtype=np.uint8)
    left, right = [], []
    _, place, size = np.unique(lists, return_inverse=True, return_counts=True)
    at = np.flatnonzero(size[place] > 1)  # a list of one has no pair
    lists, positions, fps = lists[at], positions[at], fps[at]
    octets = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, BYTES)
    for p in range(BYTES):
        own = np.flatnonzero(positions >> np.uint8(p) & 1 == 0)
        own = own[np.lexsort((octets[own, p], lists[own]))]
        place_of = np.empty(len(fps), dtype=np.int64)
        place_of[own] = np.arange(len(own))
        a, b = own[:-1], own[1:]
        while len(a):  # neighbours in a posting, then those two apart, and so on
            met = (lists[a] == lists[b]) & (octets[a, p] == octets[b, p])
            a, b = a[met], b[met]
            same = (octets[a] == octets[b]) & (positions[a][:, None] & bit == 0)
            first = same.argmax(axis=1) == p
            good = first & (same.sum(axis=1) >= least)
            x, y = fps[a[good]], fps[b[good]]
            near = np.bitwise_count(x ^ y) <= radius
            left.append(x[near])
            right.append(y[near])
            after = place_of[b] + 1  # the next member of the posting, if there is one
            a, b = a[after < len(own)], own[after[after < len(own)]]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def forest(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest: every node with its root, so dense groups leave one row per member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in zip(left.tolist(), right.tolist()):
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect just the distinct fingerprints `fp` which chains of pairs within the radius connect.

    With a column `table` fingerprints of different tables never meet, and the links have it too. The index
    has a list for each set of byte positions in INDEXED and the bytes there; see `tallied_pairs` for what
    happens in a list. Its members are distinct fingerprints, so copies never make one long.
    """
    table = F.col("table") if "table" in distinct.columns else F.lit(0).alias("table")
    postings = []
    for k, c in enumerate(INDEXED):
        mask = sum(0xFF << 8 * p for p in c)
        postings.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes")))
    rows = distinct.select(table.cast("int"), "fp", F.inline(F.array(*postings)))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["table", "k", "bytes"]
    dealt = rows.repartition(parts, *key).sortWithinPartitions(*key, "fp")
    at_positions = np.array([sum(1 << p for p in c) for c in INDEXED], dtype=np.uint8)

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        table, k, key, fp = rows
        new = np.r_[True, (table[1:] != table[:-1]) | (k[1:] != k[:-1]) | (key[1:] != key[:-1])]
        lists = np.cumsum(new) - 1
        a, b = tallied_pairs(lists, at_positions[k], fp)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(a.view(np.int64), b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held = [np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            got = [batch["table"].to_numpy(), batch["k"].to_numpy(), batch["bytes"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)]
            held = [np.r_[x, y] for x, y in zip(held, got)]
            whole = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in held[:3]]))
            n = int(whole[-1]) + 1 if len(whole) else 0  # the last list may go on in the next batch
            edges = np.flatnonzero(np.diff(held[0][:n])) + 1 if n >= 1 << 16 else None
            if edges is not None:
                for s, e in zip([0, *edges.tolist()], [*edges.tolist(), n]):
                    yield tagged([x[s:e] for x in held])
                held = [x[n:] for x in held]
        for t in np.unique(held[0]).tolist():
            yield tagged([x[held[0] == t] for x in held])

    def tagged(rows: list[np.ndarray]) -> pa.RecordBatch:
        out = found(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, rows[0][0]), pa.int32()), *out.columns], names=["table", "a", "b"])

    out = dealt.mapInArrow(run, "table int, a long, b long")
    return out if "table" in distinct.columns else out.drop("table")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row: documents whose fingerprints are chained by pairs within the radius.

    component_id is the smallest doc_id of the chain. Texts that are null, empty or blank have fingerprint
    zero and are linked like any other. A null doc_id is in its group but is never the smallest unless the
    group has no other id; then component_id is null. Repeated rows come back repeated. An empty table
    gives an empty result. Only distinct fingerprints are indexed, so copies never meet as pairs.
    """
    marked = cut(fingerprints(docs, shingle))
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = cut(smallest)
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


TABLES = 6
FEATURE = 2  # words of a sketch's features
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SEEDS = np.random.default_rng(17).integers(1, 1 << 63, 64, dtype=np.uint64)


def sketch(text: bytes, tables: int = TABLES) -> list[int]:
    """`tables` SimHashes of a text's word pairs, A-Z in lower case, each by other hashes; all zero without a word."""
    words, counts = H.word_hashes([memoryview(text.translate(LOWER))])
    if not len(words):
        return [0] * tables
    h = H.window_hashes(words, counts, min(FEATURE, len(words)))[0]
    out = []
    for seed in _SEEDS[:tables]:
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(H.mix64(h[at : at + (1 << 16)] ^ seed).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        out.append(int(np.packbits(2 * ones > len(h)).view("<i8")[0]))
    return out


def shingles(text: Column, size: int) -> Column:
    """Distinct hashes of a text's word shingles, A-Z in lower case; a shorter text is one shingle."""
    h = F.transform(words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)), lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        out = h
        for k in range(1, size):
            out = F.zip_with(out, F.slice(h, k + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        whole = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, b: F.xxhash64(a, b)))
        return F.array_distinct(F.when(F.size(h) < size, whole).otherwise(F.slice(out, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))))

    return let(h, rolled)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct hashes."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def near_groups(docs: DataFrame, tables: int = TABLES) -> DataFrame:
    """(doc_id, text_hash, root): rows whose sketches are chained by fingerprints of one table within the radius share a root."""

    def run(batches):
        for batch in batches:
            fps = [sketch(bytes(t), tables) for t in H.text_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fps"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    marked = cut(rows.mapInArrow(run, "doc_id long, text_hash long, fps array<long>").withColumn("u", F.xxhash64("fps")))
    owned = cut(marked.select("u", "fps").dropDuplicates(["u"]).select("u", F.posexplode("fps").alias("table", "fp")))
    # a fingerprint stands for the least sketch that has it
    least = cut(owned.groupBy("table", "fp").agg(F.min("u").alias("m"), F.max("u").alias("x")))
    equal = owned.join(least.where("m < x").drop("x"), ["table", "fp"]).select(F.col("u").alias("a"), F.col("m").alias("b"))
    found = links(least.select("table", "fp"))
    for side in ("a", "b"):
        found = found.join(least.select("table", F.col("fp").alias(side), F.col("m").alias(f"{side}_m")), ["table", side])
    near = found.select(F.col("a_m").alias("a"), F.col("b_m").alias("b"))
    roots = components(cut(equal).unionByName(cut(near)))
    return marked.join(roots, marked["u"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "u").alias("root"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tables: int = TABLES) -> DataFrame:
    """Rows of `docs`, all columns kept, without near duplicates of the smallest doc_id of their group.

    SimHash finds the groups: `tables` fingerprints of word pairs, each with its own index and the radius
    of three bits. A row goes only if its own text is the kept one's or their sets of `shingle`-word
    shingles have a Jaccard similarity of `similarity` or more, so what SimHash chains too far stays. One
    comparison for each row of a group, never a pair of members.

    The kept row of a group is the one of the smallest doc_id, then of the smallest text hash; equal rows of
    it are one document and stay. A row with a null doc_id is never the kept one unless the group has no id;
    then the group loses nothing. Null, empty and blank texts are alike and form a group. An empty table stays
    empty. No column may have a name that begins with __near.
    """
    group = cut(near_groups(docs, tables))
    kept = group.where(F.col("doc_id").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    member = group.join(kept, "root").where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("kept"))).distinct()
    member = cut(member.select("doc_id", "text_hash", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash")))
    same = member.where("text_hash = kept_hash").select("doc_id", "text_hash")
    unlike = member.where("text_hash <> kept_hash")
    wanted = unlike.select("doc_id", "text_hash").unionByName(unlike.select(F.col("kept_id").alias("doc_id"), F.col("kept_hash").alias("text_hash"))).distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    wanted = sized(wanted.select(F.col("doc_id").alias("w"), F.col("text_hash").alias("h")))
    texts = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["w"]) & (keyed["text_hash"] == wanted["h"]), "left_semi")
    texts = cut(texts.select("doc_id", "text_hash", shingles(F.col("text"), shingle).alias("s")).dropDuplicates(["doc_id", "text_hash"]))
    left = texts.select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), F.col("s").alias("l"))
    right = texts.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), F.col("s").alias("r"))
    compared = unlike.join(right, ["kept_id", "kept_hash"]).join(left, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")))
    alike = compared.where(jaccard(F.col("l"), F.col("r")) >= similarity).select("doc_id", "text_hash")
    loser = sized(same.unionByName(alike).distinct().select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_text")))
    rows = docs.withColumn("__near_key", F.xxhash64("text"))
    gone = F.col("doc_id").cast("long").eqNullSafe(F.col("__near_id")) & (F.col("__near_key") == F.col("__near_text"))
    return rows.join(loser, gone, "left_anti").drop("__near_key")
