"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then exact weighted-shingle similarity.

Fingerprints decide only for items where the radius covers every similar window for certain; the windows of all others are compared exactly.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_MARKS = string.punctuation.encode()


def normal(text: bytes) -> bytes:
    """A-Z in lower case, without ASCII punctuation."""
    return text.translate(_LOWER, _MARKS)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of each of the 64 bits, with a row of zeros in front."""
    out = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=out[1:])
    return out


def simhashes(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1).view(np.uint64).ravel()


def reach(sums: np.ndarray, m: int, need: int) -> int:
    """Bits in which a bag of m shingles may differ at most from the one with these bit sums if they share `need`."""
    margin, moved = 2 * sums - m, 2 * (m - need)
    return int(np.where(margin > 0, margin <= moved, margin > -moved).sum())


def least_shared(sizes: int, threshold: float) -> int:
    """Shingles that two bags of together `sizes` must share to be similar enough."""
    return math.ceil(sizes * threshold / (1 + threshold) - 1e-9)


class MultiIndex:
    """Finds every stored fingerprint within `radius` bits: of radius + 1 blocks at least one agrees."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.tables = []
        for shift, mask in self.blocks:
            keys = fps >> shift & mask
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into asked, index into the stored fingerprints), each pair once."""
        pairs = []
        for (shift, mask), (keys, order) in zip(self.blocks, self.tables):
            values = asked >> shift & mask
            low, high = np.searchsorted(keys, values), np.searchsorted(keys, values, side="right")
            n = high - low
            i = np.repeat(np.arange(len(asked)), n)
            j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            good = np.bitwise_count(asked[i] ^ self.fps[j]) <= self.radius
            pairs.append(i[good] * len(self.fps) + j[good])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.fps), both % len(self.fps)


class Items:
    """A benchmark's items by size in words: shingle hashes, their weights, fingerprints and the index over them."""

    def __init__(self, rows: list[tuple[int, bytes]], shingle: int, threshold: float, radius: int):
        self.shingle, self.threshold = shingle, threshold
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, text in rows:
            words, counts = H.word_hashes([memoryview(normal(text))])
            if len(words):
                n = min(shingle, len(words))
                by_size.setdefault((n, len(words)), []).append((item, H.window_hashes(words, counts, n)[0]))
        self.sizes, bags = {}, {}
        for (n, size), items in sorted(by_size.items()):
            m = size - n + 1
            sure = [reach(bit_sums(h)[-1], m, least_shared(2 * m, threshold)) <= radius for _, h in items]
            bags.setdefault(n, []).extend((i, size, h, s) for (i, h), s in zip(items, sure))
            if any(sure):
                items = [x for x, s in zip(items, sure) if s]
                fps = np.concatenate([simhashes(bit_sums(h), np.zeros(1, dtype=np.int64), m) for _, h in items])
                self.sizes[n, size] = (MultiIndex(fps, radius), [i for i, _ in items], [Counter(h.tolist()) for _, h in items])
        self.bags = {n: Postings(items) for n, items in bags.items()}
        self.known = {n: np.unique(np.concatenate([h for (k, _), items in by_size.items() if k == n for _, h in items])) for n in {k for k, _ in by_size}}
        self.filter = {}
        for n, known in self.known.items():
            self.filter[n] = np.zeros(1 << 20, dtype=bool)
            self.filter[n][known >> np.uint64(44)] = True

    def found(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text number, item, first word, words, similarity): each item's best window in each text."""
        best: dict[tuple[int, int], tuple] = {}
        first_word = np.cumsum(counts) - counts
        for n, known in self.known.items():
            hashes, starts = H.window_hashes(words, counts, n)
            if not len(hashes):
                continue
            maybe = np.flatnonzero(self.filter[n][hashes >> np.uint64(44)])
            place = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            hits = maybe[known[place] == hashes[maybe]]  # shingles that some item has
            if not len(hits):
                continue
            text_of = np.searchsorted(first_word + counts, starts[hits], side="right")
            for t in np.unique(text_of).tolist():
                # windows without a benchmark shingle have similarity 0, so only those around hits are made
                own = hits[text_of == t]
                low = int(np.searchsorted(starts, first_word[t]))
                high = int(np.searchsorted(starts, first_word[t] + counts[t]))
                self._scan(t, n, hashes[low:high], own - low, best)
                self._compare(t, n, hashes[low:high], own - low, best)
        return [(t, item, *rest) for (t, item), rest in sorted(best.items())]

    def _scan(self, t: int, n: int, hashes: np.ndarray, hits: np.ndarray, best: dict) -> None:
        count = np.zeros(len(hashes) + 1, dtype=np.int64)
        count[hits + 1] = 1
        count = np.cumsum(count)
        for (k, size), (index, items, weights) in self.sizes.items():
            m = size - n + 1
            if k != n or len(hashes) < m:
                continue
            # two bags of m shingles are similar enough only if they share so many
            need = least_shared(2 * m, self.threshold)
            at = np.flatnonzero(count[m:] - count[:-m] >= need)
            for run in np.split(at, np.flatnonzero(np.diff(at) > m) + 1) if len(at) else []:
                for part in np.split(run, range(4096, len(run), 4096)):
                    sums = bit_sums(np.ascontiguousarray(hashes[part[0] : part[-1] + m]))
                    i, j = index.near(simhashes(sums, part - part[0], m))
                    for a, b in zip(i.tolist(), j.tolist()):
                        start = int(part[a])
                        bag = Counter(hashes[start : start + m].tolist())
                        shared = sum((bag & weights[b]).values())
                        similarity = shared / (2 * m - shared)
                        key = (t, items[b])
                        if similarity >= self.threshold - 1e-12 and (key not in best or (similarity, -start) > (best[key][2], -best[key][0])):
                            best[key] = (start, size, similarity)

    def _compare(self, t: int, n: int, hashes: np.ndarray, hits: np.ndarray, best: dict) -> None:
        """Best windows of the items that fingerprints cannot settle: the bags' intersection with every window, in one pass over the item's hits.

        A text shorter than an item is one window as a whole.
        """
        post = self.bags[n]
        found, times = np.unique(hashes[hits], return_counts=True)
        for at in post.sharing(found, times, len(hashes), self.threshold).tolist():
            item, size, whole = post.items[at], post.sizes[at], post.sizes[at] - n + 1
            m = min(whole, len(hashes))
            if m == whole and post.sure[at]:
                continue
            own, weight = post.bags[at]
            place = np.minimum(np.searchsorted(own, hashes[hits]), len(own) - 1)
            mine = own[place] == hashes[hits]
            shared, start = best_window(hits[mine], place[mine], weight, m, len(hashes))
            similarity = shared / (whole + m - shared)
            key = (t, item)
            if similarity >= self.threshold - 1e-12 and (key not in best or (similarity, -start) > (best[key][2], -best[key][0])):
                best[key] = (start, m + n - 1, similarity)


class Postings:
    """Items (id, words, shingle hashes, whether fingerprints settle them) as bags, and the items of every shingle."""

    def __init__(self, items: list[tuple[int, int, np.ndarray, bool]]):
        self.items, self.sizes, hashes, self.sure = map(list, zip(*items))
        self.bags = [np.unique(h, return_counts=True) for h in hashes]
        self.total = np.array([len(h) for h in hashes])
        hashes, weights = np.concatenate([b[0] for b in self.bags]), np.concatenate([b[1] for b in self.bags])
        of = np.repeat(np.arange(len(items)), [len(b[0]) for b in self.bags])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.weights, self.of = hashes[order], weights[order], of[order]

    def sharing(self, found: np.ndarray, times: np.ndarray, size: int, threshold: float) -> np.ndarray:
        """Numbers of the items that share enough with a text of `size` shingles that holds the shingles `found` so many `times`."""
        low, high = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.of[at], np.minimum(self.weights[at], np.repeat(times, n)), minlength=len(self.items))
        return np.flatnonzero(shared >= np.ceil((self.total + np.minimum(self.total, size)) * threshold / (1 + threshold) - 1e-9))


def best_window(hits: np.ndarray, kind: np.ndarray, weight: np.ndarray, m: int, n: int) -> tuple[int, int]:
    """(shared shingles, start) of the earliest best of all windows of m among n shingles; `hits` ascend and are of a bag's `kind`, which counts `weight` times.

    A hit counts for the starts from which the window holds it and fewer than `weight` of its kind before it: an interval.
    """
    order = np.lexsort((hits, kind))
    p, k = hits[order], kind[order]
    back = np.arange(len(p)) - weight[k]
    same = (back >= 0) & (k[np.maximum(back, 0)] == k)
    first = np.maximum(np.where(same, p[np.maximum(back, 0)] + 1, 0), np.maximum(p - m + 1, 0))
    last = np.minimum(p, n - m)
    good = first <= last
    first, last = np.sort(first[good]), np.sort(last[good])
    if not len(first):
        return 0, 0
    # the count rises only where an interval begins
    shared = np.searchsorted(first, first, side="right") - np.searchsorted(last, first)
    return int(shared.max()), int(first[shared.argmax()])


MAX_ITEM_BYTES = 16 << 20  # benchmark text that one broadcast holds; larger benchmarks go in several
RADIUS = 15


def leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): each document and item where a window of the item's size, or a shorter text, is similar enough.

    Words are compared in lower case without ASCII punctuation; start counts such words. A window has as
    many words as the item; a text with fewer words is one window. A pair stays if the bags of shingles, weighted by how often they occur,
    have a weighted Jaccard similarity of `threshold` or more. Where no window so similar can have a SimHash
    more than `radius` bits away, the multi-index finds the item's candidates; all windows are compared
    exactly with other items, so no pair is lost. Items shorter than a shingle are one shingle.

    Items that are null or have no word match nothing; items that share an id are told as one. Null text
    has no window. Null doc_id is carried through. Repeated documents give repeated rows. Either table may
    be empty. Other columns are ignored. The items' size is checked: more than `max_bytes` are split over
    as many scans as needed.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = -(-size // max_bytes) or 1
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"

    def scan(part: int) -> DataFrame:
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect() if size else []
        shared = texts.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in rows])

        def run(batches):
            known = Items(shared.value, shingle, threshold, radius)
            for batch in batches:
                texts, ids, out = H.text_bytes(batch["text"]), batch["doc_id"].to_pylist(), []
                for a, b in H.by_bytes(texts):
                    words, counts = H.word_hashes([memoryview(normal(bytes(t))) for t in texts[a:b]])
                    out += [{"doc_id": ids[a + t], "item_id": item, "start": s, "n_words": n, "similarity": q} for t, item, s, n, q in known.found(words, counts)]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))

        return texts.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [scan(p) for p in range(parts)])


def op2(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of `docs` whose text leaks no item, all columns kept.

    Whether a row goes depends on its text alone (see `leaks`), so a null or repeated doc_id makes no
    difference and rows with equal texts share their fate. Null texts stay. No column may be named __leak.
    """
    keyed = docs.withColumn("__leak", F.xxhash64("text"))
    found = leaks(keyed.select(F.col("__leak").alias("doc_id"), "text"), items, shingle, threshold)
    return keyed.join(found.select(F.col("doc_id").alias("__leak")).distinct(), "__leak", "left_anti").drop("__leak")
