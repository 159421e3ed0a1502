"""Suffix-array dedup by prefix-free parsing: rolling-hash triggers cut text into phrases; the suffix arrays of the dictionary and of the parse give the order of all suffixes.

The corpus is parsed into phrases that overlap by one byte less than a string: every 200-byte string has a
trigger, the k-gram of least rolling hash among its first ones, and the strings with one trigger are a phrase.
So each string lies in just one phrase, equal strings lie at the same distance from equal triggers, and the
order of all strings is the order of the dictionary's suffixes, each as often as the parse has its phrase:

1. The dictionary and the parse. Phrases are counted over all blocks, by a hash of the bytes that all strings
   of a phrase share (the group) and of all its bytes (the phrase). The suffixes of a phrase that the parse has
   twice or more stand next to their own copies; a phrase whose group has no other has no other neighbours.
2. The suffix array. One copy of each phrase in a group of several goes to the task of its group, where the
   suffixes of the group's phrases are put in order by parsing them again into short phrases; neighbours
   with 200 equal bytes are repeats. Groups are ranges of that order: suffixes of two groups are never equal.
3. The starts found in either way are joined to their documents and merged into removed intervals.

A passage that a third of all documents hold makes a group with very many phrases. Such a hot group is dealt
out further before step 2: its phrases are cut into pieces of PIECE starts, by the distance to the trigger, and
pieces go to tasks by the bytes that all strings of a piece share. The same order then decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .exchange import ANSWERS, ROWS, ask_rows, packed, unpacked
from .runtime import BLOCK_BYTES, block_count

GRAM = 16  # bytes of an anchor
REACH = 96  # an anchor lies among the first REACH positions of a string
STEP = 1 << 19
WIDE_GROUP = 256  # phrases; a wider group is dealt out by pieces
PIECE = 12  # starts of a piece
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs(texts: list[memoryview], length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of `length` bytes with one anchor: first start, number of starts, group and class hash, bytes before the anchor.

    Starts count through the texts as if joined.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    batch: list[tuple[int, memoryview]] = []
    held, base = 0, 0
    shared = length - REACH + 1

    def flush() -> None:
        nonlocal batch, held
        if not batch:
            return
        data = np.frombuffer(b"".join(p for _, p in batch), dtype=np.uint8)
        sizes = np.array([len(p) for _, p in batch])
        begins = np.cumsum(sizes) - sizes
        prefix = H.byte_prefix(data)
        grams = np.arange(len(data) - GRAM + 1)
        packed = H.span_hashes(prefix, grams, grams + GRAM, H.BYTE_BASE) & np.uint64(~((1 << 21) - 1) & H.MASK) | grams.astype(np.uint64)
        anchor = (sliding_min(packed, REACH) & np.uint64((1 << 21) - 1)).astype(np.int64)
        starts = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(begins.tolist(), sizes.tolist())])
        anchor = anchor[starts]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first, last = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
        at = anchor[new]
        piece = np.searchsorted(begins, first, side="right") - 1
        out[0].append(first - begins[piece] + np.array([b for b, _ in batch])[piece])
        out[1].append(last - first + 1)
        out[2].append(H.span_hashes(prefix, at, at + shared, H.BYTE_BASE))
        out[3].append(H.span_hashes(prefix, first, last + length, H.BYTE_BASE))
        out[4].append(at - first)
        batch, held = [], 0

    for text in texts:
        for at in range(0, len(text) - length + 1, STEP):
            batch.append((base + at, text[at : at + STEP + length - 1]))
            held += len(batch[-1][1])
            if held >= H.CHUNK:
                flush()
        base += len(text)
    flush()
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=k) for x, k in zip(out, kinds))


def dense(x: np.ndarray) -> np.ndarray:
    """1-based ranks of values; equal values share a rank."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64) + 1


def doubled(rank: np.ndarray, ends: np.ndarray, have: int, need: int) -> np.ndarray:
    """Prefix doubling: ranks by `have` symbols become ranks by `need` or more; a suffix ends at its `ends`, and the end is smallest."""
    at = np.arange(len(rank))
    while have < need:
        after = np.zeros(len(rank), dtype=np.int64)
        inside = np.flatnonzero(at + have < ends)
        after[inside] = rank[inside + have]
        rank = dense(rank * (len(rank) + 1) + after)
        have *= 2
    return rank


def repeated_starts(members: list[bytes], length: int) -> np.ndarray:
    """For each start in each member with `length` bytes left: whether those bytes also start elsewhere.

    Prefix-free parsing: a phrase begins at a trigger (an 8-gram whose rolling hash is 0 modulo 16) and ends
    with the next one, so no whole phrase begins with another. Sorting the suffixes of the distinct phrases
    and the suffixes of the parse orders every suffix by (its part in its phrase, the parse from there on).
    """
    w, modulus = 8, np.uint64(16)
    data = np.frombuffer(b"".join(members), dtype=np.uint8)
    sizes = np.array([len(m) for m in members])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    prefix = H.byte_prefix(data)
    grams = np.arange(len(data) - w + 1)
    trigger = np.zeros(len(data), dtype=bool)
    trigger[: len(grams)] = H.span_hashes(prefix, grams, grams + w, H.BYTE_BASE) % modulus == 0
    for i in range(1, w):
        trigger[ends - i] = False  # would reach into the next member
    trigger[begins] = True
    start = np.flatnonzero(trigger)
    member = np.searchsorted(begins, start, side="right") - 1
    after = np.r_[start[1:], len(data)]
    end = np.minimum(after + w, ends[member])
    # the dictionary: distinct phrases, laid end to end
    _, which, phrase = np.unique(H.span_hashes(prefix, start, end, H.BYTE_BASE), return_index=True, return_inverse=True)
    lengths = (end - start)[which]
    stops = np.cumsum(lengths)
    origin = stops - lengths
    letters = data[np.repeat(start[which] - origin, lengths) + np.arange(stops[-1])].astype(np.int64) + 1
    stop_of = np.repeat(stops, lengths)
    code = np.zeros(len(letters), dtype=np.int64)
    for i in range(6):  # the first six letters in one number, base 257, 0 past the phrase's end
        here = np.zeros(len(letters), dtype=np.int64)
        here[: len(letters) - i] = letters[i:]
        here[np.arange(len(letters)) + i >= stop_of] = 0
        code = code * 257 + here
    in_phrase = doubled(dense(code), stop_of, 6, int(lengths.max()))
    # the parse: its phrases by rank, and the order of its suffixes
    last_of = np.searchsorted(start, ends[member])  # where the member's phrases end in the parse
    parse = doubled(dense(in_phrase[origin][phrase]), last_of, 1, int(np.bincount(member).max()))
    # every start with `length` bytes left
    n = sizes - length + 1
    firsts = np.cumsum(n) - n
    at = np.repeat(begins - firsts, n) + np.arange(n.sum())
    j = np.searchsorted(start, at, side="right") - 1
    following = np.zeros(len(at), dtype=np.int64)
    more = j + 1 < last_of[j]
    following[more] = parse[j[more] + 1]
    order = np.lexsort((following, in_phrase[origin[phrase[j]] + at - start[j]]))
    a, b = at[order[:-1]], at[order[1:]]
    alike = np.flatnonzero(H.span_hashes(prefix, a, a + length, H.BYTE_BASE) == H.span_hashes(prefix, b, b + length, H.BYTE_BASE))
    found = np.zeros(len(at), dtype=bool)
    for part in np.array_split(alike, len(alike) // 8192 + 1):  # neighbours, letter by letter
        span = np.arange(length)
        same = part[(data[a[part][:, None] + span] == data[b[part][:, None] + span]).all(axis=1)]
        found[order[same]] = True
        found[order[same + 1]] = True
    return found


SURE, SEND, WIDE = 1, 2, 4


def judge(asked: list[bytes], extra: list[bytes], wide_group: int) -> list[bytes]:
    """Step 1 for one range of groups: a code for every class that a block asked about."""
    parts = [H.unpack_sorted(x) for x in asked]
    n = [len(p) for p in parts]
    group = np.concatenate(parts)
    kind = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=k) for x, k in zip(extra, n)])
    twice = np.concatenate([H.unpack_bits(x[8 * k :], k) for x, k in zip(extra, n)])
    order = np.lexsort((kind, group))  # stable: a class's first row is the one of the smallest block
    g, c = group[order], kind[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_class = new_group | np.r_[True, c[1:] != c[:-1]]
    class_at, group_at = np.flatnonzero(new_class), np.flatnonzero(new_group)
    members = np.diff(np.r_[class_at, len(g)])
    sure = np.repeat((members > 1) | np.logical_or.reduceat(twice[order], class_at), members)
    classes = np.repeat(np.add.reduceat(new_class.astype(np.int64), group_at), np.diff(np.r_[group_at, len(g)]))
    code = np.empty(len(g), dtype=np.uint8)
    code[order] = sure * SURE + (new_class & (classes > 1)) * SEND + (classes > wide_group) * WIDE
    return [H._ZIP.compress(x.tobytes()) for x in np.split(code, np.cumsum(n)[:-1])]


def repeated_bytes(docs: DataFrame, length: int = 200, block_bytes: int = BLOCK_BYTES, wide_group: int = WIDE_GROUP) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another.

    Texts are UTF-8 bytes; matches lie inside one text each, and may overlap. Returns a row per input row:
    doc_id, n_bytes, n_removed, spans (maximal removed intervals, end exclusive) and kept (binary: a cut may
    fall inside a character).

    Null text is empty. Repeated rows are repeats of each other like any equal texts. A null doc_id is
    carried through. Texts shorter than `length` are kept whole. An empty table gives an empty result.
    Other columns are ignored. Groups and phrases are told apart by 64-bit hashes. Equal rows are one block's.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    blocks = block_count(docs.sparkSession, size, block_bytes)
    buckets = max(blocks, docs.sparkSession.sparkContext.defaultParallelism)

    def texts_of(table: pa.Table) -> tuple[pa.Table, list[memoryview]]:
        table = table.sort_by([("doc_id", "ascending"), ("packed", "ascending")])  # starts count through the block
        return table, unpacked(table)

    def classes(texts: list[memoryview]):
        first, n, group, kind, lead = runs(texts, length)
        _, which, times = np.unique(kind, return_index=True, return_counts=True)
        by_group = np.argsort(group[which], kind="stable")
        which, times = which[by_group], times[by_group]
        return first, n, group, kind, lead, which, times, H.bucket_edges(group[which], buckets)

    def ask(table: pa.Table) -> pa.Table:
        _, _, group, kind, _, which, times, edges = classes(texts_of(table)[1])
        asked = [(b, H.pack_sorted(group[which[s:e]]), kind[which[s:e]].tobytes() + H.pack_bits(times[s:e] > 1)) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        return ask_rows(table["block"][0].as_py(), asked)

    def judged(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(judge(table["ask"].to_pylist(), table["extra"].to_pylist(), wide_group), pa.binary())})

    def ask_again(docs_: pa.Table, got: pa.Table) -> pa.Table:
        """Step 2: members of groups with several phrases by group; those of wide groups by piece; to the block itself what it knows by now."""
        if not docs_.num_rows:
            return ask_rows(0, [])
        block = docs_["block"][0].as_py()
        texts = texts_of(docs_)[1]
        first, n, group, kind, lead, which, _, edges = classes(texts)
        code = np.zeros(len(which), dtype=np.uint8)
        for b, answer in zip(got["bucket"].to_pylist(), got["answer"].to_pylist()):
            code[edges[b] : edges[b + 1]] = np.frombuffer(H._UNZIP.decompress(answer), dtype=np.uint8)
        rows = []
        # every run of a class that is sure is removed
        by_kind = np.argsort(kind[which])
        of_run = by_kind[np.searchsorted(kind[which][by_kind], kind)] if len(kind) else by_kind
        sure = np.flatnonzero(code[of_run] & SURE)
        known = [first[sure], n[sure]]
        joined = b"".join(texts)
        lengths_, starts_, hashed = [], [], []
        for b in range(buckets):
            at = np.arange(edges[b], edges[b + 1])
            sent = which[at[code[at] & (SEND | WIDE) == SEND]]
            if len(sent):
                parts = [joined[s : s + k + length - 1] for s, k in zip(first[sent].tolist(), n[sent].tolist())]
                rows.append((b, H._ZIP.compress(b"".join(parts)), H.pack_counts(n[sent])))
                starts_.append(first[sent])
                lengths_.append(n[sent])
                hashed.append(np.full(len(sent), b))
        wide = which[code & (SEND | WIDE) == SEND | WIDE]
        at, of, size, keys, pieces, twice = pieces_of(joined, first[wide], n[wide], lead[wide], length)
        w_edges = H.bucket_edges(keys, buckets)
        for b, (s, e) in enumerate(zip(w_edges[:-1], w_edges[1:])):
            if e > s:
                rows.append((buckets + b, H._ZIP.compress(b"".join(pieces[s:e])), H.pack_counts(np.concatenate([size[s:e], twice[s:e]]))))
        empty = np.empty(0, dtype=np.int64)
        own = [*known, *(np.concatenate(x) if x else empty for x in (hashed, starts_, lengths_)), at, of, size, w_edges]
        rows.append((-1 - block, b"", b"".join(len(p).to_bytes(8, "little") + p for p in map(H.pack_counts, own))))
        return ask_rows(block, rows)

    def answered(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket = table["bucket"][0].as_py()
        asked, extra = table["ask"].to_pylist(), table["extra"].to_pylist()
        if bucket < 0:
            out = extra
        else:
            members, counts, twice = [], [H.unpack_counts(x) for x in extra], []
            if bucket >= buckets:  # pieces: their starts, then whether their block has them twice
                counts, flags = zip(*(np.split(x, 2) for x in counts))
                twice = np.repeat(np.concatenate(flags), np.concatenate(counts)) > 0
            for x, k in zip(asked, counts):
                text, at = H._UNZIP.decompress(x), 0
                for c in k.tolist():
                    members.append(text[at : at + c + length - 1])
                    at += c + length - 1
            found = repeated_starts(members, length)
            found = found | twice if bucket >= buckets else found
            out = [H.pack_bits(x) for x in np.split(found, np.cumsum([k.sum() for k in counts])[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "answer": pa.array(out, pa.binary())})

    def finish(docs_: pa.Table, got: pa.Table) -> pa.Table:
        docs_, texts = texts_of(docs_)
        answers = dict(zip(got["bucket"].to_pylist(), got["answer"].to_pylist()))
        own, rest = [], answers.pop(-1 - docs_["block"][0].as_py()) if docs_.num_rows else b""
        while rest:
            k = int.from_bytes(rest[:8], "little")
            own.append(H.unpack_counts(rest[8 : 8 + k]))
            rest = rest[8 + k :]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        cover = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
        if own:
            first, n, at_bucket, m_first, m_n, p_at, p_of, p_size, w_edges = own
            np.add.at(cover, first, 1)
            np.add.at(cover, first + n - 1 + length, -1)
            hits = []
            for b in np.unique(at_bucket).tolist():
                f, k = m_first[at_bucket == b], m_n[at_bucket == b]
                at = np.repeat(f - (np.cumsum(k) - k), k) + np.arange(k.sum())
                hits.append(at[H.unpack_bits(answers[b], len(at))])
            begin = np.cumsum(p_size) - p_size
            flags = np.zeros(int(p_size.sum()), dtype=bool)
            for b in range(buckets):
                if w_edges[b + 1] > w_edges[b]:
                    s, e = int(begin[w_edges[b]]), int(begin[w_edges[b + 1] - 1] + p_size[w_edges[b + 1] - 1])
                    flags[s:e] = H.unpack_bits(answers[buckets + b], e - s)
            k = p_size[p_of]
            each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            hits.append((np.repeat(p_at, k) + each)[flags[np.repeat(begin[p_of], k) + each]])
            hit = np.concatenate(hits)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
        removed = np.cumsum(cover)[:-1] > 0
        rows, at = [], 0
        for doc, text in zip(docs_["doc_id"].to_pylist(), texts):
            rows.append(_row(doc, text, removed[at : at + len(text)]))
            at += len(text)
        return pa.Table.from_pylist(rows, schema=ARROW)

    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = packed(dealt)
    one = dealt.groupBy("block").applyInArrow(ask, ROWS).groupBy("bucket").applyInArrow(judged, ANSWERS)
    two = dealt.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(ask_again, ROWS).groupBy("bucket").applyInArrow(answered, ANSWERS)
    return dealt.groupBy("block").cogroup(two.groupBy("block")).applyInArrow(finish, OUT)


def pieces_of(joined: bytes, first: np.ndarray, n: np.ndarray, lead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Runs cut by distance to their anchor: each piece's start and number among the distinct ones; of those size, key, bytes and whether there are two.

    The strings of a piece begin `PIECE * k` to `PIECE * k + PIECE - 1` bytes before the anchor. A key is a
    hash of what all of them share; distinct pieces come in the order of keys.
    """
    seen: dict[tuple[int, bytes], int] = {}
    at, of, times = [], [], []
    for f, c, t in zip(first.tolist(), n.tolist(), lead.tolist()):
        for k in range((t - c + 1) // PIECE, t // PIECE + 1):
            high, low = min(t, PIECE * k + PIECE - 1), max(t - c + 1, PIECE * k)
            start, shared = f + t - high, f + t - PIECE * k
            key = xxhash.xxh3_64_intdigest(joined[shared : shared + length - PIECE + 1], seed=k)
            number = seen.setdefault((key, joined[start : start + high - low + length]), len(times))
            times += [0] * (number == len(times))
            times[number] += 1
            at.append(start)
            of.append(number)
    keys, pieces = np.array([k for k, _ in seen], dtype=np.uint64), [p for _, p in seen]
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    size = np.array([len(p) - length + 1 for p in pieces], dtype=np.int64)
    return np.array(at, dtype=np.int64), rank[np.array(of, dtype=np.int64)], size[order], keys[order], [pieces[i] for i in order], np.array(times, dtype=np.int64)[order] > 1


def _row(doc: int | None, text: memoryview, removed: np.ndarray) -> dict:
    edge = np.diff(removed.astype(np.int8), prepend=0, append=0)
    spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    kept = np.frombuffer(text, dtype=np.uint8)[~removed].tobytes() if spans else bytes(text)
    return {"doc_id": doc, "n_bytes": len(text), "n_removed": int(removed.sum()), "spans": spans, "kept": kept}


def op8(spark, sf_dir: str) -> DataFrame:
    out = repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
