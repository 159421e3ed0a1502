"""Substring, suffix-array, line and near-duplicate removal against brute force, with nulls, ties, repeated rows and empty tables."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from spectraloom.llm import exchange, line_dedup, lm_score, simhash, suffix_array, substring_dedup
from spectraloom.llm import hashing as H
from spectraloom.llm.components import components

SCHEMA = "doc_id long, text string, block string, fp int"  # with columns named like internal ones


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    return [*rows, (100, None), (101, ""), (102, " \n"), (None, rows[3][1]), (None, None), (5, rows[5][1]), (5, rows[6][1]), (103, "ß" * 300), (104, "ß" * 300), (105, "a" * 5000)]


def brute_windows(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("size,block,fan_out", [(4, 300, 256), (13, 1 << 20, 256), (4, 100, 3)])
def test_repeated_windows(spark, size, block, fan_out):
    rows = corpus()
    got = substring_dedup.repeated_windows(table(spark, rows), window=size, block_bytes=block, fan_out=fan_out).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_windows(rows, size)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_exchange_rows_grow_with_the_blocks(spark):
    rng = np.random.default_rng(2)

    def rows_asked(blocks, fan_out=4):
        """Rows of all levels for so many blocks of 64 hashes and as many ranges."""
        cuts = exchange.levels(blocks, fan_out)
        assert max(cuts) <= fan_out and np.prod(cuts) >= blocks
        rows = []
        for b in range(blocks):
            h = np.unique(rng.integers(0, 1 << 64, 64, dtype=np.uint64))
            edges = H.bucket_edges(h, cuts[0])
            rows += [(b, k, H.pack_sorted(h[s:e]), b"") for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        asked = spark.createDataFrame(rows, exchange.ROWS).repartition(4).cache()
        told = exchange.answered(asked, lm_score.TOTALS, cuts, fan_out)
        assert told.count() == len(rows)
        n, at = len(rows), cuts[0]
        for finer in cuts[1:]:
            asked = exchange.merged(asked, lm_score.TOTALS, at, finer, fan_out).cache()
            n, at = n + asked.count(), at * finer
        return n, len(cuts)

    for blocks in (16, 32, 64):
        n, depth = rows_asked(blocks)
        assert n <= blocks * 4 * depth  # each level in proportion to the blocks, where blocks times ranges would be their square


def test_repeated_windows_of_nothing(spark):
    assert substring_dedup.repeated_windows(table(spark, [])).count() == 0
    assert substring_dedup.repeated_windows(table(spark, [(None, "a")])).count() == 1


def brute_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in raw for k in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, dtype=np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize("wide", [256, 1])
def test_repeated_bytes(spark, wide):
    rows = corpus(seed=8)
    got = suffix_array.repeated_bytes(table(spark, rows), length=120, block_bytes=2000, wide_group=wide).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == brute_bytes(rows, 120)


def test_repeated_bytes_of_texts_longer_than_a_step(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghijklmnop \n", k=suffix_array.STEP + 40_000))
    edge = long[suffix_array.STEP - 150 : suffix_array.STEP + 250]
    rows = [(1, long), (2, "xy" + edge + "z"), (3, long[-130:] + "\u00e9")]
    got = suffix_array.repeated_bytes(table(spark, rows), length=120).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == brute_bytes(rows, 120)


def test_repeated_bytes_of_nothing(spark):
    assert suffix_array.repeated_bytes(table(spark, [])).count() == 0
    assert suffix_array.repeated_bytes(table(spark, [(1, "short"), (1, None)])).count() == 2


@pytest.mark.parametrize("seed", range(25))
def test_prefix_free_parsing_kernel(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcdefgh \x00"
    parts = [bytes(rng.choices(letters, k=rng.randint(10, 90))) for _ in range(5)]
    members = [m for m in (b"".join(rng.choices(parts, k=rng.randint(2, 7)))[: rng.randint(50, 300)] for _ in range(20)) if len(m) >= 40]
    seen = Counter(m[i : i + 40] for m in members for i in range(len(m) - 39))
    want = [seen[m[i : i + 40]] > 1 for m in members for i in range(len(m) - 39)]
    assert suffix_array.repeated_starts(members, 40).tolist() == want


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rows = corpus(seed=3)
    rows += [(200 + k, " ".join([*(f"v{j}" for j in range(400)), *["tail"] * (k % 7)])) for k in range(40)]
    rows += [(300, "A B"), (301, "a b"), (302, "É b"), (303, "é b")]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    ids = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    want = Counter((i, f"{f:016x}", ids.get(r)) for (i, _), f, r in zip(rows, fps, roots))
    out = simhash.near_duplicates(table(spark, rows))
    got = out.select("doc_id", simhash.hex_digits(out["fp"]).alias("fp"), "component_id").collect()
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def brute_jaccard(a, b, size=5):
    def bag(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}

    return len(bag(a) & bag(b)) / len(bag(a) | bag(b))


def test_near_duplicates_are_dropped(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefghijklm" for b in "nopqrstuvwxyz"]
    base = [rng.choices(words, k=rng.randint(120, 400)) for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k, w in enumerate(base):
        for c in range(4):
            edited = list(w)
            for _ in range(1 + c):
                edited[rng.randrange(len(w))] = f"edit{k}{c}"
            rows.append((100 + 10 * k + c, " ".join(edited)))
    far = [(400 + i, " ".join(rng.choices(words, k=200))) for i in range(20)]
    rows += [*far, (500, rows[0][1].upper()), (501, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (502, None), (503, ""), (504, " \n"), (None, "alone in its group"), (505, "a b"), (506, "a b"), (507, " ".join(words * 400))]
    out = simhash.drop_near_duplicates(table(spark, rows))
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == ["doc_id", "text", "block", "fp"] and not kept - Counter(rows)
    left = dict(x for x in kept if x[0] is not None)
    for i, t in rows:
        if (i, t) not in kept:  # what goes has a kept text with a smaller id that is similar enough
            assert any(brute_jaccard(t, u) >= 0.8 and (i is None or j < i) for j, u in left.items())
    assert kept[1, rows[1][1]] == 2 and set(range(12)) <= set(left) and {i for i, _ in far} <= set(left)
    assert not {500, 501, 503, 504, 506} & set(left) and {502, 505, 507} <= set(left) and (None, rows[2][1]) not in kept and (None, "alone in its group") in kept
    similar = [(i, t) for i, t in rows if i is not None and 100 <= i < 400 and brute_jaccard(t, rows[(i - 100) // 10][1]) >= 0.8]
    assert len([1 for x in similar if x not in kept]) >= 0.7 * len(similar) and len(similar) > 20
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0


def test_every_pair_within_the_radius_meets_in_a_list():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    for fp in fps.tolist():
        other = fp
        for b in rng.choice(64, 3, replace=False).tolist():
            other ^= 1 << b
        assert any(all((fp ^ other) >> 8 * p & 255 == 0 for p in c) for c in simhash.INDEXED)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_only_tallied_pairs_are_verified(radius, monkeypatch):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    noise = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64), axis=1)
    fps = np.unique(base[rng.integers(0, 6, 300)] ^ noise)
    verified, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: verified.extend(x.tolist()) or count(x))
    want = {frozenset((a, b)) for a, b in combinations(fps.tolist(), 2) if (a ^ b).bit_count() <= radius}
    got = set()
    for c in simhash.INDEXED:
        mask = np.uint64(sum(0xFF << 8 * p for p in c))
        _, lists = np.unique(fps & mask, return_inverse=True)
        a, b = simhash.tallied_pairs(lists, np.full(len(fps), sum(1 << p for p in c), dtype=np.uint8), fps, radius)
        pairs = [frozenset(x) for x in zip(a.tolist(), b.tolist())]
        assert len(pairs) == len(set(pairs))  # each pair once in a list
        got |= set(pairs)
    shared = lambda x: sum((x >> 8 * p) & 255 == 0 for p in range(8))
    assert want and got == want and all(shared(x) >= 8 - radius for x in verified)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, depth=2, similarity=70, variants=3):
    """Recurring templates from all templates of all lines, spelled out as tuples."""

    def templates(line):
        w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        k, rest = len(w), max(len(w) - depth, 0)
        parts = min(rest, 7)
        enough = lambda t: 100 * sum(x not in (None, "<*>") for x in t) >= similarity * k
        place = [None] * min(depth, k) + [p for p in range(parts) for _ in range(rest * p // parts, rest * (p + 1) // parts)]
        out = [("whole", *w)] if w else []
        for i, j in combinations([*range(parts), None], 2) if parts else []:
            t = [None if p is not None and p in (i, j) else x for p, x in zip(place, w)]
            out += [(i, j, *t)] if enough(t) else []
        for i in range(min(depth, k)):
            t = [None if n == i else x for n, x in enumerate(w)]
            out += [("wild", i, *t)] if enough(t) else []
        return w, out

    where, kinds = {}, {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w, own = templates(line)
            for x in own if i is not None else []:
                where.setdefault(x, set()).add((i, n))
                kinds.setdefault(x, set()).add(tuple(w))
    recurs = {x: min(at) for x, at in where.items() if len({d for d, _ in at}) > 1 and (x[0] == "whole" or len(kinds[x]) >= variants)}
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = []
        for n, line in enumerate(lines):
            w, own = templates(line)
            # a line stands for all lines that are the same but for its fields
            first = min(where[own[0]]) if i is not None and own else None
            gone.append(i is not None and any(x in recurs and recurs[x] != ((i, n) if x[0] == "whole" else first) for x in own))
        out.append((i, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return Counter(out)


def dropped(spark, rows, **more):
    got = line_dedup.drop_recurring_lines(table(spark, rows), **more).collect()
    return Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got)


@pytest.mark.parametrize("more", [{}, {"depth": 1, "similarity": 50}, {"depth": 3, "variants": 2}])
def test_recurring_lines(spark, more):
    rng = random.Random(8)
    name = lambda: "".join(rng.choices("abcdef", k=5))
    kinds = ["Posted by {0} in {1} yesterday evening", "{0} likes this very much", "{0} {1} one two three", "Order 17 for {0} was sent on day 3 of May to {1} by our own carrier", "{0}  {1} {2} {2}", "Page 4 of {0} book ü", "", "short 7", "one two three four five"]
    rows = [(i, "\n".join(rng.choice(kinds).format(name(), name(), name()) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    rows += [(60, None), (61, ""), (None, rows[3][1]), (7, rows[7][1]), (8, rows[9][1]), (62, "Posted by x in y yesterday evening\nPosted by p in q yesterday evening"), (63, "word " * 20_000)]
    assert dropped(spark, rows, **more) == brute_lines(rows, **more)


def test_recurring_lines_of_nothing_and_clashing_columns(spark):
    clashing = table(spark, [(1, "one two"), (2, "one two")]).withColumnsRenamed({"block": "n_lines", "fp": "n_dropped"})
    got = line_dedup.drop_recurring_lines(clashing)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"] and [r["n_dropped"] for r in got.orderBy("doc_id").collect()] == [0, 1]
    assert line_dedup.drop_recurring_lines(table(spark, [])).columns == ["doc_id", "text", "block", "fp", "n_lines", "n_dropped"]
    assert line_dedup.drop_recurring_lines(table(spark, [])).count() == 0


def test_depth_and_similarity_decide(spark):
    people = [(i, f"User {n} logged in from {h} today once more") for i, (n, h) in enumerate(zip(["alice", "bob", "carol", "dan"], ["home", "work", "town", "sea"]))]
    gone = lambda **more: sum(n for *_, n in dropped(spark, people, **more))
    assert gone(depth=1, similarity=60) == 3  # name and place are open parts of the leaf
    assert gone(depth=2, similarity=60) == 0  # the name is a level of the tree
    assert gone(depth=1, similarity=90) == 0
    first = [(i, f"{n} has joined the group of readers") for i, n in enumerate(["Anna", "Ben", "Cleo", "Dana"])]
    assert sum(n for *_, n in dropped(spark, first)) == 3  # through the wildcard child


def test_fields_without_digits_are_found(spark):
    names, places = ["Anna", "Ben", "Cleo", "Dana"], ["Travel", "Food", "Music", "Sport"]
    rows = [(i, f"Text of its own {'abcd'[i] * 6}\nPosted by {n} in {p} yesterday evening") for i, (n, p) in enumerate(zip(names, places))]
    got = {i: t for i, t, *_ in dropped(spark, rows)}
    assert "Posted by Anna" in got[0] and not any("Posted" in got[i] for i in (1, 2, 3))


def test_short_lines_recur(spark):
    short = "All rights reserved.\nRead more\n17\n \nShare"
    got = {i: t for i, t, *_ in dropped(spark, [(i, f"{short}\nown{'x' * i} text") for i in (1, 2, 3)])}
    assert got[1] == f"{short}\nownx text" and got[2] == " \nownxx text" and got[3] == " \nownxxx text"
