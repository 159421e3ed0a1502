"""Chat formatting, quality rules, mixing, decontamination, language ID, LM scoring and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from spectraloom.llm import chat, decontam, hashing, langid, lm_score, mixing, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, m int, w int"


def table(spark, rows):
    """Documents with extra columns that are named like internal ones."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, 2) for i, t, lang, source in rows], SCHEMA)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, str(DATA)), c.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


# --- quality rules


def brute_measures(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "x y x y x y", "#*$% &|<>", "é \x0b ß\x1cq \x85z", "one\ntwo\none\n one\n\n", "\n".join(["same line here"] * 9), "word " * 3000, "ab" * 50_000, " ".join(f"w{i % 97} v{i}" for i in range(4000))]


def test_measures(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    m = quality.Measures(quality.words(F.col("text")), F.col("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    got = rows.select("id", *(m[n].alias(n) for n in names)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [brute_measures(t) for t in TEXTS]
    a = rows.select("id", quality.base_measures(quality.words(F.col("text")), F.col("text")).alias("m")).select("id", "m.*").orderBy("id").collect()
    assert [tuple(r[n] for n in names) for r in a] == [brute_measures(t) for t in TEXTS]
    own = rows.select("id", *(m[n].alias(n) for n in ("letter_entropy", "top_word", "n_ellipsis_lines", "n_bullet_lines"))).orderBy("id").collect()
    for r, t in zip(own, TEXTS):
        entropy, *rest = brute_own(t)
        assert (r["letter_entropy"] is None) == (entropy is None) and (entropy is None or abs(r["letter_entropy"] - entropy) < 1e-9) and list(r[3:]) == rest[1:]
        n, top = len(WORD.findall(t or "")), rest[0]
        assert r["top_word"] == top if 100 * top > 30 * n else 100 * r["top_word"] <= 30 * n


def brute_own(text):
    letters = Counter(re.findall("[a-z]", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")))
    z = sum(letters.values())
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    entropy = None if z < 100 else -sum(c / z * math.log2(c / z) for c in letters.values())
    return entropy, max(Counter(WORD.findall(text or "")).values(), default=0), sum(bool(re.search(r"(\.\.\.|\u2026)[ \t-\r]*$", x)) for x in lines), sum(bool(re.match(r"[ \t-\r]*[-*\u2022]", x)) for x in lines)


def brute_rejects(text):
    n, chars, symbols, lines, dup, rep = brute_measures(text)
    entropy, top, dots, bullets = brute_own(text)
    base = n < 50 or 100 * rep > 50 * n or 10 * symbols > n or chars < 3 * n or chars > 12 * n or 2 * dup > lines
    return base or (entropy is not None and entropy < 2.5) or 100 * top > 30 * n or 100 * dots > 30 * lines or 100 * bullets > 90 * lines


def test_quality_filter(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, t, None, None) for i, t in enumerate([*TEXTS, good, good + " # # # # # # # #", "\n".join([good] * 3), good.replace("word", "aaa"), good + " the" * 40, good.replace(" ", "...\n"), "- " + good, "- word\n" + good + "\n * x"])] + [(None, good, "en", "s"), (50, good, "en", "s")]
    out = quality.quality_filter(table(spark, rows), sample_rows=10)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((i, t) for i, t, *_ in rows if not brute_rejects(t))
    assert out.columns == table(spark, []).columns and quality.quality_filter(table(spark, [])).count() == 0
    assert {r.name for r in quality.ordered_rules(table(spark, rows))} == {r.name for r in quality.RULES}


def test_cascade_order_avoids_evaluations(spark):
    good = " ".join(f"word{i} of" for i in range(60))
    docs = table(spark, [(i, t, None, None) for i, t in enumerate([good] * 3 + ["too short"] * 5 + ["the " * 90] * 2)])
    few, top = (next(r for r in quality.RULES if r.name == n) for n in ("few_words", "top_word"))
    asked = {tuple(r.name for r in order): [(r["rule"], r["asked"], r["rejected"]) for r in quality.cascade_report(docs, order).orderBy("place").collect()] for order in ([few, top], [top, few])}
    assert asked["few_words", "top_word"] == [("few_words", 10, 5), ("top_word", 5, 5)]  # "of" is half of the good words
    assert asked["top_word", "few_words"] == [("top_word", 10, 10), ("few_words", 0, 0)]
    # what a rule would evaluate is never touched for rows that an earlier rule rejected
    broken = quality.Rule("broken", lambda m: F.when(m["n_words"] < 50, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(False))
    assert docs.where(quality.first_rejection(F.col("text"), [few, broken]).isNull()).count() == 5
    assert quality.cascade_report(table(spark, []), [few, top]).agg(F.sum("asked")).first()[0] == 0


def test_cascade_stops_at_the_first_rule(spark):
    rules = [quality.Rule("first", lambda m: F.lit(True)), quality.Rule("never", lambda m: F.raise_error(F.lit("evaluated")).cast("boolean"))]
    assert spark.range(3).select(quality.verdict({}, rules).alias("v")).distinct().first()["v"] == "first"
    assert spark.range(1).select(quality.verdict({}, []).alias("v")).first()["v"] is None


# --- chat


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "a<", "[INST", "<<SYS>>\n<</SYS>>", "<|user|>", "|>", "\\\\<|end|>", "", None, "é\n\n", "<<|>", "x" * 20_000]


def test_round_trip(spark):
    roles = ["system", "user", "assistant", "tool", "a|>b", None, ""]
    rows = [(1 + k % 9, k // 9, roles[k % len(roles)], NASTY[k % len(NASTY)]) for k in range(90)] + [(None, 0, "user", "x"), (50, None, "user", "hi"), (50, 0, "assistant", "yo"), (60, 1, "user", "same"), (60, 1, "user", "same")]
    got = {r["conv_id"]: r for r in chat.conversations_of(chat.format_chat(conversation(spark, rows))).withColumn("turns", chat.turns_of(F.col("formatted"))).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [tuple(t) for t in got[c]["turns"]] == [(r, t) for _, r, t in turns]
        assert got[c]["trained"] == "".join(t for _, r, t in turns if r == "assistant")
    assert chat.format_chat(conversation(spark, [])).count() == 0


@settings(max_examples=30, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet="<>/s[]INST\\|S Y\n", max_size=14), min_size=1, max_size=30))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    for r in rows.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.LLAMA.control)


def test_turn_order(spark):
    good, bad = ["system", "user", "assistant", "user", "assistant"], [["assistant"], ["user", "user", "assistant"], ["user"], ["system", "assistant"], ["user", "tool", "assistant"], ["user", "assistant", "system", "user", "assistant"]]
    rows = [(k, i, r, "t") for k, roles in enumerate([good, *bad]) for i, r in enumerate(roles)]
    got = chat.conversations_of(chat.format_chat(conversation(spark, rows))).orderBy("conv_id").collect()
    assert [r["valid"] for r in got] == [True] + [False] * len(bad)
    flags = chat.format_chat(conversation(spark, rows)).where("loss").select("role").distinct().collect()
    assert [r["role"] for r in flags] == ["assistant"]


def test_op5_of_the_planted_conversation(spark):
    r = queries.queries()["op5_chat_format"](spark, str(DATA)).where("conv_id = -7").first()
    own = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(own) and r["loss_sha256"] == hashlib.sha256(own.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()


# --- mixing


def sources(seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), "en", "big" if k % 3 else f"s{k % 5}") for k in range(600)]
    return [*rows, (None, "a b c", None, None), (7, rows[7][1], "en", rows[7][3]), (8, rows[8][1], "en", rows[8][3]), (1000, None, "en", "empty"), (1001, "", "en", "empty")]


def weights(tokens, a):
    p = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items() if t}
    return {s: v / sum(p.values()) for s, v in p.items()}


@pytest.mark.parametrize("m", [mixing.Mixture(blocks=16), mixing.Mixture(entropy=None, repeats=2.0, blocks=16), mixing.Mixture(entropy=0.99, repeats=100.0, budget=3000, blocks=8), mixing.Mixture(entropy=None, cover=True, blocks=16), mixing.Mixture(entropy=0.5, budget=0, blocks=4)])
def test_mixing(spark, m):
    rows = sources()
    out = mixing.mix_sources(table(spark, rows).withColumns({n: F.lit("own") for n in mixing.OUTPUTS}).withColumn("tokens", F.lit(1)), m)  # names that clash
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "m", "w", "tokens", *mixing.OUTPUTS]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    # the exponent, by plain bisection
    def budget(a):
        w = weights(tokens, a)
        return max(tokens[s] / w[s] for s in w) if m.cover else total if m.budget is None else m.budget

    def most(a):
        w = weights(tokens, a)
        return max(w[s] * budget(a) / tokens[s] for s in w)

    def smallest(fits):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high

    entropy = lambda a: -sum(v * math.log(v) for v in weights(tokens, a).values())
    a = smallest(lambda x: most(x) <= m.repeats)
    if m.entropy is not None:
        a = max(a, smallest(lambda x: entropy(x) < m.entropy * math.log(sum(t > 0 for t in tokens.values()))))
    w = weights(tokens, a)
    for s in tokens:
        own = [r for r in got if r["source"] == s]
        wanted = w.get(s, 0) * budget(a)
        drawn = sum(r["copies"] * r["n_tokens"] for r in own)
        longest = max(r["n_tokens"] for r in own)
        assert wanted - longest - 1 <= drawn <= wanted + 1, s
        # whole blocks first, in the permutation's order; only the block at the limit is cut
        ranks = sorted({(r["block_rank"], r["block"]) for r in own})
        assert len({b for _, b in ranks}) == len(ranks)
        by_rank = [sorted({r["copies"] for r in own if r["block_rank"] == k and r["n_tokens"]}) for k, _ in ranks]
        flat = [c for c in by_rank if c]
        assert sum(len(c) > 1 for c in flat) <= 1 and [max(c) for c in flat] == sorted((max(c) for c in flat), reverse=True)
    if m.cover:
        assert min(r["copies"] for r in got if r["source"] == max(tokens, key=tokens.get)) >= 1 and max(r["copies"] for r in got) <= m.repeats + 1
    assert mixing.mix_sources(table(spark, []), m).count() == 0


def test_repetition_limit_is_met_or_an_error(spark):
    rows = table(spark, sources())
    with pytest.raises(ValueError, match="more than 2 times"):
        mixing.mix_sources(rows, mixing.Mixture(entropy=None, repeats=2.0, budget=100_000))
    with pytest.raises(ValueError):
        mixing.mix_sources(rows, mixing.Mixture(entropy=None, repeats=0.5, cover=True))
    total = rows.select(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")))).first()[0]
    got = mixing.mix_sources(rows, mixing.Mixture(entropy=None, repeats=3.0, budget=3 * total)).agg(F.sum(F.col("copies") * F.col("n_tokens")), F.max("copies")).first()
    assert got[0] == 3 * total and got[1] == 3


def test_mixing_of_rows_without_id_and_of_a_long_text(spark):
    rows = [(None, f"w{i} " * 5, "en", "s") for i in range(200)] + [(1, "long " * 200_000, "en", "t"), (2, "x", "en", None)]
    out = mixing.mix_sources(table(spark, rows), mixing.Mixture(blocks=64)).collect()
    assert len(out) == 202 and len({r["block"] for r in out if r["doc_id"] is None}) > 20


# --- decontamination


def brute_leaks(docs, items, threshold=0.8, n=5):
    norm = lambda t: decontam.normal((t or "").encode()).split()
    bag = lambda w: Counter(tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1))
    out = set()
    for d, t in docs:
        w = norm(t)
        for k, x in items:
            y = norm(x)
            for i in range(len(w) - len(y) + 1) if y else []:
                a, b = bag(w[i : i + len(y)]), bag(y)
                if sum((a & b).values()) >= threshold * sum((a | b).values()) - 1e-9:
                    out.add((d, k))
    return out


def test_leaks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 3, 5, 6, 20, 40, 40, 64])] + [(90, None), (91, " ,. "), (92, "Rare WORDS, only!")]
    docs = []
    for i in range(60):
        body = rng.choices(words, k=rng.randint(0, 60))
        item = rng.choice(items)[1]
        if item and rng.random() < 0.7:
            leak = item.split()
            if len(leak) > 20 and rng.random() < 0.5:
                leak[rng.choice([0, -1])] = "other"  # still similar enough
            elif rng.random() < 0.3:
                leak[len(leak) // 2 :] = rng.choices(words, k=len(leak) - len(leak) // 2)
            body[len(body) // 2 : len(body) // 2] = leak
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "we RARE... words only -"), (5, docs[5][1])]
    d = table(spark, [(i, t, "en", "s") for i, t in docs])
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 20
    for size in (1 << 20, 200):  # in one broadcast and in several
        got = decontam.leaks(d, b, max_bytes=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    dirty = {i for i, _ in want}
    kept = decontam.decontaminate(d, b)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in dirty) and kept.columns == d.columns
    assert decontam.leaks(d, b.limit(0)).count() == 0 and decontam.leaks(d.limit(0), b).count() == 0


def test_leaks_near_the_threshold_with_repeated_shingles(spark):
    rng = random.Random(11)
    fresh = lambda k, tag: [f"{tag}{rng.random()}" for _ in range(k)]
    docs, items = [], []
    for k, (once, times) in enumerate([(89, 11), (54, 6), (89, 11), (60, 0), (9, 0)]):
        item = fresh(once, "a") + ["again"] * (times + 4 if times else 0)  # one shingle so many times, besides others
        items.append((k, " ".join(item)))
        for gone in range(16):
            leak = item[: len(item) - gone] + fresh(gone, "b")
            docs.append((100 * k + gone, " ".join(fresh(5, "c") + leak + fresh(5, "d"))))
    got = decontam.leaks(table(spark, [(i, t, "en", "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and 20 < len(want) < len(docs)


def test_leaks_of_truncated_items(spark):
    words = [f"u{i}" for i in range(100)]
    items = [(1, " ".join(words)), (2, "one two three four five six"), (3, "red green blue"), (4, " ".join(["again"] * 40 + words[:20]))]
    texts = [words[:95], words[5:], words[:85], words[:84], words[:80], "one two three four five".split(), "red green".split(), ["again"] * 30 + words[:20], ["again"] * 40]
    bag = lambda w, n=5: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want = {}
    for d, w in enumerate(texts):
        for k, t in items:
            a, b = bag(w), bag(t.split())
            if len(w) < len(t.split()) and sum((a & b).values()) >= 0.8 * sum((a | b).values()) > 0:
                want[d, k] = (0, len(w), sum((a & b).values()) / sum((a | b).values()))
    docs = table(spark, [(d, " ".join(w), "en", "s") for d, w in enumerate(texts)])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"]) for r in decontam.leaks(docs, b).collect() if r["n_words"] < 100}
    assert got == {k: (s, n, pytest.approx(q)) for k, (s, n, q) in want.items()} and {(0, 1), (1, 1), (7, 4)} <= set(want) and len(want) < 8
    assert not {0, 1, 7} & {r["doc_id"] for r in decontam.decontaminate(docs, b).collect()}


def test_best_window_counts_weighted_shares():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = int(rng.integers(5, 40)), int(rng.integers(1, 6))
        text, weight = rng.integers(0, 5, n), rng.integers(1, 4, 3)  # kinds 3 and 4 are not of the item
        hits = np.flatnonzero(text < 3)
        shares = [sum(min(int((text[s : s + m] == k).sum()), int(weight[k])) for k in range(3)) for s in range(n - m + 1)]
        got = decontam.best_window(hits, text[hits], weight, m, n)
        assert got == (max(shares), shares.index(max(shares)))


def test_multi_index_finds_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    stored = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    asked = stored[:50].copy()
    for i in range(50):
        for b in rng.choice(64, i % 20, replace=False).tolist():
            asked[i] ^= np.uint64(1 << b)
    for radius in (3, 15):
        i, j = decontam.MultiIndex(stored, radius).near(asked)
        want = {(a, b) for a in range(50) for b in range(200) if int(asked[a] ^ stored[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


# --- language ID


def test_language_id(spark):
    rng = random.Random(4)
    stems = {"aa": ["bla", "blo", "ka"], "ab": ["blu", "ble", "ka"], "zz": ["xyz", "qwx", "zzk"], "zy": ["xyq", "qwz", "zyk"]}
    rows = [(i, " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(rng.randint(2, 40))), lang, "s") for i in range(400) for lang in [list(stems)[i % 4]]]
    model = langid.train(table(spark, rows[:300]).select("doc_id", "text", "lang"))
    assert sorted(sorted(model.langs[i] for i in g) for g in model.groups) == [["aa", "ab"], ["zy", "zz"]]
    odd = [(900, None, None, None), (901, "", None, None), (902, "123 !?", None, None), (None, rows[0][1], None, None), (903, "ü", None, None), (904, rows[301][1] * 300, None, None)]
    got = langid.identify(table(spark, rows[300:] + odd), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 106 and sum(by[i]["lang_pred"] == lang for i, _, lang, _ in rows[300:]) >= 97
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert by[903]["lang_pred"] in stems and by[904]["lang_pred"] == rows[301][2] and all(0 <= r["score"] <= 1 for r in got)
    assert langid.train(table(spark, []).select("doc_id", "text", "lang")) is None
    assert langid.identify(table(spark, rows[:3]), None).select("lang_pred").distinct().first()["lang_pred"] == "und"


def test_votes_by_hand():
    """A slow reference for the two steps: the family by the greatest margin, then a duel of every pair in it."""
    import numpy as np

    rng = np.random.default_rng(5)
    groups, dims = [[0, 3, 4], [1], [2, 5]], 6
    pairs = {(a, b): rng.normal(size=dims + 1) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]}
    model = langid.Model(list("abcdef"), groups, rng.normal(size=(3, dims + 1)), pairs)
    x = rng.normal(size=(200, dims))
    got, score = model.predict(x)
    for row, lang, s in zip(x, got.tolist(), score.tolist()):
        margin = lambda w: float(row @ w[:-1] + w[-1])
        g = max(range(3), key=lambda k: margin(model.family[k]))
        votes = {a: 0 for a in groups[g]}
        total = {a: 0.0 for a in groups[g]}
        for (a, b), w in pairs.items():
            if a in votes:
                m = margin(w)
                votes[a if m > 0 else b] += 1
                total[a] += m
                total[b] -= m
        best = max(votes, key=lambda a: votes[a] + 1e-3 * math.tanh(total[a]))
        assert lang == best and 0 <= s <= 1


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_TOTAL", 6)
    rows = [(i, f"{c * 5} text {i}", lang, "s") for i, (c, lang) in enumerate([("a", "aa")] * 40 + [("b", "bb")] * 40 + [("c", "rare")] + [("d", f"l{k}") for k in range(6)])] + [(99, None, "void", "s"), (98, "x", None, "s")]
    model = langid.train(table(spark, rows).select("doc_id", "text", "lang"))
    assert set(model.langs) == {"aa", "bb", "rare", "void", *(f"l{k}" for k in range(6))}


def test_very_long_texts(spark):
    import numpy as np

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choices(words, k=330_000))  # several chunks
    assert len(long) > 2 * hashing.CHUNK
    item = " ".join(rng.choices(words, k=30))
    got = decontam.leaks(table(spark, [(1, long + " " + item, "en", "s"), (2, long, "en", "s")]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in got] == [(1, 7, 330_000, 1.0)]
    counts = np.zeros(langid.DIMS)
    data = long.encode()
    for n in langid.ORDERS:
        code = np.zeros(len(data) - n + 1, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + np.frombuffer(data, dtype=np.uint8)[k : len(data) - n + 1 + k] + np.uint64(1)
        counts += np.bincount((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).view(np.int64), minlength=langid.DIMS)
    assert np.allclose(langid.features(data), np.sqrt(counts / counts.sum()))
    rows = [(1, long, "en", "s"), (2, item, "en", "s")]
    got = lm_score.backoff_scores(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], round(r["log10_score"], 4) + 0.0, r["n_trigram"], r["n_bigram"], r["n_unigram"]) for r in got) == Counter({(i, n, round(x, 4) + 0.0, *more): c for (i, n, x, *more), c in brute_scores(rows).items()})


def test_batches_by_bytes():
    texts = [memoryview(b"x" * n) for n in (5, 3, 9, 0, 1, 20, 1)]
    assert hashing.by_bytes(texts, 10) == [(0, 2), (2, 5), (5, 6), (6, 7)] and hashing.by_bytes([]) == []


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_op7_held_out_accuracy(spark):
    d = str(DATA.parent / "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.queries()["op7_language_id"](spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


# --- LM scoring


def brute_scores(rows, least=2):
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    n = [Counter(tuple(w[i : i + k]) for _, w in docs for i in range(len(w) - k + 1)) for k in range(4)]
    total = sum(n[1].values())
    out = []
    for d, w in docs:
        score, used = 0.0, Counter()
        for i in range(len(w)):
            if i >= 2 and n[3][tuple(w[i - 2 : i + 1])] >= least:
                score += math.log10(n[3][tuple(w[i - 2 : i + 1])] / n[2][tuple(w[i - 2 : i])])
                used[3] += 1
            elif i >= 1 and n[2][tuple(w[i - 1 : i + 1])] >= least:
                score += math.log10(n[2][tuple(w[i - 1 : i + 1])] / n[1][(w[i - 1],)]) + (math.log10(0.4) if i >= 2 else 0)
                used[2] += 1
            else:
                score += math.log10(n[1][(w[i],)] / total) + min(i, 2) * math.log10(0.4)
                used[1] += 1
        out.append((d, len(w), round(score, 6) + 0.0, used[3], used[2], used[1]))
    return Counter(out)


@pytest.mark.parametrize("block,fan_out", [(200, 256), (1 << 20, 256), (60, 3)])
def test_backoff_scores(spark, block, fan_out):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("the a cat dog sat ran on mat".split(), k=rng.randint(0, 40))), "en", "s") for i in range(40)]
    rows += [(100, None, None, None), (101, " ", None, None), (None, "the cat", None, None), (3, rows[3][1], "en", "s"), (102, "rare", "en", "s")]
    got = lm_score.backoff_scores(table(spark, rows), block_bytes=block, fan_out=fan_out).collect()
    assert Counter((r["doc_id"], r["n_words"], round(r["log10_score"], 6) + 0.0, r["n_trigram"], r["n_bigram"], r["n_unigram"]) for r in got) == brute_scores(rows)
    assert lm_score.backoff_scores(table(spark, [])).count() == 0


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda n=120: " ".join(rng.choices(words, k=n))
    clean = {i: text() for i in range(30)}
    leak = text(20)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in clean.items()]
    rows += [(100, clean[0], "en", "s0"), (101, clean[1].upper(), "en", "s1")]  # copies
    rows += [(102, text(40) + " " + leak + " " + text(40), "en", "s1")]  # a leak
    rows += [(103, "too short", "en", "s1"), (104, "x # $ " * 100, "en", "s1"), (105, None, None, None), (None, text(), None, None)]
    rows += [(106, text() + "\nThis page 12 of our site", "en", "s2"), (107, text() + "\nThis page 9 of our site", "en", "s2")]
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert name == "source_mixing" or out.columns == list(corpus_pipeline.COLUMNS)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(clean) <= set(got) and {106, 107, None} <= set(got) and not {100, 101, 102, 103, 104, 105} & set(got)
    assert got[5]["text"] == clean[5] and got[106]["text"].endswith("site") and not got[107]["text"].endswith("site")
    assert got[107]["n_chars"] == len(got[107]["text"]) and all(1 <= r["copies"] <= 5 for r in got.values())
    whole = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r["copies"] for i, r in got.items()}


def test_pipeline_of_nothing(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
