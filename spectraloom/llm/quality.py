"""Quality rules as a short-circuit cascade: rules are ordered by rejection per cost, both estimated on a sample. DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import cut

SYMBOLS = "[#*$%&|<>]"  # fixed by the contract
BLANK, INK = "[ \\t-\\r]+", "[^ \\t-\\r]"  # the separators of the contract, \x20 and \x09-\x0D


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for `body`: a lambda variable is evaluated a single time per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, "")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(INK))


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def duplicate_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(w: Column) -> Column:
    """Of an array of words: those inside 3-word windows that it holds twice or more.

    Windows are compared by 64-bit hash within their own text. Only texts that do have an equal pair are sorted.
    """

    def windows(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(pairs, F.slice(h, 3, F.size(h)), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - 2, F.lit(0)))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda s, x: s + x)

    def marked(s: Column) -> Column:
        same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a["h"] == b["h"])
        return let(
            same,
            lambda e: F.sort_array(
                F.filter(
                    F.zip_with(s, F.zip_with(F.concat(F.array(F.lit(False)), e), F.concat(e, F.array(F.lit(False))), lambda a, b: a | b), lambda x, hit: F.when(hit, x["i"])),
                    lambda i: i.isNotNull(),
                )
            ),
        )

    def count(h3: Column) -> Column:
        ordered = F.sort_array(F.transform(h3, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h3)) == F.size(h3), F.lit(0)).otherwise(let(ordered, lambda s: let(marked(s), covered)))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count)).cast("long")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_entropy(text: Column) -> Column:
    """Entropy in bits of a text's letters a-z, upper case as lower; null if it has fewer than 100 of them."""

    def counts(t: Column) -> Column:
        return F.array(*(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in LETTERS))

    def entropy(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
        weighted = F.aggregate(n, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0))
        return let(total, lambda z: F.when(z >= 100, F.log2(z.cast("double")) - weighted / z))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), counts), entropy)


def top_word(w: Column, per_cent: int = 30) -> Column:
    """How often the most frequent word occurs, exact if that is more than `per_cent` of the words; else the count of some word.

    Among sorted hashes such a word covers one of every so many places, so that few candidates are counted.
    """

    def counted(h: Column) -> Column:
        step = F.greatest(F.floor(F.size(h) * per_cent / 100).cast("int"), F.lit(1))
        best = [F.size(h) - F.size(F.array_remove(h, F.get(h, step * k))) for k in range(100 // per_cent + 2)]
        return F.greatest(*(F.coalesce(b, F.lit(0)) for b in best), F.lit(0)).cast("long")

    return let(F.sort_array(F.transform(w, lambda x: F.xxhash64(x))), counted)


def lines_like(x: Column, pattern: str) -> Column:
    return F.size(F.filter(x, lambda v: v.rlike(pattern))).cast("long")


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text where `reject(measures)` is true; null counts as false."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


class Measures(dict):
    """Measures of a text as expressions, each built when a rule asks for it, so that a rule plans and evaluates only what it needs."""

    def __init__(self, w: Column, text: Column, **ready: Column):
        super().__init__(ready)
        self.w, self.text = w, text

    def __missing__(self, name: str) -> Column:
        self[name] = MEASURES[name](self.w, self.text)
        return self[name]


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda w, text: F.size(w).cast("long"),
    "word_chars": lambda w, text: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda w, text: symbol_count(text),
    "n_lines": lambda w, text: line_count(text),
    "n_dup_lines": lambda w, text: duplicate_lines(text),
    "n_repeat_words": lambda w, text: repeat_words(w),
    # what no output needs: only a rule that is asked evaluates these
    "letter_entropy": lambda w, text: letter_entropy(text),
    "top_word": lambda w, text: top_word(w),
    "n_ellipsis_lines": lambda w, text: lines_like(lines(text), "(\\.\\.\\.|\u2026)[ \\t-\\r]*$"),
    "n_bullet_lines": lambda w, text: lines_like(lines(text), "^[ \\t-\\r]*[-*\u2022]"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_measures(w: Column, text: Column) -> Column:
    """The measures BASE as one struct."""
    by_line = let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        by_line,
        lambda v: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), symbol_count(text).alias("n_symbols"),
            v["n_lines"].alias("n_lines"), v["n_dup_lines"].alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"),
        ),
    )


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < m["n_words"] * 3),
    Rule("long_words", lambda m: m["word_chars"] > m["n_words"] * 12),
    Rule("repeated_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"]),
    Rule("letter_entropy", lambda m: m["letter_entropy"] < 2.5),
    Rule("top_word", lambda m: m["top_word"] * 100 > m["n_words"] * 30),
    Rule("ellipsis_lines", lambda m: m["n_ellipsis_lines"] * 100 > m["n_lines"] * 30),
    Rule("bullet_lines", lambda m: m["n_bullet_lines"] * 100 > m["n_lines"] * 90),
)
SAMPLE_ROWS = 1000  # only the order of the rules depends on the sample, never a verdict


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejection per second, measured on at most `sample_rows` rows spread over the table.

    A rule's cost is what it takes beyond the split into words, which all rules share: the second
    of two runs of the same plan, in one task. Its rejection is its share of the sample. Equal ratios stay in the given order. Verdicts
    are the same in every order; only the work differs.
    """
    n = docs.count()
    if not n:
        return list(rules)
    sample = cut(docs.select("text").sample(min(1.0, sample_rows / n), seed=7).limit(sample_rows)).coalesce(1)

    def measured(tried: list[Rule]) -> tuple[float, float]:
        probe = sample.agg(F.avg(F.when(first_rejection(F.col("text"), tried).isNotNull(), 1.0).otherwise(0.0)))
        probe.collect()  # plans and compiles
        began = time.perf_counter()
        share = probe.collect()[0][0]
        return time.perf_counter() - began, share or 0.0

    idle = measured([Rule("split", lambda m: m["n_words"] < 0)])[0]
    gain = {}
    for rule in rules:
        took, share = measured([rule])
        gain[rule.name] = share / max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: -gain[r.name])


def verdict(m: dict[str, Column], rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules aren't evaluated once one has."""
    out = None
    for rule in rules:
        condition = F.coalesce(rule.reject(m), F.lit(False))
        out = F.when(condition, rule.name) if out is None else out.when(condition, rule.name)
    return F.lit(None).cast("string") if out is None else out


def first_rejection(text: Column, rules: list[Rule]) -> Column:
    """`verdict` of a text: it is split into words once, everything else is evaluated as rules ask for it."""
    return let(words(text), lambda w: verdict(Measures(w, text), rules))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of `docs` that no rule rejects, all columns kept whatever their names.

    A null or empty text has no words and fails `few_words`. Repeated rows are judged alike, each by its own
    text; an empty table stays empty. The order of the rules, and so no tie between them, changes a verdict.
    """
    return docs.where(first_rejection(F.col("text"), ordered_rules(docs, rules, sample_rows)).isNull())


def cascade_report(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(place, rule, asked, rejected): how many rows the cascade asks each rule about, and how many it rejects.

    rows - asked is the number of evaluations that the order avoids. One row for each rule.
    """
    hits = docs.select(F.coalesce(first_rejection(F.col("text"), rules), F.lit("")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    places = docs.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(rules)] + [(len(rules), "")], "place int, rule string")
    from_here = W.orderBy("place").rowsBetween(W.currentRow, W.unboundedFollowing)  # a row for each rule
    found = places.join(hits, "rule", "left").select("place", "rule", F.coalesce("n", F.lit(0)).alias("rejected"))
    return found.select("place", "rule", F.sum("rejected").over(from_here).alias("asked"), "rejected").where(F.col("place") < len(rules))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.col("text")
    base_rules = ("few_words", "repeated_words")
    rest = [r for r in ordered_rules(docs) if r.name not in base_rules]

    def judged(w: Column, b: Column) -> Column:
        m = Measures(w, text, **{n: b[n] for n in BASE})
        failed = verdict(m, [r for r in RULES if r.name in base_rules]).isNotNull()
        return let(failed, lambda f: F.struct(*(m[n].alias(n) for n in BASE), f.alias("base_failed"), F.when(f, False).otherwise(verdict(m, rest).isNull()).alias("kept")))

    out = docs.select("doc_id", let(words(text), lambda w: let(base_measures(w, text), lambda b: judged(w, b))).alias("m"))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "m.kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q WHERE n > 1) GROUP BY doc_id),
f AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL) GROUP BY doc_id),
e AS (SELECT doc_id, sum(n) AS z, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy
      FROM (SELECT doc_id, strlen(t) - strlen(replace(lower(t), c, '')) - (strlen(t) - strlen(lower(t))) AS n FROM d, (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c)) WHERE n > 0 GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
         coalesce(top, 0) AS top, z, entropy
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words
            OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines OR coalesce(z >= 100 AND entropy < 2.5, false)
            OR 100 * top > 30 * n_words OR 100 * n_ellipsis > 30 * n_lines OR 100 * n_bullets > 90 * n_lines) AS kept
FROM b
"""
