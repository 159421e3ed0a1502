"""Line dedup by a log-template tree: token count, leading tokens, then templates in the leaf with variable fields as <*>.

The tree has a fixed depth. Level 1 is a line's token count, the next `depth` levels are its leading
tokens; a token with a digit is a variable field on every level. A line also goes to the wildcard child
of one level, the other levels literal, so that a line may begin with a field. A leaf merges lines by
token similarity: what stands after the leading tokens is cut into at most PARTS contiguous parts, and
a template leaves one or two of them open if enough literal tokens stay. Unlike a parser that reads
lines one by one, this depends on no order, so leaves need not be whole in any task: lines, templates
and documents are counted by key, which combines before the shuffle, and no two lines are compared.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import INK, let, words
from .runtime import cut, sized

FIELD = "<*>"
PARTS = 7
GROUPS = 3  # two open parts leave one of so many groups of parts as it is
KEY = ["n_tokens", "k1", "k2"]


def parsed(lines: DataFrame, depth: int) -> DataFrame:
    """`lines` with n_tokens, k1, k2, shape and literals in place of `line`; each line has a token.

    k1 and k2 are two hashes of the whole line with fields as <*>; shape has a hash for each of the `depth`
    leading tokens and for each part of the rest, whatever it is where there is none; literals counts the
    tokens without a digit in each of these, null if no token has a digit. Each step is a projection of its
    own, so that a line is split once and the rest is compiled.
    """
    rest = [c for c in lines.columns if c != "line"]
    split = lines.select(*rest, F.col("line").rlike("[0-9]").alias("has_digit"), words(F.col("line")).alias("w"))
    masked = F.transform("w", lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    split = split.select(*rest, "has_digit", F.when(F.col("has_digit"), masked).otherwise(F.col("w")).alias("m"))
    split = split.select(*rest, "has_digit", "m", F.size("m").alias("n_tokens"), F.array_join("m", " ").alias("whole"))
    r = F.greatest(F.col("n_tokens") - depth, F.lit(0))
    p = F.least(r, F.lit(PARTS))
    lead = [F.get("m", F.lit(i)) for i in range(depth)]
    edge = lambda i: F.floor(F.lit(i) * r / p).cast("int")
    part = [F.when(p > i, F.slice("m", edge(i) + (depth + 1), edge(i + 1) - edge(i))) for i in range(PARTS)]
    literal = lambda x: F.coalesce(F.size(F.filter(x, lambda t: t != FIELD)), F.lit(0))
    counts = F.array(*(F.coalesce((t != FIELD).cast("int"), F.lit(0)) for t in lead), *(literal(x) for x in part))
    shape = F.array(*(F.hash(t) for t in lead), *(F.hash(x) for x in part))
    return split.select(*rest, "n_tokens", F.xxhash64("whole").alias("k1"), F.xxhash64(F.lit(1), "whole").alias("k2"), shape.alias("shape"), F.when(F.col("has_digit"), counts).alias("literals"))


class Shape:
    """Keys of the leaf groups and templates of a parsed line; the columns n_tokens, shape and literals are at hand."""

    def __init__(self, depth: int, similarity: int):
        self.depth, self.similarity = depth, similarity
        self.n = F.col("n_tokens")
        self.rest = F.greatest(self.n - depth, F.lit(0))
        self.parts = F.least(self.rest, F.lit(PARTS))
        self.lead = [F.get("shape", F.lit(i)) for i in range(depth)]
        self.part = [F.get("shape", F.lit(depth + i)) for i in range(PARTS)]
        self.all_literals = F.coalesce(F.aggregate("literals", F.lit(0), lambda a, b: a + b), self.n)

    def literals(self, i: int) -> Column:
        """Literal tokens of part i, or of a leading token (i below 0)."""
        edge = lambda k: F.floor(F.lit(k) * self.rest / self.parts).cast("int")
        plain = F.lit(1) if i < 0 else edge(i + 1) - edge(i)
        return F.coalesce(F.get("literals", F.lit(self.depth + i)), plain)

    def enough(self, left: Column) -> Column:
        return left * 100 >= self.n * self.similarity

    def wildcards(self) -> list[Column]:
        """Templates below the wildcard child of one level: that leading token is open, all else is fixed."""
        out = []
        for i in range(self.depth):
            key = F.xxhash64(self.n, F.lit(-1), F.lit(i), *(x for k, x in enumerate(self.lead) if k != i), *self.part)
            out.append(F.when((self.n > i) & self.enough(self.all_literals - self.literals(i - self.depth)), key))
        return out

    def groups(self) -> list[Column]:
        """Keys such that the lines of a template share one of them at least.

        Of the groups into which the parts are cut, two open parts leave one as it is.
        """
        return [*(F.xxhash64(self.n, F.lit(-2), F.lit(g), *self.lead, *self.part[g::GROUPS]) for g in range(GROUPS)), *self.wildcards()]

    def templates(self) -> list[Column]:
        """The wildcard templates, and those with one or two open parts that the line has in its leaf."""
        out = self.wildcards()
        for i, j in combinations_with_replacement(range(PARTS), 2):
            left = self.all_literals - self.literals(i) - (self.literals(j) if j > i else 0)
            key = F.xxhash64(self.n, F.lit(i), F.lit(j), *self.lead, *(x for k, x in enumerate(self.part) if k not in (i, j)))
            out.append(F.when((self.parts > j) & self.enough(left), key))
        return out


def each(df: DataFrame, columns: list[str], keys: list[Column], name: str) -> DataFrame:
    """A row for each key that is not null."""
    return df.select(*columns, F.explode(F.array(*keys)).alias(name)).where(F.col(name).isNotNull())


def drop_recurring_lines(docs: DataFrame, depth: int = 2, similarity: int = 70, variants: int = 3) -> DataFrame:
    """All rows and columns of `docs`; `text` without lines whose template recurs across documents, and n_lines, n_dropped.

    Lines are the parts between line feeds; a line without a word has no template. A line's templates are
    the whole line with tokens that have digits as <*>, and those of its leaf (see the module) that keep
    `similarity` per cent of its tokens as literals. A template recurs if two documents or more have a
    line of it and, if it has open parts, at least `variants` different lines (2 or more; two that differ
    are no evidence of a field). A line that has a recurring template and is not the first line of it
    (smallest doc_id, then earliest) goes. Kept lines are joined by line feeds again. `depth` is 1 or more.

    Null text stays null (no line). A null doc_id is no document to others: its lines are kept and make no
    template recur. Rows that share a doc_id count as one document; equal rows lose the same lines, and ties
    (the same line number of the same doc_id) are both first. If all lines go, the text is empty and the
    row stays. An empty table stays empty. Columns n_lines and n_dropped of `docs` are replaced; other
    columns may have any name but one that begins with __line.

    A leaf, template or line may hold a third of all lines: groups are only counted, and the joins are one
    to many between tables that were written, so Spark splits their hot keys. Templates are made only of
    lines that meet another line in a group of parts of their leaf, and equal lines are one row by then.
    Whole lines are told apart by 128 bits of hashes, templates by 64 bits over 32-bit hashes of their parts.
    """
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.withColumn("__line_text", F.xxhash64("text"))
    line = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "__line_text", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").rlike(INK))
    # lines are parsed once: what follows reads the hashes that were written
    node = cut(parsed(line, depth))
    shape = Shape(depth, similarity)
    ends = [F.min(F.struct("doc_id", "n")).alias("first"), F.max("doc_id").alias("last")]
    exact = node.groupBy(*KEY).agg(*ends).where(F.col("first.doc_id") < F.col("last")).select(*KEY, "first", F.lit(False).alias("all"))
    # only lines that meet another one in a group can have a recurring template with open parts
    groups = each(node, KEY, shape.groups(), "g")
    shared = sized(groups.groupBy("g").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("g"))
    met = sized(groups.join(shared, "g", "left_semi").select(*KEY).distinct())
    some = node.join(met, KEY, "left_semi").groupBy(*KEY).agg(*ends, F.first(F.struct("shape", "literals")).alias("s")).select(*KEY, "first", "last", "s.*")
    templates = cut(each(some, [*KEY, "first", "last"], shape.templates(), "t"))
    counted = templates.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("first").alias("t_first"), F.max("last").alias("t_last"))
    recurring = sized(counted.where((F.col("c") >= variants) & (F.col("t_first.doc_id") < F.col("t_last"))).select("t", "t_first"))
    open_ones = templates.join(recurring, "t").where(F.col("first") != F.col("t_first")).select(*KEY, "first", F.lit(True).alias("all"))
    # its own shuffle in the join, which lets Spark split hot keys
    judged = cut(exact.unionByName(open_ones).groupBy(*KEY).agg(F.min("first").alias("first"), F.max("all").alias("all")))
    gone = node.select("doc_id", "__line_text", "n", *KEY).join(judged, KEY).where(F.col("all") | (F.struct("doc_id", "n") != F.col("first")))
    by_doc = gone.groupBy("doc_id", "__line_text").agg(F.collect_set("n").alias("__line_gone")).withColumnsRenamed({"doc_id": "__line_doc", "__line_text": "__line_hash"})
    return without(keyed, by_doc)


def without(keyed: DataFrame, by_doc: DataFrame) -> DataFrame:
    """Documents, keyed by doc_id and __line_text, without the lines whose numbers by_doc has in __line_gone."""
    joined = keyed.join(by_doc, (F.col("doc_id") == F.col("__line_doc")) & (F.col("__line_text") == F.col("__line_hash")), "left")
    # line numbers come in any order; a sorted list and one pass cut them out
    gone_sorted = F.sort_array("__line_gone")
    kept = F.array_join(F.filter(let_cut(F.split("text", "\n"), gone_sorted), lambda x: x.isNotNull()), "\n")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    out = joined.withColumns({"__line_kept": F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(kept), "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long"), "n_dropped": F.coalesce(F.when(F.col("__line_gone").isNull(), F.lit(0)).otherwise(F.size("__line_gone")), F.lit(0)).cast("long")})
    return out.withColumn("text", F.col("__line_kept")).drop("__line_text", "__line_doc", "__line_hash", "__line_gone", "__line_kept")


def let_cut(lines: Column, gone: Column) -> Column:
    """Lines without those whose numbers are in the ascending array `gone`."""
    # between two removed lines stands a run of kept ones: slices joined in order need no search per line
    def runs(g: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(g, lambda x: x + 1))
        ends = F.concat(g, F.array(F.lit(2147483647)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(lines, lambda t: F.flatten(F.transform(let(gone, runs), lambda s: F.slice(t, s["a"] + 1, F.greatest(F.least(s["b"], F.size(t)) - s["a"], F.lit(0))))))


def op3(spark, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS n FROM s),
w AS (SELECT doc_id, line, n, list_filter(string_split(translate(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws FROM l),
m AS (SELECT doc_id, line, n, list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM w),
v AS (SELECT m, min((doc_id, n)) AS f, max(doc_id) AS last, len(m) AS k, m[1 : 2] AS lead, m[3 :] AS rest, greatest(len(m) - 2, 0) AS r, least(greatest(len(m) - 2, 0), 7) AS p,
  len(list_filter(m, lambda x: x <> '<*>')) AS literals FROM m WHERE len(m) > 0 GROUP BY m),
q AS (SELECT *, list_transform(range(0, p), lambda i: rest[(i * r) // p + 1 : ((i + 1) * r) // p]) AS parts FROM v),
o AS (SELECT a.i, b.j FROM (SELECT unnest(range(0, 7)) AS i) a, (SELECT unnest(range(0, 7)) AS j) b WHERE a.i <= b.j),
t AS (
  SELECT m, f, last, (k, 'leaf', i, j, lead, list_transform(range(0, p), lambda x: CASE WHEN x = i OR x = j THEN NULL ELSE parts[x + 1] END)) AS t FROM q JOIN o ON j < p
  WHERE 100 * (literals - len(list_filter(parts[i + 1], lambda x: x <> '<*>')) - CASE WHEN j > i THEN len(list_filter(parts[j + 1], lambda x: x <> '<*>')) ELSE 0 END) >= 70 * k
  UNION ALL
  SELECT m, f, last, (k, 'wild', i, 0, list_transform(range(0, len(lead)), lambda x: CASE WHEN x = i THEN NULL ELSE lead[x + 1] END), parts) AS t FROM q JOIN (SELECT unnest(range(0, 2)) AS i) a ON i < len(lead)
  WHERE 100 * (literals - CASE WHEN lead[i + 1] <> '<*>' THEN 1 ELSE 0 END) >= 70 * k),
r AS (SELECT t, min(f) AS tf FROM t GROUP BY t HAVING count(*) >= 3 AND min(f)[1] < max(last)),
g AS (SELECT DISTINCT m FROM t JOIN r USING (t) WHERE f <> tf),
j AS (SELECT v.m, f, v.m IN (SELECT m FROM g) AS all_go FROM v WHERE f[1] < last OR v.m IN (SELECT m FROM g)),
k AS (SELECT m.*, j.m IS NOT NULL AND (all_go OR (doc_id, n) <> f) AS gone FROM m LEFT JOIN j USING (m))
SELECT d.doc_id, count(k.n) AS n_lines, count(k.n) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.n) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""
