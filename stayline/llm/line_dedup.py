"""Line de-duplication over a suffix array of line-ID sequences, in DataFrame
operations only.

A document is the sequence of its lines that are not blank; line breaks are
``\\n``, and lines are compared without blanks at their ends.  Documents are
ordered by id (null last), then text hash.  A stretch of lines is a later
copy if an equal stretch starts earlier: in an earlier document, or earlier in
the same.  Deleted are all lines of later copies of stretches of ``MIN_LINES``
lines or more, and single lines of ``LONG_WORDS`` words or more that are later
copies; shorter lone lines (headings, "yes", closing brackets) stay.  Stretches are judged on the input, so overlaps count.

Suffix array.  A line's id is its rank among the distinct repeated lines.
Prefix doubling then ranks suffixes by their first 2, 4, 8, ... lines: the
pair (rank at a line, rank ``k`` lines further on) is counted, pairs that occur
once leave the array (they share no longer prefix with any neighbour), and
the others get new ranks in the order of the pair.  A rank's members are the
interval of the suffix array whose adjacent common prefixes have that many
lines at least.  Doubling ends when no interval is left; ``longest`` is the
length known to be shared by a document's most repeated suffix.

Ranks are row ids of a range-sorted table of distinct pairs, so no task sees a
whole group; a line that a third of all documents share is one row of that
table, pre-counted before the shuffle, and joins back skew-aware.

Cases.  Null and empty texts have no lines and keep an empty text.  Rows that
agree in id and text are one document: they are judged once and get equal
results.  Ties in order can't remain then.  Blank lines are kept as they
are.  An empty table gives an empty result.  Other input columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.common import saved

MIN_LINES = 2          # a power of two
LONG_WORDS = 5         # as a shingle of the other operators
MAX_ROUNDS = 40
SALTS = 8


def _ranked(keys: DataFrame, order: list, name: str) -> DataFrame:
    """Distinct keys with an order-preserving ``rank``, written once so that
    the row ids stay."""
    return saved(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """Of (doc_id, key, pos, a, b, words) with the line hash (a, b): for 1, 2,
    4, ... lines the rows (doc_id, key, pos, words, rank) whose prefix of that
    length is shared."""
    keys = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    ranks = _ranked(keys, ["a", "b"], "line-ranks")
    active = saved(lines.join(ranks, ["a", "b"]).select("doc_id", "key", "pos", "words", "rank"), "suffixes-1")
    out, k = [(1, active)], 1
    doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    for _ in range(MAX_ROUNDS):
        pairs = active.withColumn("next", F.max("rank").over(doc.rangeBetween(k, k))).where("next is not null")
        keys = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next")
        ranks = _ranked(keys.withColumnRenamed("rank", "old"), ["old", "next"], f"ranks-{2 * k}")
        if ranks.isEmpty():
            break
        active = (pairs.withColumnRenamed("rank", "old").join(ranks, ["old", "next"])
                  .select("doc_id", "key", "pos", "words", "rank"))
        active, k = saved(active, f"suffixes-{2 * k}"), 2 * k
        out.append((k, active))
    return out


def _later(suffixes: DataFrame) -> DataFrame:
    """The members of every interval but the first in document order.  The
    first ones are joined back in ``SALTS`` parts, so a hot interval's members
    are spread."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "pos")
    first = suffixes.groupBy("rank").agg(F.min(place).alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = suffixes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "pos"), F.lit(SALTS)).cast("int"))
    return salted.join(first, ["rank", "salt"]).where(place != F.col("first")).drop("first", "salt")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per distinct document with later copies: ``doc_id``, ``key`` (hash of the
    text), ``gone`` (deleted line numbers, sorted) and ``longest``."""
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    split = docs.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    text = F.trim("raw")
    lines = (split.where(text != "").select("doc_id", "key", "line", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
                                            F.size(F.split(text, "[ \t]+")).alias("words")).distinct())
    w = Window.partitionBy("doc_id", "key").orderBy("line")
    lines = saved(lines.withColumn("pos", F.row_number().over(w)), "lines")
    levels = suffix_ranks(lines)
    gone = _later(levels[0][1]).where(F.col("words") >= long_words).select("doc_id", "key", "pos")
    for k, suffixes in levels:
        if k == min_lines:
            runs = _later(suffixes)
            gone = gone.unionByName(runs.select("doc_id", "key", F.explode(F.sequence("pos", F.col("pos") + (k - 1))).alias("pos")))
    if min_lines == 1:
        gone = _later(levels[0][1]).select("doc_id", "key", "pos")
    longest = None
    for k, suffixes in levels:
        one = suffixes.select("doc_id", "key", F.lit(k).alias("k"))
        longest = one if longest is None else longest.unionByName(one)
    longest = longest.groupBy("doc_id", "key").agg(F.max("k").alias("longest"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    at = gone.distinct().alias("g").join(lines.alias("l"), same("g", "l") & (F.col("g.pos") == F.col("l.pos"))).select("l.doc_id", "l.key", "l.line")
    at = at.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    return at.alias("a").join(longest.alias("m"), same("a", "m")).select("a.doc_id", "a.key", "gone", "longest")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text`` without the deleted
    lines, ``n_lines`` (all lines), ``n_deleted``, ``n_runs`` (maximal stretches
    of consecutive deleted lines) and ``longest``."""
    found = repeated_lines(docs.select("doc_id", "text"), min_lines, long_words).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "gone", "longest")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    none = F.array().cast("array<int>")

    def cut(args):
        kept = F.array_except(F.sequence(F.lit(0), F.size(args["lines"]) - 1), args["gone"])
        return F.array_join(F.transform(kept, lambda i: F.get(args["lines"], i)), "\n")

    args = F.struct(F.split("text", "\n").alias("lines"), "gone")
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(F.transform(F.array(args), cut), 0))
    gone = F.coalesce("gone", none)
    runs = F.size(F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1)))
    return both.select("doc_id", text.alias("text"),
                       F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0)
                       .otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n_lines"),
                       F.size(gone).alias("n_deleted"), runs.alias("n_runs"), F.coalesce("longest", F.lit(0)).alias("longest"))


def oracle(long_words: int = LONG_WORDS) -> str:
    """The same in DuckDB's SQL for stretches of two lines, without ``longest``."""
    return rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, i - 1 AS line, trim(x, ' ') AS x FROM
  (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
n AS (SELECT *, lead(x) OVER w AS y, lead(line) OVER w AS next FROM l WHERE x <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY line)),
o AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, text, line) AS one,
  row_number() OVER (PARTITION BY x, y ORDER BY doc_id NULLS LAST, text, line) AS two, len(regexp_split_to_array(x, '[ \t]+')) AS words FROM n),
g AS (SELECT doc_id, text, line FROM o WHERE one > 1 AND words >= {long_words}
  UNION SELECT doc_id, text, line FROM o WHERE two > 1 AND y IS NOT NULL
  UNION SELECT doc_id, text, next FROM o WHERE two > 1 AND y IS NOT NULL),
k AS (SELECT l.doc_id, l.text, count(g.line) AS n_deleted,
  count(*) FILTER (g.line IS NOT NULL AND before IS NULL) AS n_runs
  FROM (SELECT a.*, b.line AS before FROM l a LEFT JOIN g b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND b.line = a.line - 1) l
  LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.text = l.text AND g.line = l.line GROUP BY ALL),
r AS (SELECT a.doc_id, a.text, string_agg(a.raw, chr(10) ORDER BY a.line) AS kept FROM
  (SELECT doc_id, text, i - 1 AS line, raw FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)) a
  ANTI JOIN g ON g.doc_id IS NOT DISTINCT FROM a.doc_id AND g.text = a.text AND g.line = a.line GROUP BY ALL)
SELECT t.doc_id, CAST(CASE WHEN coalesce(t.text, '') = '' THEN 0 ELSE len(string_split(t.text, chr(10))) END AS INTEGER) AS n_lines,
  CAST(coalesce(k.n_deleted, 0) AS INTEGER) AS n_deleted, CAST(coalesce(k.n_runs, 0) AS INTEGER) AS n_runs, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents t LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM t.doc_id AND k.text = t.text
LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.text = t.text"""
