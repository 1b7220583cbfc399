"""URL filters by a path-template tree, in DataFrame operations only.

Labels come from a rule list: a rule ``host/path`` fits that host and its
subdomains if the url's path starts with the rule's; the longest wins.  The
method judges the urls that no rule fits.

Tree.  Below each host a path is a run of segments whose digits are replaced
by ``#``; the first two segments are levels of their own, all that follows is
the third.  From the root down, a node with many different children for its
pages (``VARIETY`` of them at least, and more than one in ``FEW`` pages)
has its children generalised into the wildcard ``*``.  Then sibling
branches that look alike are merged: they have the same commonest
continuation and their smoothed share of blocked labels falls into the same
quarter; a branch without labels resembles only branches without labels.

Verdict.  A template's purity is blocked / (labelled + ALPHA): smoothing
adds ALPHA pages that are not blocked, so a template without labels, or with
a few, is kept.  It is rejected from ``PURITY`` on.

Only counts of distinct (host, shape) are aggregated and joined level by
level; a hot host is spread over its shapes, and the final join is keyed
by (host, shape).

Cases.  A null url, or one without ``://``, has an empty host and path, and
is judged like any other page.  Pages with equal urls get equal verdicts.
Ties between equally common continuations go to the smaller text.  An empty
table gives an empty result.  Other input columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import saved

# The rules of the registered query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))
VARIETY = 50
FEW = 4
ALPHA = 4.0
PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with ASCII letters lower-cased, and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def _rule(rules, column: int) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = r[0].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.lit(r[column])).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def template_tree(pages: DataFrame) -> DataFrame:
    """One row per (host, shape) of ``pages`` (host, path, blocked: 1, 0 or
    null) with its ``template`` and ``purity``."""
    parts = F.split(F.col("shape"), "/")
    leaf = (pages.groupBy("host", _shape(F.col("path")).alias("shape"))
            .agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
            .withColumns({"s1": F.coalesce(F.get(parts, 1), F.lit("")), "s2": F.coalesce(F.get(parts, 2), F.lit("")),
                          "s3": F.array_join(F.slice(parts, 4, 1_000_000), "/")}))
    t = saved(leaf, "url-shapes")                       # each level reads the one above twice: lineage is cut there
    above = ["host"]
    for k in (1, 2, 3):
        # variable segments
        kids = t.groupBy(*above, f"s{k}").agg(F.sum("n").alias("n"))
        wide = (kids.groupBy(*above).agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))
                .select(*above, ((F.col("kinds") >= VARIETY) & (F.col("kinds") * FEW > F.col("pages"))).alias("wild")))
        t = t.join(wide, above).withColumn(f"t{k}", F.when(F.col("wild"), F.lit("*")).otherwise(F.col(f"s{k}"))).drop("wild")
        # statistically similar branches
        if k < 3:
            rest = F.col(f"s{k + 1}")
            lean = t.groupBy(*above, f"t{k}", rest.alias("rest")).agg(
                F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
            look = lean.groupBy(*above, f"t{k}").agg(
                F.min(F.struct((-F.col("n")).alias("n"), "rest")).alias("most"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
            share = F.col("bad") / (F.col("labelled") + F.lit(ALPHA))
            look = look.select(*above, f"t{k}", F.col("most.rest").alias("rest"),
                               F.when(F.col("labelled") == 0, F.lit(-1)).otherwise(F.floor(share * 4)).cast("int").alias("quarter"))
            group = look.groupBy(*above, "rest", "quarter").agg(F.min(f"t{k}").alias("a"), F.count("*").alias("branches"))
            name = F.when(F.col("branches") > 1, F.concat(F.lit("{"), "a", F.lit(",..}"))).otherwise(F.col("a"))
            look = look.join(group, [*above, "rest", "quarter"]).select(*above, f"t{k}", name.alias(f"m{k}"))
            t = saved(t.join(look, [*above, f"t{k}"]), f"url-level-{k}")
        else:
            t = t.withColumn("m3", F.col("t3"))
        above = [*above, f"m{k}"]
    sums = t.groupBy(*above).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    sums = sums.select(*above, (F.col("bad") / (F.col("labelled") + F.lit(ALPHA))).alias("purity"))
    return (t.select("shape", *above).join(sums, above)
            .select("host", "shape", F.concat_ws("/", F.lit(""), "m1", "m2", "m3").alias("template"), "purity"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every page's host, path, rule, template, purity and verdict."""
    host, path = split_url(F.col("url"))
    rows = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("rule", _rule(rules, 0)).withColumn("told", _rule(rules, 1)))
    blocked = (F.col("told") == "block").cast("int").alias("blocked")
    tree = template_tree(rows.select("host", "path", blocked))
    verdict = F.coalesce("told", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return (rows.withColumn("shape", _shape(F.col("path"))).join(tree, ["host", "shape"])
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"))


def oracle(rules=RULES) -> str:
    """The same in DuckDB's SQL, over ``pages``."""
    def case(column: int) -> str:
        whens = []
        for r in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            host, _, path = r[0].partition("/")
            whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{r[column]}'")
        return "CASE " + " ".join(whens) + " END"

    ctes, above = [], ["host"]
    share = f"(CAST(bad AS DOUBLE) / (labelled + CAST({ALPHA} AS DOUBLE)))"
    for k in (1, 2, 3):
        on = ", ".join(above)
        ctes.append(f"""w{k} AS (SELECT {on}, count(*) >= {VARIETY} AND count(*) * {FEW} > sum(n) AS wild
  FROM (SELECT {on}, s{k}, sum(n) AS n FROM u{k - 1} GROUP BY ALL) GROUP BY {on}),
v{k} AS (SELECT u{k - 1}.*, CASE WHEN wild THEN '*' ELSE s{k} END AS t{k} FROM u{k - 1} JOIN w{k} USING ({on}))""")
        if k < 3:
            ctes.append(f"""l{k} AS (SELECT {on}, t{k}, rest, CASE WHEN labelled = 0 THEN -1 ELSE floor({share} * 4) END AS quarter FROM (
  SELECT {on}, t{k}, sum(labelled) AS labelled, sum(bad) AS bad, first(rest ORDER BY n DESC, rest) AS rest FROM (
    SELECT {on}, t{k}, s{k + 1} AS rest, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM v{k} GROUP BY ALL)
  GROUP BY {on}, t{k})),
g{k} AS (SELECT {on}, rest, quarter, CASE WHEN count(*) > 1 THEN '{{' || min(t{k}) || ',..}}' ELSE min(t{k}) END AS m{k} FROM l{k} GROUP BY {on}, rest, quarter),
u{k} AS (SELECT v{k}.*, m{k} FROM v{k} JOIN l{k} USING ({on}, t{k}) JOIN g{k} USING ({on}, rest, quarter))""")
        else:
            ctes.append("u3 AS (SELECT *, t3 AS m3 FROM v3)")
        above.append(f"m{k}")
    on = ", ".join(above)
    return f"""
WITH a AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
r AS (SELECT *, {case(0)} AS rule, {case(1)} AS told, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM a),
f AS (SELECT host, shape, count(*) AS n, count(told) AS labelled, count(*) FILTER (told = 'block') AS bad, string_split(shape, '/') AS p FROM r GROUP BY host, shape),
u0 AS (SELECT *, coalesce(p[2], '') AS s1, coalesce(p[3], '') AS s2, coalesce(array_to_string(p[4:], '/'), '') AS s3 FROM f),
{", ".join(ctes)},
s AS (SELECT {on}, {share} AS purity FROM (SELECT {on}, sum(labelled) AS labelled, sum(bad) AS bad FROM u3 GROUP BY ALL))
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || m1 || '/' || m2 || '/' || m3 AS template, purity
FROM r JOIN u3 USING (host, shape) JOIN s USING ({on})"""
