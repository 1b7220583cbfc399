"""Benchmark decontamination by template canonicalisation, in DataFrame
operations only.

Words are runs of letters or one number.  In a template a number becomes
``#``, a unit after a number ``~``, a capitalised word inside a sentence ``@``,
any other word its lower case.  Every run of ``WINDOW`` template words of a
document is hash-joined with those of the benchmark items, whole texts on both
sides; so a question is found although its numbers and names were changed.

Matches of a document and an item are counted per alignment (document
position less item position).  An alignment counts if it covers
``LEAST`` windows, or half of a shorter item's.  Then its slots are checked:
each typed placeholder of the item must always be replaced by the same value of
the document; ``CONSISTENT`` of the slots at least have to agree with the
commonest replacement.  Templates that only share their form fail here.

Renamed items.  A second search takes every run of capitalised words, wherever
it stands, for one ``@``, on both sides; so names that open a sentence, follow a
quote or newline, or have more words than the item's are found too.  Windows of
alignments up to ``SLIP`` apart count together, each word of the item with its
nearest one.  Names and numbers have to agree by ``CONSISTENT`` each; names that
nowhere change don't count.  It adds the pairs that the first search lacks.

The windows of the benchmark are broadcast only if their counted size is
below ``BROADCAST_BYTES``; else they are joined by a shuffle.

Cases.  An item with fewer than ``WINDOW`` template words is matched by one
window of all its words; with fewer than ``SHORTEST`` it isn't searched.
Null and empty texts match nothing.  Documents that agree in id and text are
judged once.  Items are told apart by id and text, so an item without an id
is searched too, and of several texts with one id the best match is reported.
Other input columns, of whatever name, are ignored (``clean`` keeps them).
Texts of any length are searched whole.  The slots of every alignment that counts are checked; of those
that pass, the one with most windows is reported, then the smallest.  An empty
documents or benchmark table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import saved

WINDOW = 8
SHORTEST = 5
LEAST = 5
CONSISTENT = 0.8
SLIP = 2
BROADCAST_BYTES = 64_000_000
# Units that are typed after a number.
UNITS = ("kg g mg lb oz km m cm mm mi ft in l ml mph kmh s sec min h hr hours hour minutes minute seconds second days day weeks "
         "week months month years year miles mile meters metres feet inches dollars dollar euros euro cents percent pounds grams "
         "degrees c f w kw v").split()
UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
NAME = r"([\p{Ll}\p{N},;:] )(\p{Lu})"
NAMED = r"(?<=[\p{Ll}\p{N},;:]) \p{Lu}\p{L}*+"                # the same as one word that keeps its blank
AFTER = rf"(\p{{N}} ?)((?:{UNIT})(?:[^\p{{L}}]|$))"
TOKEN = r"[@~]?\p{L}+|\p{N}+(?:[.,]\p{N}+)*"
RUN = r"\p{Lu}\p{L}*+(?:[ .'’-]{1,2}\p{Lu}\p{L}*+)*+"          # possessive: a loop, not a recursion as deep as the run


def _units(text: Column) -> Column:
    """The text with ``~`` before units; most texts have none and stay as they are."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(AFTER), F.regexp_replace(text, AFTER, "$1~$2")).otherwise(text)


def words(text: Column) -> Column:
    """The words of a text, names marked by a leading blank and units by ``~``."""
    return F.regexp_extract_all(_units(text), F.lit(f"{NAMED}|{TOKEN}"), F.lit(0))


def name_runs(text: Column) -> Column:
    """The words of a text, with a run of capitalised words as one."""
    return F.regexp_extract_all(_units(text), F.lit(f"{RUN}|{TOKEN}"), F.lit(0))


def name_template_word(word: Column) -> Column:
    head = F.substring(word, 1, 1)                   # plain letters first: most words need no pattern
    return F.when(head.between("a", "z"), F.lower(word)).when(head.between("A", "Z") | word.rlike(r"^\p{Lu}"), "@").otherwise(template_word(word))


def template_word(word: Column) -> Column:
    head = F.substring(word, 1, 1)
    return F.when(head.between("A", "z"), F.lower(word)).when(head.isin(" ", "@"), "@").when(head == "~", "~").when(word.rlike(r"^\p{N}"), "#").otherwise(F.lower(word))


def _windows(tokens: Column, width: int) -> Column:
    """A hash of every run of ``width`` entries of an array of hashes."""
    def inside(t):
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - width), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(width)]))
        return F.when(F.size(t) >= width, runs).otherwise(F.array().cast("array<bigint>"))
    # the array is bound once as a lambda's variable, not computed for every run
    return F.get(F.transform(F.array(tokens), inside), 0)


def _hashed(words_: Column, template=template_word) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(template(w)))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, width, at, hash) of every item.  Its capitalised first
    word is a name or not depending on what stands before it in a document: both
    forms are searched."""
    rows = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") >= SHORTEST)
    first = F.get("words", 0)
    inside = F.concat(F.array(F.concat(F.lit(" "), first)), F.slice("words", F.lit(2), F.size("words")))
    forms = F.array("words", F.when(first.rlike(r"^\p{Lu}"), inside).otherwise(F.col("words")))
    rows = rows.select("item_id", "words", F.explode(F.array_distinct(forms)).alias("form"))
    return _item_runs(rows.select("item_id", "words", _hashed(F.col("form")).alias("h")), window)


def _item_runs(rows: DataFrame, window: int) -> DataFrame:
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(window)))
    every = F.when(F.col("width") == window, _windows(F.col("h"), window))
    for k in range(SHORTEST, window):
        every = every.when(F.col("width") == k, _windows(F.col("h"), k))
    return rows.select("item_id", "words", "width", F.posexplode(every).alias("at", "hash")).distinct()


def _matches(docs: DataFrame, inner: DataFrame, hashes: Column, window: int) -> DataFrame:
    """(doc_id, key, item_id, doc_at, item_at) of every window of an item in a document."""
    short = [r.width for r in inner.select("width").distinct().collect()]       # at most WINDOW values
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), hashes.alias("h"))
    every = None
    if len(short) > 1:
        def named(k: int):
            return F.transform(_windows(F.col("h"), k), lambda x, i: F.struct(i.alias("at"), F.lit(k).alias("width"), x.alias("hash")))
        every = F.concat(*[named(k) for k in short])
    if every is None:
        k = short[0] if short else window
        every = rows.select("doc_id", "key", F.posexplode(_windows(F.col("h"), k)).alias("doc_at", "hash")).withColumn("width", F.lit(k))
    else:
        every = (rows.select("doc_id", "key", F.explode(every).alias("x"))
                 .select("doc_id", "key", F.col("x.at").alias("doc_at"), F.col("x.hash").alias("hash"), F.col("x.width").alias("width")))
    probe = inner.select("hash", "width", "item_id", F.col("at").alias("item_at"))
    if probe.count() * 64 <= BROADCAST_BYTES:
        probe = F.broadcast(probe)
    return (every.join(probe, ["hash", "width"]).select("doc_id", "key", "item_id", "doc_at", "item_at")
            .dropDuplicates(["doc_id", "key", "item_id", "doc_at", "item_at"]))


def _facts(inner: DataFrame) -> DataFrame:
    return inner.groupBy("item_id").agg((F.max("at") + 1).cast("long").alias("item_windows"), F.first("words").alias("item_words"), F.first("width").alias("width"))


def _raw(docs: DataFrame, hits: DataFrame, words_: Column) -> DataFrame:
    """(__id, __key, words) of the documents in ``hits``."""
    raw = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"), "text")
    raw = raw.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_semi")
    return raw.dropDuplicates(["__id", "__key"]).select("__id", "__key", words_.alias("words"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = LEAST,
                 consistent: float = CONSISTENT) -> DataFrame:
    """One row per document and item that it contains: ``doc_id``, ``key``
    (hash of the text), ``item_id``, ``doc_at`` and ``item_at`` (first matched
    words), ``windows``, ``item_windows``, ``n_slots`` and ``n_agree``."""
    ids = ["doc_id", "key", "item_id"]
    rest = ["doc_at", "item_at", "windows", "item_windows", "n_slots", "n_agree"]
    own = saved(items.select(F.col("item_id").alias("__id"), F.xxhash64(F.col("item_id").cast("string"), F.lit("item"), "text").alias("item_id"), "text").dropDuplicates(["item_id"]), "items")
    items = own.select("item_id", "text")            # items by id and text: null and repeated ids stay apart
    plain = _same_names(docs, items, window, least, consistent).select(F.lit(1).alias("search"), *ids, *rest)
    both = plain.unionByName(_renamed(docs, items, window, least, consistent).select(F.lit(2).alias("search"), *ids, *rest))
    both = both.join(own.drop("text"), "item_id").drop("item_id").withColumnRenamed("__id", "item_id")
    best = F.min(F.struct("search", (-F.col("windows")).alias("fewer"), *rest))
    return both.groupBy(*ids).agg(best.alias("b")).select(*ids, *[f"b.{c}" for c in rest])


def _renamed(docs: DataFrame, items: DataFrame, window: int, least: int, consistent: float) -> DataFrame:
    """The same columns, for templates with every run of names as one word."""
    rows = items.select("item_id", name_runs(F.col("text")).alias("words")).where(F.size("words") >= SHORTEST)
    inner = saved(_item_runs(rows.select("item_id", "words", _hashed(F.col("words"), name_template_word).alias("h")), window), "item-name-windows")
    hits = _matches(docs, inner, _hashed(name_runs(F.col("text")), name_template_word), window)
    hits = saved(hits.withColumn("shift", F.col("doc_at") - F.col("item_at")), "name-matches")
    # every shift takes the windows of its neighbours
    ids = ["doc_id", "key", "item_id", "base"]
    own = hits.select("doc_id", "key", "item_id", F.col("shift").alias("base")).distinct().withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key")
    near = hits.withColumn("base", F.explode(F.sequence(F.col("shift") - SLIP, F.col("shift") + SLIP)))
    near = near.join(own.withColumnRenamed("item_id", "__item").withColumnRenamed("base", "__base"),
                     F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")) & F.col("item_id").eqNullSafe(F.col("__item"))
                     & (F.col("base") == F.col("__base")), "left_semi")
    nearest = F.min(F.struct(F.abs(F.col("shift") - F.col("base")).alias("off"), "shift")).alias("s")
    near = near.groupBy(*ids, "item_at").agg(nearest).select(*ids, "item_at", "s.*")
    lines = near.groupBy(*ids).agg(F.count("*").alias("windows"), F.min(F.struct("item_at", "shift")).alias("start"),
                                   F.sort_array(F.collect_list(F.struct("item_at", "shift", "off"))).alias("at"))
    lines = lines.join(_facts(inner), "item_id")
    lines = lines.where((F.col("windows") >= least) | (F.col("windows") * 2 >= F.col("item_windows")))
    # each word of the item once, by its nearest window
    spans = F.sort_array(F.flatten(F.transform("at", lambda w: F.transform(
        F.sequence(w["item_at"], w["item_at"] + F.col("width") - 1), lambda i: F.struct(i.alias("i"), w["off"].alias("off"), w["shift"].alias("shift"))))))
    first = lambda t: F.filter(t, lambda x, k: (k == 0) | (F.get(t, k - 1)["i"] != x["i"]))
    lines = saved(lines.withColumn("at", F.get(F.transform(F.array(spans), first), 0)), "name-alignments")
    both = lines.join(_raw(docs, lines, name_runs(F.col("text"))), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")))
    before = F.slice("words", F.lit(1), F.col("start.item_at") + F.col("start.shift"))
    item_before = F.slice("item_words", F.lit(1), F.col("start.item_at"))
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, w: n + F.size(F.regexp_extract_all(w, F.lit(TOKEN), F.lit(0))))
    ids += ["windows", "item_windows", "doc_at", "item_at"]
    both = both.withColumn("doc_at", size(before)).withColumn("item_at", size(item_before))
    pairs = F.transform("at", lambda x: F.struct(F.get("item_words", x["i"]).alias("item"), F.get("words", x["i"] + x["shift"]).alias("doc")))
    slots = both.select(*ids, F.explode_outer(F.filter(pairs, lambda p: p["item"].rlike(r"^[~\p{Lu}\p{N}]"))).alias("p"))
    count = (slots.select(*ids, F.col("p.item").alias("item"), F.col("p.doc").alias("doc"), F.col("p.item").rlike(r"^\p{Lu}").alias("name"))
             .groupBy(*ids, "item", "doc", "name").agg(F.count("item").alias("n")))
    agree = count.groupBy(*ids, "item", "name").agg(F.max("n").alias("agree"), F.sum("n").alias("n"), F.max(F.col("item") != F.col("doc")).alias("changed"))
    counted = F.col("item").isNotNull() & (~F.col("name") | F.col("changed"))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    out = agree.groupBy(*ids).agg(total("n", counted).alias("n_slots"), total("agree", counted).alias("n_agree"),
                                  total("n", counted & F.col("name")).alias("n_names"), total("agree", counted & F.col("name")).alias("names"))
    numbers, fits = F.col("n_slots") - F.col("n_names"), F.col("n_agree") - F.col("names")
    out = out.where((F.col("names") >= F.lit(consistent) * F.col("n_names")) & (fits >= F.lit(consistent) * numbers))
    best = F.max(F.struct("windows", (-F.col("base")).alias("back"), "doc_at", "item_at", "item_windows", "n_slots", "n_agree"))
    return out.groupBy("doc_id", "key", "item_id").agg(best.alias("b")).select("doc_id", "key", "item_id", "b.*")


def _same_names(docs: DataFrame, items: DataFrame, window: int, least: int, consistent: float) -> DataFrame:
    """The pairs found by the words' own forms."""
    inner = saved(item_windows(items, window), "item-windows")
    facts = _facts(inner)
    shift = F.col("doc_at") - F.col("item_at")
    hits = (_matches(docs, inner, _hashed(words(F.col("text"))), window)
            .groupBy("doc_id", "key", "item_id", shift.alias("shift"))
            .agg(F.count("*").alias("windows"), F.min("item_at").alias("first"), F.max("item_at").alias("last")))
    hits = hits.join(facts.select("item_id", "item_windows", "width", "item_words"), "item_id")
    hits = hits.where((F.col("windows") >= least) | (F.col("windows") * 2 >= F.col("item_windows")))
    hits = saved(hits, "alignments")
    # the slots of every alignment's matched stretch, on the raw words
    both = hits.join(_raw(docs, hits, words(F.col("text"))), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")))
    n = F.col("last") - F.col("first") + F.col("width")
    pairs = F.arrays_zip(F.slice("item_words", F.col("first") + 1, n).alias("item"),
                         F.slice("words", F.col("first") + F.col("shift") + 1, n).alias("doc"))
    slot = F.filter(pairs, lambda p: p["item"].rlike(r"^[ @~\p{N}]"))
    ids = ["doc_id", "key", "item_id", "first", "shift", "windows", "item_windows"]
    mark = lambda c: F.translate(c, " ", "@").alias(c[2:])
    slots = both.select(*ids, F.explode_outer(slot).alias("p")).select(*ids, mark("p.item"), mark("p.doc"))
    count = slots.groupBy(*ids, "item", "doc").agg(F.count("item").alias("n"))
    agree = count.groupBy(*ids, "item").agg(F.max("n").alias("agree"), F.sum("n").alias("n"))
    out = agree.groupBy(*ids).agg(F.sum("n").alias("n_slots"), F.sum("agree").alias("n_agree"))
    best = F.max(F.struct("windows", (-F.col("shift")).alias("back"), "first", "item_windows", "n_slots", "n_agree"))
    out = out.where(F.col("n_agree") >= F.lit(consistent) * F.col("n_slots")).groupBy("doc_id", "key", "item_id").agg(best.alias("b"))
    return (out.select("doc_id", "key", "item_id", "b.*").withColumn("shift", -F.col("back"))
            .select("doc_id", "key", "item_id", (F.col("first") + F.col("shift")).cast("int").alias("doc_at"),
                    F.col("first").cast("int").alias("item_at"), "windows", "item_windows", "n_slots", "n_agree"))


def clean(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    found = contaminated(docs.select("doc_id", "text"), items, **params).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__own"),
                       F.xxhash64("text").alias("__text"))
    kept = rows.join(found, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti")
    return kept.select(*[F.col(f"__row.`{c}`") for c in docs.columns])


def oracle(window: int = WINDOW, least: int = LEAST, consistent: float = CONSISTENT) -> str:
    """The same in DuckDB's SQL; items of ``window`` words at least are told
    from shorter ones by their own width, as above.  It has the first search
    with the slots of every alignment, not the second search."""
    token = lambda c: (f"regexp_extract_all(regexp_replace(regexp_replace(coalesce({c}, ''), '{NAME}', '\\1@\\2', 'g'), "  # noqa: E731
                       f"'{AFTER}', '\\1~\\2', 'g'), '{TOKEN}')")
    canon = (r"list_transform(words, lambda w: CASE WHEN w[1] IN ('@', '~') THEN w[1] WHEN regexp_matches(w, '^\p{N}') THEN '#' ELSE lower(w) END)")
    return f"""
WITH b AS (SELECT item_id, {token('text')} AS words FROM benchmark),
bt AS (SELECT item_id, words, {canon} AS t, least(len(words), {window}) AS width FROM b WHERE len(words) >= {SHORTEST}),
bv AS (SELECT item_id, t, width FROM bt UNION ALL
  SELECT item_id, list_concat(['@'], t[2:]), width FROM bt WHERE regexp_matches(words[1], '^\\p{{Lu}}')),
bw AS (SELECT DISTINCT item_id, width, i AS item_at, array_to_string(t[i + 1:i + width], ' ') AS run
  FROM (SELECT *, unnest(range(len(t) - width + 1)) AS i FROM bv)),
f AS (SELECT item_id, width, words AS item_words, len(t) - width + 1 AS item_windows FROM bt),
d AS (SELECT DISTINCT doc_id, text FROM documents),
dt AS (SELECT doc_id, text, words, {canon} AS t FROM (SELECT doc_id, text, {token('text')} AS words FROM d)),
dw AS (SELECT doc_id, text, width, i AS doc_at, array_to_string(t[i + 1:i + width], ' ') AS run
  FROM (SELECT *, unnest(range(greatest(len(t) - width + 1, 0))) AS i FROM dt, (SELECT DISTINCT width FROM bt))),
h AS (SELECT doc_id, text, item_id, doc_at - item_at AS shift, count(*) AS windows, min(item_at) AS first, max(item_at) AS last
  FROM dw JOIN bw USING (width, run) GROUP BY ALL),
g AS (SELECT * FROM h JOIN f USING (item_id) WHERE windows >= {least} OR windows * 2 >= item_windows),
s AS (SELECT g.*, unnest(range(first, last + width)) AS i FROM g),
p AS (SELECT s.*, item_words[i + 1] AS item, words[i + shift + 1] AS doc FROM s JOIN dt ON dt.doc_id IS NOT DISTINCT FROM s.doc_id AND dt.text = s.text),
c AS (SELECT doc_id, text, item_id, shift, item, doc, count(*) AS n FROM p WHERE regexp_matches(item, '^[@~\\p{{N}}]') GROUP BY ALL),
a AS (SELECT doc_id, text, item_id, shift, sum(n) AS n, max(n) AS agree FROM c GROUP BY doc_id, text, item_id, shift, item),
z AS (SELECT doc_id, text, item_id, shift, sum(n) AS n_slots, sum(agree) AS n_agree FROM a GROUP BY ALL)
SELECT g.doc_id, g.item_id, CAST(first + g.shift AS INTEGER) AS doc_at, CAST(first AS INTEGER) AS item_at, windows, item_windows,
  CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, CAST(coalesce(n_agree, 0) AS BIGINT) AS n_agree
FROM g LEFT JOIN z ON z.doc_id IS NOT DISTINCT FROM g.doc_id AND z.text = g.text AND z.item_id = g.item_id AND z.shift = g.shift
WHERE coalesce(n_agree, 0) >= {consistent} * coalesce(n_slots, 0)
QUALIFY row_number() OVER (PARTITION BY g.doc_id, g.text, g.item_id ORDER BY windows DESC, g.shift) = 1"""
