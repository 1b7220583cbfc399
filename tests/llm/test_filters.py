"""Language ID, URL templates and decontamination."""

from __future__ import annotations

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from stayline.llm import decontaminate, language_id, url_filter
from tests.llm.conftest import DOCS

SYLLABLES = {"en": "the and ing th er on re wh ly ed".split(), "de": "ein sch ung keit ver ge ü ß die und".split(),
             "fr": "eau tion é è les ment que oi ou aux".split(), "es": "ción ñ mente los ado as que rr ll ez".split()}


def speech(n=240, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60)))
        rows.append((i, text.capitalize(), lang, "s", len(text)))
    return rows


def test_languages_on_held_out_documents(spark):
    rows = speech() + [(900, None, "en", None, None), (901, "12 345 !!", "fr", None, 1), (902, "", None, None, 0), (None, "the thing", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = language_id.identify_language(docs).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id < 900]
    assert len(right) > 30 and sum(right) >= 0.97 * len(right)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}


def test_predictions_use_the_text_only(spark):
    docs = spark.createDataFrame(speech(80), DOCS)
    model = language_id.train(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(other, model).collect()}


def test_three_families_and_few_labels(spark, empty):
    rng = random.Random(4)
    rows = speech(120) + [(500 + i, " ".join("".join(rng.choice(["ов", "ий", "ста", "ря", "ш"]) for _ in range(3)) for _ in range(20)), "ru", "s", 1)
                          for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs)
    assert len(model["families"]) == 3
    got = {r.doc_id: r.lang_pred for r in language_id.identify_language(docs, model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) >= 0.95 * len(rows)
    one = language_id.identify_language(docs.where("lang = 'en'")).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in one] == ["en"]
    none = language_id.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]
    assert language_id.identify_language(empty).count() == 0


def test_accepted_keeps_columns_and_clean_documents(spark):
    rows = speech(60) + [(900, None, "en", None, None), (901, "?? 12", "fr", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.lit(3)).withColumn("__got", F.lit(1))
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


URLS = [("http://A.Example.COM/de/1", "a.example.com", "/de/1", "com/", "allow"), ("http://A.Example.COM/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://example.com/en/x?y#z", "example.com", "/en/x", "example.com/en/", "block"),
        ("x://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://sub.www.example.com/en/2", "sub.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://anet/fr/", "anet", "/fr/", None, "allow"),
        ("http://a.net/es", "a.net", "/es", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://É.com?/q", "É.com", "", None, "allow"), ("a://b.com/://c", "b.com", "/://c", "com/", "allow"), ("http://q.org/a/b/c/d/e/9", "q.org", "/a/b/c/d/e/9", None, "allow")]


def test_urls_rules_and_cases(spark):
    rows = [(i, u[0], None) for i, u in enumerate(URLS)] + [(0, URLS[0][0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:], URLS[r.page_id]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [(i, f"http://h.org/item/slug{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}") for i in range(120)]
    rows += [(200 + i, f"http://h.org/bad/{i}") for i in range(30)] + [(300 + i, f"http://h.org/good/{i}") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("h.org/bad/1", "block"), ("h.org/bad/2", "block"), ("h.org/good/1", "allow"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[5].template == "/item/*/#"
    assert got[203].rule is None and got[203].verdict == "block"       # /bad/# is mostly blocked
    assert got[303].verdict == "allow" and got[5].verdict == "allow"


def run_oracle(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def test_urls_equal_the_sql(spark):
    rng = random.Random(8)
    hosts = ["a.com", "b.net", "c.net", "www.example.com", "d.org"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'p' + str(i)])}/{rng.choice(['x', str(i), 'w' * (i % 70)])}"
             f"{rng.choice(['', '/', '.html', '/tail/' + str(i)])}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(pages).toPandas().sort_values("page_id").reset_index(drop=True)
    want = run_oracle(url_filter.oracle(), pages=pages.toPandas()).sort_values("page_id").reset_index(drop=True)
    assert got.fillna("-").equals(want[got.columns].fillna("-"))


ITEMS = [(1, "If Anna buys 12 apples for 3 dollars each, and Anna gives 4 apples to Ben, how much did Anna spend on what is left?"),
         (2, "a train leaves the old station at noon and travels west over the long bridge before the evening comes down"),
         (3, "too short"), (4, None), (5, "Which of these six words is it?")]


def contamination_docs():
    rng = random.Random(6)
    fill = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))
    changed = ITEMS[0][1].replace("12", "35").replace("Anna", "Carla").replace("Ben", "Otto").replace(" 3 ", " 7 ").replace("4", "9")
    mixed = ITEMS[0][1].replace("Anna buys", "Carla buys").replace("Anna gives", "Otto gives").replace("did Anna", "did Rosa")
    rows = [(1, fill(30) + ". " + ITEMS[0][1] + " " + fill(9)), (2, fill(20) + ". " + changed), (3, fill(20) + ". " + mixed),
            (4, fill(8) + " " + ITEMS[1][1].upper() + " " + fill(5)), (5, fill(60)), (6, None), (7, ""), (8, "too short"), (9, "so " + ITEMS[4][1]),
            (10, "a train leaves the old station at noon " + fill(20)), (None, ITEMS[1][1])]
    return [*rows, rows[1]]


def test_decontamination_catches_changed_questions(spark):
    rows = contamination_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 1), (2, 1), (4, 2), (9, 5), (None, 2)], key=str)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8, 10]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_decontamination_by_shuffle_and_sql(spark, monkeypatch):
    docs, items = spark.createDataFrame(contamination_docs(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = run_oracle(decontaminate.oracle(), documents=docs.toPandas().astype({"doc_id": "Int64"}), benchmark=items.toPandas())
    cols = ["doc_id", "item_id", "doc_at", "item_at", "windows", "item_windows", "n_slots", "n_agree"]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    got = decontaminate.contaminated(docs, items).toPandas()
    key = lambda f: sorted(map(str, f[cols].astype("float").fillna(-1).values.tolist()))
    assert key(got) == key(want)


def test_decontamination_checks_every_alignment(spark):
    item = "What is 3 plus 4 minus 3?"
    rows = [(1, f"What is 5 plus 6 minus 7? {item}"), (2, f"{item} What is 5 plus 6 minus 7?"), (3, "What is 5 plus 6 minus 7? What is 1 plus 2 minus 4?"),
            (4, "What is 5 plus 6 minus 7? " * 3 + "What is 8 plus 2 minus 8?")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.doc_at, r.n_slots, r.n_agree) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: (7, 3, 3), 2: (0, 3, 3), 4: (21, 3, 3)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]


def test_decontamination_finds_renamed_sentences(spark):
    item = "Anna has 3 apples. Anna buys 4 more apples. Anna gives 2 to Tom. How many apples does Anna have?"
    city = "The train from Boston to Berlin takes 5 hours. Boston is colder than Berlin by 7 degrees, so which of the two towns is warmer?"
    mary, york = item.replace("Anna", "Mary").replace("Tom", "Otto").replace("4", "9"), city.replace("Boston", "New York")
    rows = [(1, "some words before. " + mary), (2, mary.replace(". ", '.\n"')), (3, york), (4, york.replace("Berlin", "Rio de la Plata")),
            (5, item.replace("Anna buys", "Mary buys").replace("Anna gives", "Rosa gives").replace("does Anna", "does Otto")),
            (6, "Mary had a little lamb. Its fleece was white as snow. Otto gives 2 to Rosa."),
            (7, "AB CDE " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, city)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert sorted(got) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert got[1, 1].doc_at == 3 and got[1, 1].item_at == 0
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [5, 6, 7]


@pytest.mark.parametrize("text,want", [("He paid 12.50 dollars, to Mr Smith", ["he", "paid", "#", "~", "to", "mr", "@"]), ("", []), ("ÉTÉ 1,000 km", ["été", "#", "~"])])
def test_template_words(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").select(
        F.transform(decontaminate.words(F.col("text")), decontaminate.template_word).alias("t")).first()
    assert row.t[:5] == want[:5] or row.t == want
