"""Fill-in-the-middle: chunks, cuts, round trips."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import fill_in_middle as fim
from stayline.llm import queries
from tests.llm.conftest import DOCS, corpus, words

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, rate=100, spm=50):
    """The contract's rules on the plain text."""
    text = text or ""
    lines = LINE.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(3)
    many = ["".join(rng.choice(["\n", "a", "é", "漢", "<", "P", ">", " ", "𝄞"]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    lines = ["\n".join(words(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    shared = "\n".join(words(rng, 12) for _ in range(40))
    return many + lines + [shared + t for t in lines[:20]] + ["\n", "\n\n\n", "a", "a\n", "\r\n\r", "<", "<P", "x" * 63 + "<P>", "x" * 64 + "<M>y", "é" * 9000,
                                                              "no newline " * 2000, "\n" * 9000, "z" * 4095 + "<S>", "z" * 4094 + "<S>" + "z" * 5000]


def rows():
    return [(i, t, "en", "s", 0) for i, t in enumerate(odd_texts())] + [(1000 + (i or 0) if i is not None else None, t, a, b, c) for i, t, a, b, c in corpus()]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(rows(), DOCS).withColumn("FORM", F.lit(3)).withColumn("__row", F.lit("x")).withColumn("__fim", F.lit("y"))
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored())
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "__row", "__fim", *fim.COLUMNS, "back"]
    got = sorted(((r.doc_id, r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got.collect()), key=str)
    want = sorted(((i, t or "", *brute(i, t), t or "") for i, t, *_ in rows()), key=str)
    assert got == want
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_parameters(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = sorted(((r.doc_id, r.form, r.output) for r in fim.fill_in_middle(docs, seed=11, rate=40, spm=0).collect()), key=str)
    want = sorted(((i, *brute(i, t, 11, 40, 0)[1::3]) for i, t, *_ in rows()), key=str)
    assert got == want


def test_query_columns(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_fill_in_middle(spark, str(tmp_path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((i, *(x := brute(i, t))[:4], sha(x[4]), sha(t or "")) for i, t, *_ in corpus()), key=str)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_table(spark, empty):
    assert fim.fill_in_middle(empty).count() == 0


def test_chunks_follow_the_content():
    rng = random.Random(1)
    shared = words(rng, 3000).encode()
    a, b = words(rng, 700).encode() + shared, words(rng, 333).encode() + shared
    data = a + b
    places = fim.cut_places(np.frombuffer(data, np.uint8))
    cut = []
    for lo, hi in ((0, len(a)), (len(a), len(data))):
        ends = fim.chunk_ends(lo, hi, places)
        sizes = np.diff([lo, *ends])
        assert ends[-1] == hi and (sizes <= fim.MAX_CHUNK).all() and (sizes[:-1] >= fim.MIN_CHUNK).all()
        cut.append({data[p:q] for p, q in zip([lo, *ends], ends)})
    assert len(cut[0] & cut[1]) > 0.8 * len(shared) / 600
    seen = fim.Summaries()
    fim.Lines(data, fim.chunk_ends(0, len(a), places), 0, seen)
    before = seen.made
    fim.Lines(data, fim.chunk_ends(len(a), len(data), places), len(a), seen)
    assert seen.made - before < 0.6 * len(cut[1])        # shared chunks come from the cache
    alone = fim.cut_places(np.frombuffer(b, np.uint8))
    assert fim.chunk_ends(0, len(b), alone) == [e - len(a) for e in fim.chunk_ends(len(a), len(data), places)]


@pytest.mark.parametrize("room", [1, 5000, 1 << 20])
def test_cache_is_bounded_and_changes_nothing(room):
    seen, rng = fim.Summaries(room), random.Random(2)
    for t in odd_texts() * 2:
        data = t.encode()
        ends = fim.chunk_ends(0, len(data), fim.cut_places(np.frombuffer(data, np.uint8)))
        got, lines = fim.Lines(data, ends, 0, seen), LINE.findall(t)
        assert got.n == len(lines) and got.marked == any(m.decode() in t for m in fim.MARKS)
        u = rng.randint(0, len(lines))
        assert got.cut(u) == (len("".join(lines[:u]).encode()), len("".join(lines[:u])))
        assert seen.size <= max(room, fim.MAX_CHUNK + 200)
