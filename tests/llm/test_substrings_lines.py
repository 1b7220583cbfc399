"""Suffix-array dedup and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.llm import line_dedup, suffix_dedup
from stayline.llm.suffix_array import equal_strings, smaller_than_next, suffix_array
from tests.llm.conftest import DOCS, corpus

LAST = 2 ** 63


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_suffix_array_equals_sorted_suffixes(raw):
    buf = np.frombuffer(raw, np.uint8)
    assert [raw[i:] for i in suffix_array(buf, 80)] == sorted(raw[i:] for i in range(len(raw)))
    assert smaller_than_next(buf).tolist() == [raw[i:] < raw[i + 1:] for i in range(len(raw))]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=200).map(lambda b: bytes(x % 2 + 97 for x in b)), st.integers(8, 12))
def test_equal_strings_finds_all_groups(raw, length):
    starts = np.zeros(len(raw), bool)
    starts[:len(raw) - length + 1] = True
    sa, new = equal_strings(np.frombuffer(raw, np.uint8), starts, length)
    groups, got = {}, {}
    for i in range(len(raw) - length + 1):
        groups.setdefault(raw[i:i + length], set()).add(i)
    for i, k in zip(sa.tolist(), np.cumsum(new).tolist()):
        got.setdefault(k, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def brute_bytes(rows, length):
    """The contract, string by string: (id, text) -> (bytes, removed, spans, sha256)."""
    first, docs = {}, {}
    for i, text, *_ in rows:
        docs[i, text] = (text or "").encode()
    order = lambda k: (LAST if k[0] is None else k[0])
    for k, b in docs.items():
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first.setdefault(s, []).append((order(k), p))
    for v in first.values():
        v.sort()
    out = {}
    for k, b in docs.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            at = first[b[p:p + length]][0]
            if at < (order(k), p) and (at[0] != order(k) or at[1] < p):
                gone[p:p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 2])
def test_substrings_equal_brute_force(spark, docs, crowd):
    rows = corpus()
    got = suffix_dedup.dedup_substrings(docs, crowd=crowd, buffer=3000).collect()
    want = brute_bytes(rows, 100)
    assert len(got) == len(rows)
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, []).append(v)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in by_id[r.doc_id], r.doc_id
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert sum(r.n_removed for r in got) > 3000


def test_substrings_pieces_of_one_long_text(spark, monkeypatch):
    """Texts longer than a hashed piece, and runs of one byte."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(3)
    t = "".join(rng.choice("ab") for _ in range(1500))
    rows = [(1, t, None, None, None), (2, t[200:900] + "-" + t[:700], None, None, None), (3, "z" * 400, None, None, None)]
    texts = [r[1].encode() for r in rows]
    seen = []
    for docs, parts in suffix_dedup._pieces(texts, 100):
        seen += [texts[i][lo:lo + len(p)] == p for (i, lo), p in zip(docs, parts)]
    assert all(seen) and len(seen) > 3
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           suffix_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: v for (i, _), v in brute_bytes(rows, 100).items()}


def test_substrings_empty_table(empty):
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def brute_lines(rows, min_lines, long_words):
    docs = sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    seen, out = {}, {}
    places = []
    for d in docs:
        lines = [(n, x.strip(" ")) for n, x in enumerate(d[1].split("\n"))]
        lines = [(n, x) for n, x in lines if x]
        places.append((d, lines))
    for d, lines in places:
        out[d] = set()
        for p in range(len(lines)):
            run = tuple(x for _, x in lines[p:p + min_lines])
            if len(run) == min_lines:
                if run in seen:
                    out[d] |= {n for n, _ in lines[p:p + min_lines]}
                seen.setdefault(run, (d, p))
            one = (lines[p][1],)
            if len(lines[p][1].replace("\t", " ").split()) >= long_words and ("one", one) in seen:
                out[d].add(lines[p][0])
            seen.setdefault(("one", one), (d, p))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 4])
def test_lines_equal_brute_force(spark, min_lines):
    rng = random.Random(9)
    pool = [f"line {k} " + "w " * rng.choice([0, 2, 3, 60]) for k in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))), None, None, None) for i in range(30)]
    rows += [(40, None, None, None, None), (41, "", None, None, None), (None, rows[0][1], None, None, None), rows[3]]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).withColumn("gone", F.lit("clash")), min_lines=min_lines).collect()
    want = brute_lines(rows, min_lines, line_dedup.LONG_WORDS)
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        gone = want.get((r.doc_id, t), set())
        assert r.n_deleted == len(gone)
        assert r.text == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        assert r.n_lines == (len(t.split("\n")) if t else 0)
        assert r.n_runs == sum(n - 1 not in gone for n in gone)


def test_lines_longest_shared_run_and_empty(spark, empty):
    text = "\n".join(f"l{k}" for k in range(9))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_deleted, r.longest) for r in got} == {1: (0, 0), 2: (9, 8)}
    assert line_dedup.dedup_lines(empty).count() == 0
    with pytest.raises(ValueError):
        line_dedup.repeated_lines(empty, min_lines=3)
