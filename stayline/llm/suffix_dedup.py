"""Exact substring de-duplication with a distributed two-stage suffix sort.

Every byte covered by a string of ``LENGTH`` (100) bytes that also starts
earlier is removed: in a document of smaller id, or earlier in the same.
Overlaps count, and strings are judged on the input.

A suffix array of the whole corpus would need every suffix's text in the right
task.  Instead, strings are dealt by content:

1. Anchors.  Among the ``GRAM``-byte grams of a 100-byte string the one with the
   smallest hash is its anchor, so equal strings have equal anchors.
   Neighbouring starts mostly share one; such a run of starts, with the text it
   spans, is a segment (about 135 bytes, one per 35 bytes of text).  Only the hashes of
   anchor and segment are shuffled.  Equal segments of one input batch are
   merged beforehand, so a hot passage costs a row per batch.
2. Segments that share an anchor with another are kept; of equal ones the
   earliest stands for all, the others are later copies as a whole.
3. The text of those representatives is fetched and dealt by anchor.  Each task
   takes whole anchors until a buffer of ``BUFFER`` bytes is full, sorts all
   suffixes of it in two stages (``suffix_array``), and reads equal strings
   off the adjacent common prefixes; all but the earliest start are copies.
   An anchor with more than ``CROWD`` different segments (a ruler line, say) is
   dealt by whole strings instead: each start's string is a row of its own,
   counted by its 128-bit hash before the shuffle.
4. Covered stretches come together by document, which is cut.

Texts travel compressed in steps 3 and 4.  Nothing is broadcast or collected.

Cases.  Null text is empty; texts shorter than 100 bytes lose nothing.  A null
id comes last.  Rows that agree in id and text are one document, so neither
is a copy of the other; rows with equal ids and other texts are ordered by
text hash.  An empty table gives an empty result.  Other input columns
are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import U64, _powers, as_bytes, mix64, saved
from stayline.llm.suffix_array import equal_strings

LENGTH = 100
GRAM = 32
BUFFER = 2_000_000
CROWD = 5_000
PIECE = 250_000       # bytes of text hashed at once
LAST = 2 ** 63 - 1      # stands for a null id


def _grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from every position."""
    h, k, a = mix64(buf.astype(U64) + U64(1)), 1, 0x9E3779B97F4A7C15
    while k < gram:
        h = h[:-k] * U64(a) + h[k:]
        k, a = 2 * k, (a * a + 2) % (1 << 64) | 1
    return mix64(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if width > k else x


def segments(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor hash, segment hash, first start and number of starts of every
    segment; ``starts`` says where a string may begin."""
    none = np.empty(0, U64)
    if len(buf) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    g = _grams(buf, gram)
    bits = U64(len(buf).bit_length())
    low = (U64(1) << bits) - U64(1)
    least = _window_min((g & ~low) | np.arange(len(g), dtype=U64), length - gram + 1)
    at = (least & low).astype(np.int64)
    ok = starts[:len(at)]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    end = np.append(ok, False)
    stop = np.flatnonzero(end[:-1] & ~(end[1:] & np.append(at[1:] == at[:-1], False)))
    n = stop - first + 1
    fwd, back = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * fwd[:-1], out=run[1:])
    seg = mix64((run[stop + length] - run[first]) * back[first] + n.astype(U64))
    return g[at[first]], seg, first, n


def _pieces(texts: list[bytes], length: int):
    """(document number, offset, buffer, starts) over bounded stretches of the texts."""
    docs, buf, size = [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[lo:lo + PIECE + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > PIECE + length:
                yield docs, buf
                docs, buf, size = [], [], 0
            docs.append((i, lo))
            buf.append(part)
            size += len(part)
    if docs:
        yield docs, buf


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of (doc_id, key, text), one row for every different one of
    a batch.  ``at`` holds the first start and, in ten bits, the number of
    starts.  Later copies in the same batch are joined to stretches: no number
    in ``at``, ``s`` starts in all, and a hash of the document as ``h``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            ids, keys = b["doc_id"].to_numpy(), b["key"].to_numpy()
            got = []
            for docs, parts in _pieces(texts, length):
                ends = np.cumsum([len(p) for p in parts])
                base = ends - [len(p) for p in parts]
                buf = np.frombuffer(b"".join(parts), np.uint8)
                starts = np.ones(len(buf), bool)
                for e in ends:
                    starts[e - length + 1:e] = False
                h, s, first, n = segments(buf, starts, length, gram)
                own = np.searchsorted(base, first, "right") - 1
                row = np.array([d[0] for d in docs])[own]
                got.append((h, s, row, first - base[own] + np.array([d[1] for d in docs])[own], n))
            if not got:
                continue
            h, s, row, at, n = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((at, keys[row], ids[row], s, h))
            h, s, row, at, n = h[order], s[order], row[order], at[order], n[order]
            again = np.append(False, (h[1:] == h[:-1]) & (s[1:] == s[:-1]))
            one = ~again
            yield pd.DataFrame({"h": h[one].view(np.int64), "s": s[one].view(np.int64), "doc_id": ids[row[one]],
                                "key": keys[row[one]], "at": at[one] << 10 | n[one]})
            # a copy of itself, in a repeated row, isn't a later copy
            lead = np.flatnonzero(one)[np.cumsum(one) - 1]
            again &= (ids[row] != ids[row[lead]]) | (keys[row] != keys[row[lead]]) | (at != at[lead])
            yield _stretches(row[again], at[again], n[again], ids, keys)

    return rows.mapInPandas(run, PLACES)


def _stretches(row, at, n, ids, keys) -> pd.DataFrame:
    """Runs of starts, joined where one ends at the next."""
    order = np.lexsort((at, row))
    row, at, n = row[order], at[order], n[order]
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + n[:-1]))[:len(row)]
    i = np.flatnonzero(new)
    total = np.add.reduceat(n, i) if len(i) else n
    return pd.DataFrame({"h": keys[row[i]] ^ at[i], "s": total.astype(np.int64), "doc_id": ids[row[i]], "key": keys[row[i]], "at": at[i] << 10})


def _shared(anchors: DataFrame) -> DataFrame:
    """Of the anchors in more than one place the earliest place of every
    segment; all other places become later copies (no number in ``at``)."""
    def out(f: pd.DataFrame, n: int, before) -> pd.DataFrame:
        """The first ``n`` rows; the one after them is known if there is one."""
        x = f[["h", "s", "doc_id", "key", "at"]].to_numpy()
        prev = np.vstack([x[:1] if before is None else before[None], x[:-1]])
        eq = x == prev
        if before is None:
            eq[0] = False
        old = eq[:, 0]
        nxt = np.append(old[1:], False)
        same = old & eq[:, 1]
        twin = same & eq[:, 2:].all(1)
        f = f.assign(s=np.where(same, x[:, 4] & 1023, x[:, 1]), at=np.where(same, x[:, 4] >> 10 << 10, x[:, 4]))
        return f[((old | nxt) & ~twin) & (np.arange(len(f)) < n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before = None, None
        for b in batches:
            done = (b["at"] & 1023) == 0
            yield b[done]
            b = b[~done]
            f = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(f) > 1:
                yield out(f, len(f) - 1, before)
                before = f[["h", "s", "doc_id", "key", "at"]].iloc[-2].to_numpy()
            held = f.iloc[-1:]
        if held is not None and len(held):
            yield out(held, 1, before)

    order = ["h", "s", "doc_id", "key", "at"]
    return anchors.repartition("h").sortWithinPartitions(*order).mapInPandas(run, PLACES)


def _packed(rows: DataFrame) -> DataFrame:
    """``text`` compressed, for the shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield b.assign(text=[z.compress(t) for t in b["text"]])

    return rows.mapInPandas(run, "doc_id long, key long, text binary")


def _fetched(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The text of every segment in ``places``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            hs, ids, keys, ats, segs, size = [], [], [], [], [], 0
            for i, k, t, h, at in zip(b["doc_id"], b["key"], b["text"], b["hs"], b["ats"]):
                t = z.decompress(t)
                hs.append(h)
                ats.append(at)
                ids.append(np.full(len(h), i))
                keys.append(np.full(len(h), k))
                for a in at.tolist():
                    segs.append(t[a >> 10:(a >> 10) + (a & 1023) + length - 1])
                size += len(h)
                if size > 50_000:
                    yield pd.DataFrame(dict(zip(FETCHED, (*map(np.concatenate, (hs, ids, keys, ats)), segs))))
                    hs, ids, keys, ats, segs, size = [], [], [], [], [], 0
            if size:
                yield pd.DataFrame(dict(zip(FETCHED, (*map(np.concatenate, (hs, ids, keys, ats)), segs))))

    by = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "at")).alias("x"))
    by = by.select("doc_id", "key", F.col("x.h").alias("hs"), F.col("x.at").alias("ats"))
    return (_packed(rows).join(by, ["doc_id", "key"]).select("doc_id", "key", "text", "hs", "ats")
            .mapInPandas(run, "h long, doc_id long, key long, at long, seg binary"))


FETCHED = ("h", "doc_id", "key", "at", "seg")
PLACES = "h long, s long, doc_id long, key long, at long"


def copies_in(f: dict, length: int) -> pd.DataFrame:
    """Later copies among the strings of some segments with their texts."""
    size = np.array([len(t) for t in f["seg"]])
    base = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(f["seg"]), np.uint8)
    n, at = f["at"] & 1023, f["at"] >> 10
    edge = np.zeros(len(buf) + 1, np.int8)
    np.add.at(edge, base, 1)
    np.add.at(edge, base + n, -1)
    starts = np.cumsum(edge[:-1]) > 0
    sa, new = equal_strings(buf, starts, length)
    own = np.searchsorted(base, sa, "right") - 1
    by = np.lexsort((f["key"], f["doc_id"]))
    i, k = f["doc_id"][by], f["key"][by]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.append(0, (i[1:] != i[:-1]) | (k[1:] != k[:-1])))
    start = at[own] + sa - base[own]
    place = rank[own] << 40 | start
    group = np.flatnonzero(new)
    first = np.minimum.reduceat(place, group) if len(group) else place
    later = place > np.repeat(first, np.diff(np.append(group, len(sa))))
    own, start = own[later], start[later]
    return _stretches(own, start, np.ones(len(own), np.int64), f["doc_id"], f["key"])


def _sorted_copies(segs: DataFrame, length: int, buffer: int) -> DataFrame:
    """Later copies found by suffix sorts over whole anchors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[dict] = []
        size = 0
        for b in batches:
            cols = {c: b[c].to_numpy() for c in FETCHED}
            cut = np.flatnonzero(cols["h"][1:] != cols["h"][:-1]) + 1
            ends = np.cumsum([len(t) for t in cols["seg"]]) if len(b) else np.empty(0, int)
            lo = 0
            if rest and len(b) and cols["h"][0] != rest[-1]["h"][-1]:
                cut = np.append(0, cut)
            for c in cut.tolist():
                here = size + (ends[c - 1] if c else 0) - (ends[lo - 1] if lo else 0)
                if here >= buffer:
                    rest.append({k: v[lo:c] for k, v in cols.items()})
                    yield copies_in({k: np.concatenate([r[k] for r in rest]) for k in FETCHED}, length)
                    rest, size, lo = [], 0, c
            rest.append({k: v[lo:] for k, v in cols.items()})
            size += int(ends[-1] - (ends[lo - 1] if lo else 0)) if len(b) else 0
        if size:
            yield copies_in({k: np.concatenate([r[k] for r in rest]) for k in FETCHED}, length)

    return segs.repartition("h").sortWithinPartitions("h").mapInPandas(run, PLACES)


def _counted_copies(segs: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors, string by string."""
    one = segs.select("doc_id", "key", F.shiftright("at", 10).alias("at"), "seg",
                      F.explode(F.sequence(F.lit(0), (F.col("at").bitwiseAND(1023) - 1).cast("int"))).alias("i"))
    text = F.substring("seg", F.col("i") + 1, F.lit(length))
    one = one.select("doc_id", "key", (F.col("at") + F.col("i")).alias("at"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    place = F.struct("doc_id", "key", "at")
    first = one.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = one.join(first, ["a", "b"]).where(place > F.col("first"))
    return later.select(F.col("a").alias("h"), F.lit(1).cast("long").alias("s"), "doc_id", "key", F.shiftleft("at", 10).alias("at"))


def later_copies(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, buffer: int = BUFFER, crowd: int = CROWD) -> DataFrame:
    """(doc_id, key, at, n): runs of ``n`` starts from byte ``at`` whose strings
    also start earlier.  ``rows`` has doc_id, key and text (bytes)."""
    shared = saved(_shared(_anchors(rows, length, gram)), "shared-segments")
    alone = F.col("at").bitwiseAND(1023) == 0
    reps = shared.where(~alone)
    crowds = saved(reps.groupBy("h").count().where(F.col("count") > crowd).select("h"), "crowded-anchors")
    segs = _fetched(rows, reps, length)
    found = _sorted_copies(segs.join(crowds, "h", "left_anti"), length, buffer).unionByName(shared.where(alone))
    if not crowds.isEmpty():
        found = found.unionByName(_counted_copies(segs.join(crowds, "h", "left_semi"), length))
    return found.select("doc_id", "key", F.shiftright("at", 10).alias("at"), F.col("s").alias("n"))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            got = []
            for i, t, ats, ns in zip(b["doc_id"], b["text"], b["ats"], b["ns"]):
                t = z.decompress(t)
                kept, gone, spans, end = [], 0, 0, 0
                if ats is not None and len(ats):
                    by = np.argsort(ats, kind="stable")
                    for lo, hi in zip(ats[by].tolist(), (ats + ns + (length - 1))[by].tolist()):
                        if lo > end or not spans:
                            kept.append(t[end:lo])
                            spans += 1
                            gone -= lo
                            gone += hi
                            end = hi
                        elif hi > end:
                            gone += hi - end
                            end = hi
                kept = b"".join([*kept, t[end:]])
                got.append((None if i == LAST else i, len(t), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            frame = pd.DataFrame(got, columns=[c.split()[0] for c in OUT.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(run, OUT)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, buffer: int = BUFFER, crowd: int = CROWD,
                     with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes; they may end inside a character)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), as_bytes())
    runs = later_copies(rows, length, gram, buffer, crowd)
    by = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "n")).alias("x"))
    by = by.select("doc_id", "key", F.col("x.at").alias("ats"), F.col("x.n").alias("ns"))
    return _cut(_packed(rows).join(by, ["doc_id", "key"], "left").select("doc_id", "text", "ats", "ns"), length, with_text)
