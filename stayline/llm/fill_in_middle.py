"""Fill-in-the-middle transformation over memoised content-defined chunks.

A rolling hash over ``WINDOW`` bytes cuts every text into chunks, so texts
that share a passage share its chunks.  What a chunk adds to the counts (its
line ends as byte and code point offsets, its code points, whether it holds a
marker) is worked out once per content and kept in a bounded cache, whose
lookups compare the content itself.  Running sums over a document's chunks
then find the chunk that holds a cut, and its kept offsets the exact place;
no text is scanned twice.

A text of ``n`` lines is cut after two numbers of lines drawn from the hash
of its id.  ``psm`` writes prefix, suffix, middle, each after its marker;
``spm`` suffix, prefix, middle; ``plain`` texts stay as they are.
``restored`` rebuilds the text from output and form alone.

Cases.  Null text is empty; empty texts and texts with a marker are plain,
whose piece lengths are null.  A null id is drawn as the empty string.  Cuts
may leave pieces empty; a line end stays with its line; a last line needs
none.  Equal ids get equal draws, repeated rows equal results.  Whole texts of
any length are cut; chunks never exceed ``MAX_CHUNK`` bytes, and the cache
affects speed only.  Input columns named as a result column are replaced,
others are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import mix64

SEED, RATE, SPM = 7, 100, 50
MARKS = (b"<P>", b"<S>", b"<M>")
WINDOW = 16                    # bytes; a power of two
MIN_CHUNK, MAX_CHUNK = 64, 4096
CUT_BITS = 9                   # a cut every 512 bytes after the least length, about
CACHE_BYTES = 32 << 20         # contents kept by a task
OUT = "n long, form string, prefix_chars long, middle_chars long, output binary"
COLUMNS = [f.split()[0] for f in OUT.split(", ")]

_BYTE = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_places(buf: np.ndarray) -> np.ndarray:
    """Ends of the windows whose rolling hash has ``CUT_BITS`` leading zeros."""
    if len(buf) < WINDOW:
        return np.empty(0, np.int64)
    h, width, base = _BYTE[buf], 1, 0x9E3779B1
    while width < WINDOW:
        h = h[:-width] * np.uint32(base) + h[width:]
        base, width = base * base & 0xFFFFFFFF, 2 * width
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + WINDOW


def chunk_ends(start: int, end: int, places: np.ndarray) -> list[int]:
    """Chunk ends of the text in ``[start, end)``: every place at least
    ``MIN_CHUNK`` after the last end, and one after ``MAX_CHUNK`` bytes."""
    ends, at = [], start
    for p in [*places[np.searchsorted(places, start + MIN_CHUNK):np.searchsorted(places, end)].tolist(), end]:
        while p - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if p - at >= MIN_CHUNK or p == end and p > at:
            ends.append(p)
            at = p
    return ends


class Summaries:
    """Summary per chunk content; the oldest contents go first."""

    def __init__(self, room: int = CACHE_BYTES):
        self.kept, self.room, self.size, self.made = {}, room, 0, 0

    def of(self, chunk: bytes) -> tuple:
        got = self.kept.get(chunk)
        if got is None:
            got = summary(chunk)
            self.made += 1
            self.kept[chunk] = got
            self.size += len(chunk) + 200
            while self.size > self.room and len(self.kept) > 1:
                old = next(iter(self.kept))
                del self.kept[old]
                self.size -= len(old) + 200
        return got


def summary(chunk: bytes) -> tuple:
    """Code points, offsets after each line end (bytes, code points), marker."""
    b = np.frombuffer(chunk, np.uint8)
    chars = np.cumsum((b & 0xC0) != 0x80, dtype=np.int32)
    at = np.flatnonzero(b == 10)
    return int(chars[-1]), (at + 1).tolist(), chars[at].tolist(), any(m in chunk for m in MARKS)


class Lines:
    """Line and code point counts of one text, from its chunks' summaries."""

    def __init__(self, data: bytes, ends: list[int], start: int, seen: Summaries):
        self.data, self.size = data[start:ends[-1]] if ends else b"", ends[-1] - start if ends else 0
        self.first, self.lines, self.chars, self.parts, self.marked = [], [0], [0], [], False
        at = start
        for e in ends:
            got = seen.of(data[at:e])
            self.first.append(at - start)
            self.parts.append(got)
            self.lines.append(self.lines[-1] + len(got[1]))
            self.chars.append(self.chars[-1] + got[0])
            joint = data[max(start, at - 2):at + 2]
            self.marked |= got[3] or b"<" in joint and any(m in joint for m in MARKS)
            at = e
        open_end = self.size and not self.data.endswith(b"\n")
        self.n = self.lines[-1] + bool(open_end)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the end of line ``units``."""
        if not units:
            return 0, 0
        if units > self.lines[-1]:
            return self.size, self.chars[-1]
        k = int(np.searchsorted(self.lines, units)) - 1
        _, byte, char, _ = self.parts[k]
        i = units - self.lines[k] - 1
        return self.first[k] + byte[i], self.chars[k] + char[i]


def draws(doc_id, seed: int = SEED) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k:8 * k + 8], 16) for k in range(4)]


def transform(doc_id, text: Lines, seed: int, rate: int, spm: int) -> tuple:
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text.size or text.marked or h3 % 100 >= rate:
        return text.n, "plain", None, None, text.data
    a, b = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    (a, ca), (b, cb) = text.cut(a), text.cut(b)
    prefix, middle, suffix = text.data[:a], text.data[a:b], text.data[b:]
    if h4 % 100 < spm:
        return text.n, "spm", ca, cb - ca, b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle))
    return text.n, "psm", ca, cb - ca, b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle))


def _blocks(texts: list[bytes], room: int = 4 << 20) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= room:
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Every row with its number of lines ``n``, ``form``, ``prefix_chars``,
    ``middle_chars`` and ``output``.  ``rate`` percent of the texts are cut,
    ``spm`` percent of those suffix first."""

    @F.arrow_udf(OUT)
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        seen = Summaries()
        for ids, texts in columns:
            ids, texts = ids.to_pylist(), [t or b"" for t in texts.to_pylist()]
            rows = []
            for lo, hi in _blocks(texts):
                data = b"".join(texts[lo:hi])
                places, at = cut_places(np.frombuffer(data, np.uint8)), 0
                for i in range(lo, hi):
                    ends = chunk_ends(at, at + len(texts[i]), places)
                    rows.append(transform(ids[i], Lines(data, ends, at, seen), seed, rate, spm))
                    at += len(texts[i])
            n, form, prefix, middle, output = zip(*rows) if rows else ([],) * 5
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                                              pa.array(middle, pa.int64()), pa.array(output, pa.binary())], names=COLUMNS)

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    got = docs.select(whole, run(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("binary")).alias("__fim"))
    keep = [F.col(f"__row.`{c}`") for c in docs.columns if c.lower() not in COLUMNS]
    return got.select(*keep, *[(F.col(f"__fim.{c}").cast("string") if c == "output" else F.col(f"__fim.{c}")).alias(c) for c in COLUMNS])


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, rebuilt from a transformed one."""
    out, kind = F.col(output), F.col(form)
    part = F.split(out, "<[PSM]>", -1)            # [1], [2], [3]: the pieces in written order
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out)
