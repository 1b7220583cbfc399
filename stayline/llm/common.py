"""Helpers shared by the corpus operators: table access, durable
intermediate tables, and vectorised word / shingle hashing inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import scratch_path

U64 = np.uint64
_P = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and reread it:
    lineage is cut, and later reads prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POW = {"f": np.ones(1, U64), "b": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P**i`` and ``P**-i`` modulo 2**64 for ``i < n``."""
    if len(_POW["f"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in (("f", _P), ("b", _PINV)):
            t = np.full(size, base, U64)
            t[0] = 1
            _POW[k] = np.multiply.accumulate(t)
    return _POW["f"][:n], _POW["b"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes that are not ASCII white
    space) of all texts in order, and ``first`` of length ``len(texts)+1``:
    text ``i`` owns words ``first[i]:first[i+1]``."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    fwd, back = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * fwd[:-1], out=run[1:])
    h = mix64((run[end] - run[start]) * back[start])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return h, np.searchsorted(start, at)


def shingle_sets(texts: list[bytes], width: int = 5, chunk: int = 2_000_000):
    """For each text the sorted distinct 64-bit hashes of its runs of
    ``width`` words.  A text of fewer words has one shingle, all its words;
    a text without words has none."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= chunk):
            size += len(texts[hi])
            hi += 1
        w, first = word_hashes(texts[lo:hi])
        n = max(0, len(w) - width + 1)
        s = np.zeros(n, U64)
        for k in range(width):
            s = s * U64(0xD6E8FEB86659FD93) + w[k:k + n]
        s = mix64(s)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(s[a:b - width + 1])
            elif b > a:
                t = U64(0)
                with np.errstate(over="ignore"):
                    for x in w[a:b]:
                        t = t * U64(0xA24BAED4963EE407) + x
                yield mix64(np.array([t + U64(b - a)], U64))
            else:
                yield np.empty(0, U64)
        lo = hi


def as_bytes(name: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)
