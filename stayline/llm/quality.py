"""Quality classifier on random-indexing word vectors.

* **Word vectors.**  Every token has a sparse ternary index vector drawn from
  its hash.  A token's vector is the sum of the index vectors of its
  neighbours within ``WINDOW`` tokens, over all documents of the table: each
  task adds up one integer matrix, and the matrices are added by a grouped
  sum.  Tokens are runs of letters, digits and non-ASCII bytes, and runs of
  other visible bytes, in their own case; they share ``2 ** BITS`` rows, so the
  matrix has a fixed size and is what the tasks get to see of the corpus.
* **Pooling.**  A document is the mean and the spread of its tokens' vectors,
  and how alike neighbouring tokens' vectors are.
* **Network.**  Two layers in NumPy, fitted on the pooled vectors of at most
  ``PER_CLASS`` labelled documents per class (those with the smallest hash of
  the id), then a temperature fitted on a fifth of them kept apart, so the
  scores are probabilities.

Labels, language, source and id are no inputs of a score.

Cases.  Null and empty texts, and texts of white space, have a zero vector
and get the network's score of it.  Labels of a null id, null labels and
labels of no document teach nothing; an id with labels of both classes
teaches both, an id with several texts one of them (that of the smallest
pooled vector).  Without two classes every score is the smoothed share of
class 1.  A document of a null id is not held out.  Very long texts are pooled
whole, in blocks of ``BLOCK`` bytes, across whose ends tokens aren't neighbours.
Input columns named as a result column are replaced, others are kept.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import U64, _powers, mix64

BITS = 16                      # the token rows: 65,536
DIMS = 32
MARKS = 4                      # non-zero entries of an index vector
WINDOW = 2
PER_CLASS = 10_000             # labelled documents learnt from, per class
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 0.01, 1e-4
SEED = 11
BLOCK = 1 << 20                # bytes tokenised at once
OUT = ("held_out", "score", "predicted")

_KIND = np.ones(256, np.uint8)                       # 0 space, 1 word, 2 other
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[b for b in range(0x21, 0x80) if not chr(b).isalnum()] + [*range(9), *range(0x0E, 0x20)]] = 2


def tokens(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the tokens of all texts in order, and ``first`` of length
    ``len(texts) + 1``: text ``i`` owns tokens ``first[i]:first[i+1]``."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[buf]
    new = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    start, end = new[:-1], new[1:]
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    fwd, back = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * fwd[:-1], out=run[1:])
    h = mix64((run[end] - run[start]) * back[start])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return (h >> U64(64 - bits)).astype(np.int64), np.searchsorted(start, at)


def blocks(texts: list[bytes], room: int = BLOCK) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Groups of about ``room`` bytes with the text each piece belongs to.  A
    longer text is cut at spaces, or where a block ends without one."""
    group, owner, size = [], [], 0
    for i, t in enumerate(texts):
        while True:
            cut = len(t)
            if cut > room:
                cut = t.rfind(b" ", 1, room) if b" " in t[1:room] else room
            group.append(t[:cut])
            owner.append(i)
            size += cut
            t = t[cut:]
            if size >= room:
                yield group, np.array(owner)
                group, owner, size = [], [], 0
            if not t:
                break
    if group:
        yield group, np.array(owner)


def index_vectors(rows: np.ndarray, dims: int = DIMS, marks: int = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries, one line per token row."""
    h = mix64(rows.astype(U64)[:, None] * U64(marks) + np.arange(1, marks + 1, dtype=U64))
    return (h >> U64(32)).astype(np.int64) % dims, np.where(h & U64(1), 1, -1).astype(np.int64)


def add_contexts(total: np.ndarray, b: np.ndarray, first: np.ndarray, place: np.ndarray, sign: np.ndarray, window: int = WINDOW) -> None:
    """Add the index vectors of all neighbours to ``total`` (rows x dims)."""
    flat, dims = total.reshape(-1), total.shape[1]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for gap in range(1, window + 1):
        same = text[gap:] == text[:-gap]
        x, y = b[:-gap][same], b[gap:][same]
        for own, other in ((x, y), (y, x)):
            for k in range(place.shape[1]):
                np.add.at(flat, own * dims + place[other, k], sign[other, k])


def context_sums(docs: DataFrame, text: str = "text", bits: int = BITS, dims: int = DIMS, window: int = WINDOW) -> DataFrame:
    """(row, n, c0 ...): occurrences and summed contexts of every token row
    that occurs, over all documents."""
    names = ["n", *[f"c{i}" for i in range(dims)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << bits
        place, sign = index_vectors(np.arange(n), dims)
        total, seen, some = np.zeros((n, dims), np.int64), np.zeros(n, np.int64), False
        for batch in batches:
            for group, _ in blocks([t or b"" for t in batch.column(0).to_pylist()]):
                b, first = tokens(group, bits)
                seen += np.bincount(b, minlength=n)
                add_contexts(total, b, first, place, sign, window)
                some = True
        if some:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), *[pa.array(c) for c in total[at].T]], names=["row", *names])

    sums = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in names))
    return sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])


def word_vectors(docs: DataFrame, text: str = "text", bits: int = BITS, dims: int = DIMS, window: int = WINDOW) -> np.ndarray:
    """The unit vectors of all token rows (``2 ** bits`` x ``dims``, fixed
    size): contexts less what the corpus expects, in direction only."""
    got = context_sums(docs, text, bits, dims, window).toArrow()
    out = np.zeros((1 << bits, dims))
    if got.num_rows:
        at = got.column("row").to_numpy()
        n = got.column("n").to_numpy()
        c = np.stack([got.column(f"c{i}").to_numpy() for i in range(dims)], 1).astype(float)
        c -= n[:, None] * (c.sum(0) / n.sum())
        out[at] = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return out.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One line per text: mean and spread of its tokens' vectors, and the
    mean product and the share of equal ones among neighbours."""
    bits, dims = len(vectors).bit_length() - 1, vectors.shape[1]
    sums, n = np.zeros((len(texts), 2 * dims + 2)), np.zeros(len(texts))
    for group, owner in blocks(texts):
        b, first = tokens(group, bits)
        if not len(b):
            continue
        v = vectors[b]
        like = np.zeros((len(b), 2), np.float32)
        like[1:, 0] = np.einsum("ij,ij->i", v[1:], v[:-1])
        like[1:, 1] = b[1:] == b[:-1]
        like[first[:-1][first[:-1] < len(b)]] = 0
        size = np.diff(first)
        some = np.flatnonzero(size)
        got = np.hstack([np.add.reduceat(x, first[:-1][some], axis=0, dtype=np.float64) for x in (v, v * v, like)])
        np.add.at(sums, owner[some], got)
        np.add.at(n, owner[some], size[some])
    m = sums / np.maximum(n, 1)[:, None]
    mean, square = m[:, :dims], m[:, dims:2 * dims]
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), m[:, 2 * dims:], (n > 0)[:, None]]).astype(np.float32)


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    """The network's logits."""
    h = np.tanh((x - net["mean"]) / net["std"] @ net["w1"] + net["b1"])
    return h @ net["w2"] + net["b2"]


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    if "share" in net:
        return np.full(len(x), net["share"])
    return 1 / (1 + np.exp(-np.clip(forward(net, x) / net["temperature"], -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Two layers by Adam on the log loss, in a fixed order of steps."""
    rng = np.random.default_rng(seed)
    net = {"mean": x.mean(0), "std": np.maximum(x.std(0), 1e-6)}
    z = (x - net["mean"]) / net["std"]
    p = {"w1": rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden ** -0.5, hidden), "b2": np.zeros(())}
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for epoch in range(epochs):
        rate, order = RATE * (1 - epoch / epochs), rng.permutation(len(z))
        for lo in range(0, len(z), BATCH):
            at = order[lo:lo + BATCH]
            h = np.tanh(z[at] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -60, 60))) - y[at]) / len(at)
            back = np.outer(d, p["w2"]) * (1 - h * h)
            grad = {"w1": z[at].T @ back + DECAY * p["w1"], "b1": back.sum(0), "w2": h.T @ d + DECAY * p["w2"], "b2": d.sum()}
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return {**net, **p}


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits))))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    lo, hi, r = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        if log_loss(logits / np.exp(a), y) <= log_loss(logits / np.exp(b), y):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray, seed: int = SEED) -> dict:
    """Network on the rows not set ``apart``, temperature on those that are."""
    if len(set(y[~apart].tolist())) < 2:
        return {"share": float((y.sum() + 1) / (len(y) + 2))}
    net = fit_network(x[~apart], y[~apart], seed=seed)
    net["temperature"] = fit_temperature(forward(net, x[apart]), y[apart]) if len(set(y[apart].tolist())) == 2 else 1.0
    return net


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def learning_labels(labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labels of each class outside the held-out third:
    those whose ids have the smallest hashes."""
    rows = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 1))
            .select("doc_id", F.col(label).cast("int").alias("y")).distinct())
    pick = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return reduce(DataFrame.unionByName, (pick(0), pick(1)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, bits: int = BITS, dims: int = DIMS) -> dict:
    """Word vectors from all of ``docs``, the network from labelled ones."""
    vectors = word_vectors(docs, bits=bits, dims=dims)
    taught = docs.join(F.broadcast(learning_labels(labels, label, per_class)), "doc_id")
    taught = taught.select("doc_id", "y", pooling(vectors)(F.col("text").cast("binary")).alias("x")).groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    key, y = taught.column("doc_id").to_numpy().astype(np.int64), taught.column("y").to_numpy().astype(int)
    x = taught.column("x").combine_chunks().flatten().to_numpy().reshape(len(key), 2 * dims + 3)
    order = np.lexsort((y, key))
    key, x, y = key[order], x[order].astype(float), y[order]
    return {"vectors": vectors, "net": fit(x, y, mix64(key.astype(U64)) % U64(5) == 0)}


def pooling(vectors: np.ndarray):
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        x = pooled([t or b"" for t in texts.to_pylist()], vectors)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
    return run


def score_quality(docs: DataFrame, labels: DataFrame | None = None, model: dict | None = None, **params) -> DataFrame:
    """Every row with ``held_out``, ``score`` (the probability of class 1)
    and ``predicted``; the model is trained on ``docs`` and ``labels`` unless
    given."""
    model = train(docs.select("doc_id", "text"), labels, **params) if model is None else model
    vectors, net = model["vectors"], model["net"]

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(probabilities(net, pooled([t or b"" for t in texts.to_pylist()], vectors)))

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    got = docs.select(whole, F.coalesce(remainder() == 1, F.lit(False)).alias("__out"), run(F.col("text").cast("binary")).alias("__score"))
    return got.select(*[F.col(f"__row.`{c}`") for c in docs.columns if c.lower() not in OUT], F.col("__out").alias("held_out"),
                      F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
