"""Document fingerprints as threshold-scaled sketches.

A fingerprint keeps every five-word shingle hash below a fixed fraction of
the hash range (``1 / SCALE``), so its length follows the text, two sketches
merge by union, and the share of one sketch found in another estimates
containment whatever the two lengths.

The successor of a document (descending id, the last followed by the first)
is found without a global window: documents are dealt into ranges of the
id, sorted in each range, and the first document of every range is also sent
to the range before it.  Ranges come from a mergeable quantile summary of the
ids, so the texts are shuffled once.

Cases.  Null text is empty.  A text of fewer than five words has one
shingle, a text without words has none; two empty sketches are alike (1.0) if
the texts are equal, else 0.0.  Rows with equal ids stay in one range, ordered
by text; null ids come last.  A single document is its own successor.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import U64, shingle_sets

SCALE = 8
HEX = 12                       # hex digits that a fingerprint shows of a hash
RANGE_ROWS = 4000              # documents in a range, about
MAX_RANGES = 20_000
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, contained_in_edited double, contained_in_next double")


def sketch(shingles: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sorted hashes below ``2**64 / scale``."""
    return shingles[:np.searchsorted(shingles, U64((1 << 64) // scale))]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def alike(a: np.ndarray, b: np.ndarray, equal: bool) -> tuple[float, float]:
    """Estimated Jaccard similarity, and containment of ``a`` in ``b``."""
    if equal or not len(a) and not len(b):
        return float(equal), float(equal)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a) if len(a) else 0.0


def show(a: np.ndarray) -> str:
    step = HEX // 2
    return np.ascontiguousarray(a.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :step].tobytes().hex()


def _cuts(docs: DataFrame, range_rows: int) -> list[float]:
    """Cut points of the id, at most ``MAX_RANGES`` numbers."""
    parts = max(1, min(MAX_RANGES, docs.count() // range_rows))
    if parts == 1:
        return []
    return sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))


def fingerprint_documents(docs: DataFrame, scale: int = SCALE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document with its fingerprint, that of its edited text
    (second half replaced by the first half's length of its successor), and
    the likeness to the edited text and to the successor."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _cuts(rows, range_rows)
    if cuts:
        inf = float("inf")
        cut = Bucketizer(splits=[-inf, *cuts, inf], inputCol="__id", outputCol="__b", handleInvalid="keep")
        rows = cut.transform(rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-inf))))
    else:
        rows = rows.withColumn("__b", F.lit(0))
    rows = rows.select("doc_id", "text", (F.lit(len(cuts)) - F.col("__b")).cast("int").alias("__r"))   # descending id
    heads = (rows.groupBy(F.col("__r").alias("p")).agg(F.max("doc_id").alias("head"))
             .orderBy("p").collect())                       # one row per range
    used = [r.p for r in heads]
    before = {p: used[i - 1] for i, p in enumerate(used)}    # the first range follows the last
    halo = spark.createDataFrame([(p, r.head, before[p]) for p, r in zip(used, heads)], "__p int, __head long, __to int")
    dealt = rows.withColumnRenamed("__r", "__p").join(F.broadcast(halo), "__p")
    to = F.when(F.col("doc_id").eqNullSafe(F.col("__head")), F.array(F.struct(F.col("__p").alias("p"), F.lit(False).alias("halo")),
                                                                     F.struct(F.col("__to").alias("p"), F.lit(True).alias("halo"))))
    dealt = dealt.select("doc_id", "text", F.explode(F.coalesce(to, F.array(F.struct(F.col("__p").alias("p"), F.lit(False).alias("halo"))))).alias("x"))
    dealt = dealt.select("x.p", "x.halo", "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by (range, halo, id descending, text); the row after a range's own last is its first halo row
        ahead: list = []                                     # rows whose successor isn't known yet: one at most

        def out(pairs: list) -> pd.DataFrame:
            texts = [p[1] for p in pairs]
            nexts = [p[2] for p in pairs]
            edited = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts, nexts)]
            raw = [e.encode("utf-8", "surrogatepass") for e in edited]
            k = len(texts)
            # the successor of a row is mostly the next row: its sketch is made once
            uniq: dict[str, int] = {}
            for t in (*texts, *nexts):
                uniq.setdefault(t, len(uniq))
            sk = [sketch(s, scale) for s in shingle_sets([t.encode("utf-8", "surrogatepass") for t in uniq])]
            ed = [sketch(s, scale) for s in shingle_sets(raw)]
            got = []
            for i in range(k):
                a, b = sk[uniq[texts[i]]], sk[uniq[nexts[i]]]
                je, ce = alike(a, ed[i], texts[i] == edited[i])
                jn, cn = alike(a, b, texts[i] == nexts[i])
                got.append((pairs[i][0], len(texts[i]), hashlib.sha256(raw[i]).hexdigest(), show(a), show(ed[i]), je, jn, ce, cn))
            frame = pd.DataFrame(got, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for batch in batches:
            pairs, size = [], 0
            for p, halo, i, t in zip(batch["p"], batch["halo"], batch["doc_id"], batch["text"]):
                if ahead and ahead[0][0] == p:
                    pairs.append((ahead[0][1], ahead[0][2], t))
                    size += len(ahead[0][2])
                    ahead = []
                if not halo:
                    ahead = [(p, None if pd.isna(i) else int(i), t)]
                if size > 4_000_000:
                    yield out(pairs)
                    pairs, size = [], 0
            if pairs:
                yield out(pairs)

    n = max(1, len(used))
    return (dealt.repartition(n, "p").sortWithinPartitions("p", "halo", F.col("doc_id").desc_nulls_last(), "text")
            .mapInPandas(run, SCHEMA))
