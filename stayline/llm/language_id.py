"""Language identification by hierarchical discrimination.

A linear support vector machine per family (one against the rest) picks the
language family; inside it, one linear machine per pair of languages
votes.  Features are the square roots of relative frequencies of hashed
lower-cased byte bigrams and trigrams over the whole text, so they use only
the text.

Training reads a bounded sample: about ``PER_LANGUAGE`` labelled documents of
each language, chosen by a hash of the id, never those whose crc32(id) modulo
4 is 2 (they are held out).  Every document is predicted.

Cases.  Null text and text without a letter give ``und`` with score 0.  A
null language is not learned from, a null id neither (its remainder is
unknown; it counts as not held out).  With one learned language that one is
predicted; with none everything is ``und``.  Repeated rows get equal
predictions.  An empty table gives an empty result.  Input columns named like
an output column are replaced.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import saved

PER_LANGUAGE = 600
MAX_LANGUAGES = 400
DIMS = 2048
FIT_PARTS = 4
MIN_SCORE = 0.5
OUT = ("held_out", "lang_pred", "score")
# ISO 639-1 codes by family; a language of no family listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi".split(),
    "romance": "es fr it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "indo-aryan": "hi bn ur pa gu mr ne si".split(),
    "semitic": "ar he am mt".split(),
}

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(26):
    _FOLD[0x41 + _c] = _FOLD[0x61 + _c] = 0x61 + _c


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def features(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """Square roots of relative n-gram frequencies, one row per text."""
    out = np.zeros((len(texts), dims), np.float32)
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    b = _FOLD[buf]
    upper = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
    b[upper] += 0x20
    keep = b != 0x20
    keep[1:] |= b[:-1] != 0x20
    at = np.cumsum(keep)
    b = b[keep].astype(np.uint32)
    two = (b[:-1] * 257 + b[1:]) * np.uint32(2654435761)
    three = ((b[:-2] * 257 + b[1:-1]) * 257 + b[2:] + 7) * np.uint32(2246822519)
    shift = 32 - (dims - 1).bit_length()
    two, three = (two >> shift).astype(np.int64), (three >> shift).astype(np.int64)
    lo = 0
    for i, t in enumerate(texts):
        s, e = at[lo] - 1, at[lo + len(t) + 1]               # with the blank on either side
        lo += len(t) + 1
        n = 2 * (e - s) - 3
        if n > 0:
            x = np.bincount(two[s:e - 1], minlength=dims) + np.bincount(three[s:e - 2], minlength=dims)
            out[i] = np.sqrt(x / n)
    return out


def _chunks(texts: pd.Series, size: int = 2_000_000):
    part: list[bytes] = []
    total = 0
    for t in texts:
        t = (t or "").encode("utf-8", "surrogatepass")
        if part and (total + len(t) > size or len(part) >= 2000):
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, dims: int = DIMS) -> dict:
    """The learned machines: languages, and weights per family and pair."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(counts)
    model = {"langs": langs, "families": {}, "steps": [], "w": np.zeros((dims, 0), np.float32), "b": np.zeros(0, np.float32)}
    for lang in langs:
        model["families"].setdefault(family_of(lang), []).append(lang)
    if len(langs) < 2:
        return model
    scale = 1_000_000
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, per_language / counts[lang]) * scale))])
    vector = F.pandas_udf(lambda t: pd.Series([x.astype(float) for part in _chunks(t) for x in features(part, dims)]), "array<double>")
    sample = (rows.where(F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(scale)) < limit[F.col("lang")])
              .select("lang", vector("text").alias("features")))
    # the bounded sample, featurised once; the machines' many short passes read it from a few cached partitions
    sample = saved(sample, "language-sample").select("lang", array_to_vector("features").alias("features")).coalesce(FIT_PARTS).cache()
    families, todo = sorted(model["families"]), []
    if len(families) > 1:
        todo += [(("family", f), model["families"][f], None) for f in (families[1:] if len(families) == 2 else families)]
    for f in families:
        own = model["families"][f]
        todo += [((f, a, c), [a], [c]) for i, a in enumerate(own) for c in own[i + 1:]]

    def fit(step: tuple, plus: list, minus: list | None):
        part = sample if minus is None else sample.where(F.col("lang").isin(plus + minus))
        svm = LinearSVC(regParam=1e-4, maxIter=15, tol=1e-3, standardization=False)
        return svm.fit(part.withColumn("label", F.col("lang").isin(plus).cast("double")))

    with ThreadPoolExecutor(FIT_PARTS) as pool:            # the fits are independent jobs of many short passes
        machines = list(pool.map(lambda x: fit(*x), todo))
    sample.unpersist()
    return model | {"steps": [x[0] for x in todo], "w": np.array([m.coefficients.toArray() for m in machines], np.float32).T.copy(),
                    "b": np.array([m.intercept for m in machines], np.float32)}


def decide(margins: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of decision values."""
    n = len(margins)
    sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
    families, col = sorted(model["families"]), {s: i for i, s in enumerate(model["steps"])}
    score = np.ones(n)
    if len(families) == 1:
        family = np.zeros(n, int)
    elif len(families) == 2:
        m = margins[:, col["family", families[1]]]
        family, score = (m > 0).astype(int), sure(np.abs(m))
    else:
        m = margins[:, [col["family", f] for f in families]]
        family = m.argmax(1)
        score = sure(m.max(1))
    lang = np.zeros(n, dtype=object)
    for k, f in enumerate(families):
        at = np.flatnonzero(family == k)
        own = model["families"][f]
        votes, least = np.zeros((len(at), len(own))), np.ones((len(at), len(own)))
        for i, a in enumerate(own):
            for j in range(i + 1, len(own)):
                m = margins[at, col[f, a, own[j]]]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                least[:, i] = np.minimum(least[:, i], sure(m))
                least[:, j] = np.minimum(least[:, j], sure(-m))
        best = (votes + 0.5 * least).argmax(1)
        lang[at] = np.array(own, dtype=object)[best]
        score[at] = np.minimum(score[at], least[np.arange(len(at)), best])
    return list(lang), np.clip(score, 0.0, 1.0)


def identify_language(docs: DataFrame, model: dict | None = None, per_language: int = PER_LANGUAGE, dims: int = DIMS) -> DataFrame:
    """Every row with ``held_out``, ``lang_pred`` and ``score``; the machines
    are trained on ``docs`` unless given."""
    model = train(docs, per_language, dims) if model is None else model
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUT]

    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = [], []
        for part in _chunks(texts):
            a, b = decide(features(part, dims) @ model["w"] + model["b"], model)
            lang += a
            score += list(b)
        return pd.DataFrame({"lang": lang, "score": score})

    if model["langs"]:
        got = F.pandas_udf(predict, "lang string, score double")("text")
    else:
        got = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return (docs.select(*keep, _held_out().alias("held_out"), letter.alias("__letter"), got.alias("__got"))
            .withColumn("lang_pred", F.when(F.col("__letter"), F.col("__got.lang")).otherwise("und"))
            .withColumn("score", F.when(F.col("__letter"), F.col("__got.score")).otherwise(0.0).cast("double"))
            .drop("__letter", "__got"))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE, **params) -> DataFrame:
    """The rows of ``docs`` in an identified language: not ``und``, and with a
    score of ``min_score`` at least in every decision."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    got = identify_language(docs.select(F.struct(*cols).alias("__row"), "doc_id", "text", "lang"), **params)
    return (got.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
            .select(*[F.col(f"__row.`{c}`") for c in docs.columns]))
