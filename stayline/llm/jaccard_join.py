"""N-gram Jaccard self-join by chosen paths.

Sets are the distinct five-word shingles of whole texts; two documents are
linked when the Jaccard similarity of their sets is ``THRESHOLD`` at least.

1. Equal sets form one class (a hot group of copies is one row from here on).
   A class has ``MINHASHES`` minimum hashes as its sampled tokens.
2. Chosen paths.  At every node of a run, the node's own randomness chooses
   one token position, and a second one with probability ``1/threshold -
   1``, so that a pair at the threshold is expected to stay together in one
   child.  Sets that share the token go on together.  A bucket with
   ``BUCKET`` sets at most is a leaf; so is one whose sets agree on their next
   token as often as similar sets do (it would not shrink), and one at
   ``DEPTH``.  Larger ones are split again.  Runs repeat until a pair at the
   threshold is found with the chance ``RECALL``, over the number of sampled
   tokens that it shares, all runs reading the same tokens, the bound of step
   3 and the full depth included (``recall_of``, ``runs_for``).
3. Leaves are brute-forced on the sampled tokens, a bucket larger than
   ``BLOCK`` in blocks and pairs of blocks, each a group of its own, and leave a
   spanning forest of the pairs that may be similar.  A cell of two blocks
   adds only what joins their own components.
4. The components of that forest are small groups of likely copies.  Their
   whole sets are compared exactly, again by pairs of blocks: every pair
   counts towards its two classes' numbers of links, and a spanning forest
   of the exact links, as stars around the smallest set id, gives the final classes.  Pairs are never written out.

So the links found are exact; a pair is missed only if no run kept it
together and no chain of likely pairs does.

Cases.  A text of fewer than five words has one shingle, all its words; null
text and text without words have an empty set, are linked to nothing, and
each row is its own class.  Repeated rows and equal texts are linked to each
other.  ``class_id`` is the smallest document id of the class (null if all are
null).  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import U64, as_bytes, mix64, saved, shingle_sets

THRESHOLD = 0.8
RECALL = 0.999
WIDTH = 5
MINHASHES = 96
BUCKET = 32          # sets that a leaf may have without more splitting
BLOCK = 256          # sets that are compared at once
DEPTH = 6
LIKELY = 0.15        # a sampled similarity this far below the threshold still goes to the exact check

_SEEDS = mix64(np.arange(1, MINHASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def signature(shingles: np.ndarray) -> bytes:
    """The minimum of every hash function over the set, 32 bits each."""
    low = np.full(MINHASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 1024):
        h = (shingles[i:i + 1024, None] * _SEEDS) >> U64(32)
        low = np.minimum(low, h.min(0).astype(np.uint32))
    return low.tobytes()


def survival(shared: float, threshold: float, depth: int) -> float:
    """Chance that one run keeps a pair that shares this part of its sampled
    tokens together down to ``depth``."""
    second, alive = 1 / threshold - 1, 1.0
    for _ in range(depth):
        one = 1 - shared * alive
        alive = 1 - ((1 - second) * one + second * one * one)
    return alive


def recall_of(threshold: float, runs: int, depth: int, likely: float, minhashes: int = MINHASHES) -> float:
    """Chance that a pair at the threshold, alone, is found by ``runs`` runs and
    is likely enough for the exact check."""
    total = 0.0
    for k in range(math.ceil((threshold - likely) * minhashes - 1e-9), minhashes + 1):
        p = math.comb(minhashes, k) * threshold ** k * (1 - threshold) ** (minhashes - k)
        total += p * (1 - (1 - survival(k / minhashes, threshold, depth)) ** runs)
    return total


def runs_for(threshold: float, recall: float, depth: int, likely: float) -> int:
    """The fewest runs that reach the recall; more than 200 is an error."""
    for runs in range(1, 201):
        if recall_of(threshold, runs, depth, likely) >= recall:
            return runs
    raise ValueError(f"a recall of {recall} needs more sampled tokens, less depth or a lower bound")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, set_id, sig) of every row; an empty set has no set_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), as_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, sigs = [], []
            for s in shingle_sets(list(b["text"]), WIDTH):
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"], "set_id": ids, "sig": sigs})

    return rows.mapInPandas(run, "doc_id long, key long, set_id binary, sig binary")


def _token(path, salt: str):
    """The token at the position that the node ``path`` chooses."""
    at = F.pmod(F.xxhash64(F.lit(salt), path), F.lit(MINHASHES)).cast("int")
    return F.xxhash64(path, at, F.substring(F.col("sig"), at * 4 + 1, F.lit(4)))


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """(parent, path, set_id, sig): the nodes that each set goes on to."""
    two = F.pmod(F.xxhash64(F.lit("second"), "path"), F.lit(1 << 20)) < int((1 / threshold - 1) * (1 << 20))
    nodes = F.when(two, F.array(_token(F.col("path"), "a"), _token(F.col("path"), "b"))).otherwise(F.array(_token(F.col("path"), "a")))
    return rows.select(F.col("path").alias("parent"), "set_id", "sig", F.explode(F.array_distinct(nodes)).alias("path"))


def buckets(sets: DataFrame, threshold: float, runs: int, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(path, set_id, n): the leaves with two sets or more, over all runs."""
    rows = sets.select("set_id", "sig", F.explode(F.sequence(F.lit(1), F.lit(runs)).cast("array<long>")).alias("path"))
    out, stay = None, (threshold + bucket / (bucket + 1)) / 2 * threshold
    for level in range(depth):
        kids = _children(rows, threshold).drop("sig")
        if level:
            kids = saved(kids, f"paths-{level}")
        sizes = kids.groupBy("parent", "path").agg(F.count("*").alias("n")).where("n > 1")
        sizes = saved(sizes, f"sizes-{level}")
        here = kids.join(sizes.drop("parent"), "path").drop("parent")
        last = level == depth - 1
        # a large bucket whose sets mostly agree on what its node chose is brute-forced too
        if level and not last:
            total = kids.groupBy("parent", "set_id").agg(F.count("*").alias("k")).groupBy("parent").agg(F.sum("k").alias("all"))
            like = (sizes.join(total, "parent").groupBy("path").agg(F.max(F.col("n") / F.col("all")).alias("like")))
            here = here.join(like, "path")
            leaf = (F.col("n") <= bucket) | (F.col("like") >= stay)
        else:
            leaf = F.lit(True) if last else F.col("n") <= bucket
        done = saved(here.where(leaf).select("path", "set_id", "n"), f"leaves-{level}")      # small plans: one level each
        out = done if out is None else out.unionByName(done)
        if last or sizes.where(F.col("n") > bucket).isEmpty():
            break
        rows = saved(here.where(~leaf).select("set_id", "path").join(sets.select("set_id", "sig"), "set_id"), f"frontier-{level}")
    return out


def blocked(rows: DataFrame, group: str, size: str, item: str, block: int = BLOCK) -> DataFrame:
    """Deal every group over pairs of blocks: (cell, side, ...), where a cell
    has the rows of one block (side 0) or of two (0 and 1).  A group of
    ``n`` rows has about n/block blocks by a hash of the item."""
    g = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("__g", g).withColumn("__b", F.pmod(F.xxhash64(F.lit("block"), item), F.col("__g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__g") - 1), lambda k: F.struct(
        F.least(k, F.col("__b")).alias("lo"), F.greatest(k, F.col("__b")).alias("hi")))
    rows = rows.withColumn("__p", F.explode(pairs))
    return (rows.withColumn("cell", F.xxhash64(group, "__p.lo", "__p.hi")).withColumn("alone", F.col("__p.lo") == F.col("__p.hi"))
            .withColumn("side", (F.col("__b") == F.col("__p.hi")).cast("int")).drop("__g", "__b", "__p"))


def _labels(close: np.ndarray) -> np.ndarray:
    """The first row of every row's component of a symmetric closeness matrix."""
    n = len(close)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(close, label[None, :], n).min(1, initial=n))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _joints(close: np.ndarray, side: np.ndarray, alone: bool) -> list[tuple[int, int]]:
    """Edges (row, first row of its component) that a cell adds: all of a lone
    block's; of two blocks, whose own components their lone cells give, one for
    each component that they join."""
    joint = _labels(close)
    own = np.arange(len(close)) if alone else _labels(close & (side[:, None] == side[None, :]))
    roots = np.flatnonzero(own == np.arange(len(own)))
    return [(i, j) for i, j in zip(roots.tolist(), joint[roots].tolist()) if i != j]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Whole cells, as arrays by column in the order of the set ids, out of
    batches sorted by cell."""
    rest: list[dict] = []

    def whole() -> dict:
        cell = rest[0] if len(rest) == 1 else {k: np.concatenate([r[k] for r in rest]) for k in rest[0]}
        order = np.argsort(cell["set_id"])
        return {k: v[order] for k, v in cell.items()}

    for b in batches:
        cols = {k: b[k].to_numpy() for k in b.columns}
        ends = [*(np.flatnonzero(np.diff(cols["cell"])) + 1).tolist(), len(b)]
        lo = 0
        for hi in ends if len(b) else ():
            if rest and rest[0]["cell"][0] != cols["cell"][lo]:
                yield whole()
                rest = []
            rest.append({k: v[lo:hi] for k, v in cols.items()})
            lo = hi
    if rest:
        yield whole()


def _links(close: np.ndarray, side: np.ndarray, alone: bool):
    """Index pairs (i < j) of a symmetric closeness matrix that the cell is in
    charge of: across its two blocks, or inside its only one."""
    mask = np.triu(close, 1)
    if not alone:
        mask &= side[:, None] != side[None, :]
    return np.nonzero(mask)


def likely(cells: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """Spanning edges (a, b) of sets whose sampled similarity is ``at_least``."""
    rows = cells.join(sets.select("set_id", "sig"), "set_id").select("cell", "side", "alone", "set_id", "sig")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _cells(batches):
            n = len(c["cell"])
            sig = np.frombuffer(b"".join(c["sig"]), np.uint32).reshape(n, MINHASHES)
            same = np.zeros((n, n), np.int16)
            for k in range(MINHASHES):
                same += sig[:, k][:, None] == sig[:, k][None, :]
            ids = list(c["set_id"])
            edges = [(ids[a], ids[b]) for a, b in _joints(same >= at_least * MINHASHES, c["side"], bool(c["alone"][0]))]
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a binary, b binary").distinct()


def _is_star(e: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root hangs on another."""
    roles = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return roles.groupBy("u").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(set_id, comp) of every set with an edge, by alternating star
    contraction: neighbours move to the smallest id that one of them knows."""
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    for _ in range(60):
        if _is_star(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
               .where("u <> v").distinct())
        e = saved(nxt, f"{name}-star")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("set_id"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("set_id"), F.col("v").alias("comp")).distinct())


def exact(cells: DataFrame, threshold: float) -> DataFrame:
    """Per cell and class its number of linked documents (b null), and
    spanning edges (a, b) of the exact links (linked null)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _cells(batches):
            ids, copies = list(c["set_id"]), c["copies"]
            sets = [np.frombuffer(s, U64) for s in c["shingles"]]
            size = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            code, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = times[back] > 1                          # a shingle of one set only is in no intersection
            own, tok = owner[shared], (np.cumsum(times > 1) - 1)[back[shared]]
            width = int((times > 1).sum())
            both = np.zeros((len(sets), len(sets)), np.float32)
            for lo in range(0, width, 4096):
                here = (tok >= lo) & (tok < lo + 4096)
                m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
                m[own[here], tok[here] - lo] = 1
                both += m @ m.T
            close = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            i, j = _links(close, c["side"], bool(c["alone"][0]))
            linked = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            got = [(ids[k], None, int(n)) for k, n in enumerate(linked) if n]
            got += [(ids[x], ids[y], None) for x, y in _joints(close, c["side"], bool(c["alone"][0]))]
            if got:
                out = pd.DataFrame(got, columns=["a", "b", "linked"])
                out["linked"] = out["linked"].astype("Int64")
                yield out

    return (cells.repartition("cell").sortWithinPartitions("cell")
            .mapInPandas(run, "a binary, b binary, linked long"))


def _shingles(rows: DataFrame, columns: str) -> DataFrame:
    """Replace ``text`` by the set's shingle hashes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(shingles=[s.tobytes() for s in shingle_sets(list(b["text"]), WIDTH)])
            yield b.drop(columns="text")

    return rows.mapInPandas(run, columns)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id``, ``key`` (hash of its text), ``class_id``,
    ``n_links`` (documents at the threshold or above, itself excluded) and
    ``copies`` (documents with an equal set)."""
    sk = saved(sketches(docs), "sketches")
    sets = saved(sk.where("set_id is not null").groupBy("set_id").agg(
        F.min(F.coalesce("doc_id", F.lit(2 ** 63 - 1))).alias("first_id"),
        F.min_by("key", F.coalesce("doc_id", F.lit(2 ** 63 - 1))).alias("key"), F.count("*").alias("copies")), "sets")
    rep = F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("first_id")
    sigs = sk.where("sig is not null").select("set_id", rep, "key", "sig").join(
        sets.drop("copies"), ["set_id", "first_id", "key"], "left_semi").dropDuplicates(["set_id"]).select("set_id", "sig")
    sigs = saved(sigs, "signatures")
    leaves = buckets(sigs, threshold, runs_for(threshold, recall, DEPTH, LIKELY), bucket)
    edges = likely(blocked(leaves, "path", "n", "set_id"), sigs, threshold - LIKELY)
    comp = saved(components(edges, "likely"), "likely")
    sized = comp.join(comp.groupBy("comp").agg(F.count("*").alias("n")), "comp").join(sets, "set_id")
    texts = docs.select(rep, F.xxhash64("text").alias("key"), as_bytes()).join(sized, ["first_id", "key"])
    full = _shingles(texts.select("comp", "n", "set_id", "copies", "text"), "comp binary, n long, set_id binary, copies long, shingles binary")
    cells = blocked(full.dropDuplicates(["set_id"]), "comp", "n", "set_id").select("cell", "side", "alone", "set_id", "copies", "shingles")
    found = saved(exact(cells, threshold), "links")
    links = found.where("linked is not null").groupBy(F.col("a").alias("set_id")).agg(F.sum("linked").alias("linked"))
    classes = components(found.where("b is not null").select("a", "b"), "classes")
    named = classes.join(sets.select("set_id", "first_id"), "set_id")
    named = named.join(named.groupBy("comp").agg(F.min("first_id").alias("class_id")), "comp").select("set_id", "class_id")
    info = (sets.join(links, "set_id", "left").join(named, "set_id", "left")
            .select("set_id", "copies", F.coalesce("class_id", "first_id").alias("class_id"),
                    (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    none = 2 ** 63 - 1
    return (sk.select("doc_id", "key", "set_id").join(info, "set_id", "left")
            .select("doc_id", "key", F.when(F.col("set_id").isNull(), F.col("doc_id")).when(F.col("class_id") == none, F.lit(None))
                    .otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("copies", F.lit(1)).alias("copies")))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` without the later documents of each class: the one
    with the smallest id stays.  Of rows that agree in id and text one
    stays; rows with a null id, or without words, all stay."""
    got = jaccard_join(docs.select("doc_id", "text"), **params).where("doc_id is not null")
    got = saved(got.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.first(F.col("class_id") != F.col("doc_id")).alias("later"), F.first("copies").alias("copies"), F.count("*").alias("rows")), "verdicts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__key"))
    again = got.where("rows > 1 and rows <= copies and not later").select("__id", "__key")
    gone = got.where("later").select("__id", "__key").unionByName(again)
    once = rows.join(again, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.first("__row").alias("__row"))
    kept = rows.join(gone, ["__id", "__key"], "left_anti").select("__row").unionByName(once.select("__row"))
    return kept.select(*[F.col(f"__row.`{c}`") for c in docs.columns])
