"""Edit-aware token counts over pre-token segment trees.

A document is cut into leaves of about ``LEAF`` characters, only where a
word is followed by a blank or line feed, or where a letter and a mark other
than an apostrophe meet: byte-level pre-tokens never cross such a place, so leaf
counts add up to the count of the whole text.
A binary tree over the leaves keeps characters and tokens per subtree.  An
edit (start, characters to delete, text to insert) re-encodes the leaves it
touches and one more on either side, whose outer ends it can't move, cuts
them anew and updates the sums above them; a leaf that is as before isn't
encoded again.  If the number of leaves changes, the tree is built over the kept
counts again, so leaves stay small however many edits meet.  Edits are applied one after another; positions
are code points in the text as edited so far and are held inside it.

The leaves can be kept (``leaf_chars``, ``leaf_tokens``) and handed back with
later edits, so that an unchanged document is never encoded again.

Cases.  Null text is empty: one empty leaf, no tokens.  Null edits, or an
empty list, change nothing; a null field of an edit is 0 or empty.  A text
without a cut place is one leaf.  Columns ``edits``, ``leaf_chars`` and
``leaf_tokens`` of other types, and all further ones, are ignored.  Text that looks like a special token is
ordinary text.  Repeated rows are counted each.  An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 256
# Fixed value: the pre-token pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EDITS = "array<struct<start:long,n:long,insert:string>>"
_CUT = re.compile(r"(?<=\w)(?=[ \n])|(?<=[^\W\d_])(?=[^\w\s'])|(?<=[^\w\s'])(?=[^\W\d_])")
SCHEMA = ("doc_id long, n_chars long, n_tokens long, n_edits int, n_chars_edited long, n_tokens_edited long, "
          "n_leaves int, chars_encoded_again long, leaf_chars array<int>, leaf_tokens array<int>")


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    import tiktoken
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    out, lo = [], 0
    while len(text) - lo > leaf and (m := _CUT.search(text, lo + leaf)):
        out.append(text[lo:m.start()])
        lo = m.start()
    return [*out, text[lo:]]


class TokenTree:
    """Leaves of one document with subtree sums of characters and tokens."""

    def __init__(self, text: str, count, leaf: int = LEAF, chars=None, tokens=None):
        self.count, self.leaf, self.again = count, leaf, 0
        if chars is not None and len(chars) and sum(chars) == len(text):
            ends = np.concatenate([[0], np.cumsum(chars)]).tolist()
            self.text, own = [text[a:b] for a, b in zip(ends, ends[1:])], list(tokens)
        else:
            self.text = leaves(text, leaf)
            own = [count(t) for t in self.text]
        self._build(own)

    def _build(self, own: list[int]) -> None:
        self.size = 1 << max(0, len(self.text) - 1).bit_length()
        self.tokens, self.chars = ([0] * (2 * self.size) for _ in range(2))
        self.tokens[self.size:self.size + len(own)] = own
        self.chars[self.size:self.size + len(own)] = [len(t) for t in self.text]
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        for s in (self.tokens, self.chars):
            s[k] = s[2 * k] + s[2 * k + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at`` (the last one at the end), and where it starts."""
        k, lo = 1, 0
        while k < self.size:
            k *= 2
            if at - lo >= self.chars[k] and self.chars[k + 1]:
                lo += self.chars[k]
                k += 1
        return k - self.size, lo

    def edit(self, start: int, n: int, insert: str) -> None:
        total = self.chars[1]
        start = min(max(start, 0), total)
        n = min(max(n, 0), total - start)
        a, first = self._find(max(start - 1, 0))
        b, _ = self._find(min(start + n, max(total - 1, 0)))
        # one leaf with text more on either side
        before = next((k for k in range(a - 1, -1, -1) if self.text[k]), a)
        if before < a:
            first -= len(self.text[before])
            a = before
        b = next((k for k in range(b + 1, len(self.text)) if self.text[k]), b)
        old = "".join(self.text[a:b + 1])
        at = start - first
        new = old[:at] + insert + old[at + n:]
        known = {self.text[k]: self.tokens[self.size + k] for k in range(a, b + 1)}
        parts = leaves(new, self.leaf)
        for t in parts:
            if t not in known:
                known[t] = self.count(t)
                self.again += len(t)
        if len(parts) != b - a + 1:
            own = self.tokens[self.size:self.size + len(self.text)]
            self.text[a:b + 1], own[a:b + 1] = parts, [known[t] for t in parts]
            self._build(own)
            return
        for k, t in zip(range(a, b + 1), parts):
            self.text[k] = t
            self.tokens[self.size + k], self.chars[self.size + k] = known[t], len(t)
        ks = set(range((self.size + a) // 2, (self.size + b) // 2 + 1))
        while ks and 0 not in ks:
            for k in ks:
                self._sum(k)
            ks = {k // 2 for k in ks}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Token counts before and after the edits of every document.  ``docs``
    has ``doc_id``, ``text`` and may have ``edits`` (``EDITS``) and kept leaves;
    ``vocabulary`` is a path that every executor can read."""
    kinds = {f.name: f.dataType for f in docs.schema}
    numbers = lambda c: isinstance(kinds.get(c), T.ArrayType) and isinstance(kinds[c].elementType, T.IntegralType)
    edit = kinds.get("edits")
    edited = isinstance(edit, T.ArrayType) and isinstance(edit.elementType, T.StructType) and edit.elementType.names == ["start", "n", "insert"]
    kept = numbers("leaf_chars") and numbers("leaf_tokens")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        (F.col("edits").cast(EDITS) if edited else F.lit(None).cast(EDITS)).alias("edits"),
        *[(F.col(c) if kept else F.lit(None)).cast("array<int>").alias(c) for c in ("leaf_chars", "leaf_tokens")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        count = lambda t: len(encode(t)) if t else 0
        for batch in batches:
            got = []
            for r in batch.itertuples(index=False):
                tree = TokenTree(r.text, count, leaf, r.leaf_chars, r.leaf_tokens)
                before = tree.tokens[1]
                edits = [] if r.edits is None else r.edits
                for e in edits:
                    tree.edit(*[int(e[k]) if e[k] is not None and e[k] == e[k] else 0 for k in ("start", "n")], e["insert"] or "")
                live = [k for k, t in enumerate(tree.text) if t]
                got.append((r.doc_id, len(r.text), before, len(edits), tree.chars[1], tree.tokens[1], len(live), tree.again,
                            [tree.chars[tree.size + k] for k in live], [tree.tokens[tree.size + k] for k in live]))
            frame = pd.DataFrame(got, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(run, SCHEMA)


def revision() -> Column:
    """The edits that the registered query applies to every document: a
    sentence inserted at a quarter, 40 characters replaced by the text's first
    60 in the middle, 30 characters deleted at three quarters."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    part = lambda k: F.floor(n * k / 4).cast("long")
    one = lambda s, k, t: F.struct(s.alias("start"), F.lit(k).cast("long").alias("n"), t.alias("insert"))
    return F.array(one(part(1), 0, F.lit(" Revised on 12 May 2024.")),
                   one(part(2), 40, F.substring(F.coalesce("text", F.lit("")), 1, 60)),
                   one(part(3), 30, F.lit("")))
