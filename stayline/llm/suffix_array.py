"""A two-stage suffix sort of one bounded buffer, and the groups of equal
strings of a fixed length that its adjacent common prefixes show.

Suffixes smaller than their successor are sorted directly, by words of
eight bytes up to the depth asked for.  The others are induced: buckets are
scanned in byte order, and every suffix met puts its predecessor, if
larger, at the front part of the bucket of its first byte."""

from __future__ import annotations

import numpy as np


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; beyond
    the end there are zeros."""
    w = np.zeros(len(buf) + 8, np.uint64)
    w[:len(buf)] = buf
    for k in (1, 2, 4):
        w[:-k] = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w[:len(buf)]


def smaller_than_next(buf: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (the empty suffix at
    the end is the smallest)."""
    n = len(buf)
    last = np.append(np.flatnonzero(buf[1:] != buf[:-1]), n - 1)      # ends of runs of one byte
    up = np.zeros(len(last), bool)
    up[:-1] = buf[last[:-1]] < buf[last[:-1] + 1]
    return np.repeat(up, np.diff(last, prepend=-1))


def _dense(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    s = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
    return out


def sort_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes."""
    n = len(w)
    order = at[np.argsort(w[at])] if len(at) else at
    v = w[order]
    head = np.append(True, v[1:] != v[:-1])[:len(order)]
    for d in range(8, depth, 8):
        group = np.cumsum(head)
        tied = ~head
        tied[:-1] |= ~head[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        pos = order[idx] + d
        v = np.where(pos < n, w[np.minimum(pos, n - 1)], 0)
        key = (group[idx] << 32) | _dense(v)
        by = np.argsort(key)
        order[idx] = order[idx][by]
        key = key[by]
        head[idx[1:]] |= key[1:] != key[:-1]
    return order


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """All positions of ``buf`` in the order of their suffixes, exact for the
    first ``depth`` bytes at least."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64)
    up = smaller_than_next(buf)
    w = words8(buf)
    direct = sort_directly(np.flatnonzero(up), w, depth)
    first = buf[direct]
    cut = np.searchsorted(first, np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {int(buf[n - 1]): [np.array([n - 1])]}
    out = []
    for c in range(256):
        front = waiting.pop(c, [])
        cur = np.concatenate(front) if front else np.empty(0, np.int64)
        parts = []
        while len(cur):                                   # runs of the byte c
            parts.append(cur)
            cur = cur[cur > 0] - 1
            cur = cur[buf[cur] == c]
        full = np.concatenate([*parts, direct[cut[c]:cut[c + 1]]])
        out.append(full)
        before = full[full > 0] - 1
        before = before[buf[before] > c]
        if len(before):
            head = buf[before]
            by = np.argsort(head, kind="stable")
            before, head = before[by], head[by]
            for part in np.split(before, np.flatnonzero(head[1:] != head[:-1]) + 1):
                waiting.setdefault(int(buf[part[0]]), []).append(part)
    return np.concatenate(out)


def equal_strings(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions with ``starts`` set in suffix order, and for each whether it
    begins a new group: its common prefix with the one before is below
    ``length``.  A string at a start must lie inside ``buf``."""
    sa = suffix_array(buf, length)
    sa = sa[starts[sa]]
    w = words8(buf)
    same = np.arange(1, len(sa))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for d in steps:
        same = same[w[sa[same] + d] == w[sa[same - 1] + d]]
    new = np.ones(len(sa), bool)
    new[same] = False
    return sa, new
