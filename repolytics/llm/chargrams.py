"""Hashed character n-grams of many texts at once, in numpy.

Texts are laid end to end as code points with boundaries (0) between words and texts.
The n-grams of all positions are hashed together; bucket 0 stands for "no n-gram here",
so a table whose row 0 is zero can be looked up without a mask, and sums over texts are
one reduction a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BATCH_CHARS = 500_000


@lru_cache(maxsize=2)
def kept(what: str) -> np.ndarray:
    """Which code points are no boundary: letters, or all but white space."""
    test = str.isalpha if what == "letters" else lambda c: not c.isspace()
    table = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    table[0] = False
    return table


def pieces(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[list[str], np.ndarray]]:
    """Batches of bounded size: (parts of texts, number of the text of each part).

    Only a text longer than a batch has several parts, cut before white space.
    """
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text) or not at:
            end = len(text) if len(text) - at <= most else text.find(" ", at + most)
            end = len(text) if end < 0 else end
            parts.append(text[at:end])
            owners.append(i)
            size += end - at + 1
            at = max(end, 1)
            if size >= most:
                yield parts, np.array(owners)
                parts, owners, size = [], [], 0
    if parts:
        yield parts, np.array(owners)


def laid_out(parts: list[str], what: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(code points with 0 at boundaries, where each part starts)."""
    if lower:
        parts = [p.lower() for p in parts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = "\0" + "\0".join(parts) + "\0" * 5
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(kept(what)[points], points, np.uint32(0)), np.r_[0, np.cumsum(sizes + 1)[:-1]]


def grams(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket (a power of two of them) of the n-gram at every position; 0 for none.

    An n-gram may begin or end with a boundary, but not run across one.
    """
    m = len(points) - n + 1
    h = points[:m] * np.uint32(0x9E3779B1) + np.uint32(n)
    for k in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[k : k + m]
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(16)
    if n <= 2:
        valid = points[:m] > 0
        if n == 2:
            valid |= points[1 : 1 + m] > 0
    else:
        valid = points[1 : 1 + m] > 0
        for k in range(2, n - 1):
            valid &= points[k : k + m] > 0
    return np.where(valid, np.maximum(h & np.uint32(buckets - 1), np.uint32(1)), np.uint32(0)).astype(np.int32)


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every run between boundaries."""
    inside = points > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    mixed = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    place = np.arange(len(points), dtype=np.uint64)
    place -= np.repeat(np.r_[np.uint64(0), starts.astype(np.uint64)], np.diff(np.r_[0, starts, len(points)]))
    salted = (mixed + place * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    salted = (salted ^ (salted >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    sums = np.r_[np.uint64(0), np.cumsum(salted, dtype=np.uint64)]
    return starts, sums[ends] - sums[starts]
