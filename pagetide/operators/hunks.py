"""Ordered line hunks between two versions of a text, in near-linear time, and the way back from hunks to the new version.

Lines that stand once on either side are anchors; the longest run of them that goes up on both sides splits the texts, and
what lies between is treated alike. Where no line is unique any more, the n-th copies of a line are paired instead.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import count

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HUNKS = "array<struct<op:string,pos:int,line:string>>"
DEPTH = 16  # rounds of unique anchors, so that time stays within so many passes over both texts


def line_hunks(before: Column, after: Column) -> Column:
    """Removed (-) and added (+) lines in order, with their line numbers from 1. A null counts as empty, which is one empty line."""

    @F.pandas_udf(HUNKS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([hunks(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=object)

    return run(before, after)


def patched(before: Column, found: Column) -> Column:
    """The new version from the old one and its hunks: kept lines fill, in order, the places that no added line takes."""
    lines = F.split(F.coalesce(before, F.lit("")), "\n", -1)
    gone, new = F.filter(found, lambda h: h["op"] == "-"), F.filter(found, lambda h: h["op"] == "+")
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform(gone, lambda h: h["pos"]))
    size = F.size(kept) + F.size(new)
    free = F.array_except(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), F.transform(new, lambda h: h["pos"]))
    moved = F.transform(F.arrays_zip(free.alias("pos"), kept.alias("old")), lambda x: F.struct(x["pos"].alias("pos"), F.get(lines, x["old"] - 1).alias("line")))
    return F.array_join(F.transform(F.array_sort(F.concat(moved, F.transform(new, lambda h: F.struct(h["pos"].alias("pos"), h["line"].alias("line"))))), lambda x: x["line"]), "\n")


def hunks(before: str, after: str) -> list[dict]:
    a, b = before.split("\n"), after.split("\n")
    out: list[dict] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, j, k, m, depth = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        pairs = anchors(a, b, i, j, k, m, depth < DEPTH) if i < j and k < m and depth <= DEPTH else []
        if pairs:
            starts = [(i, k), *((x + 1, y + 1) for x, y in pairs)]
            parts = [(*s, *e) for s, e in zip(starts, [*pairs, (j, m)], strict=True)]
            todo += [(x, u, y, v, depth + 1) for x, y, u, v in reversed(parts) if x < u or y < v]
        else:
            out += [{"op": "-", "pos": n + 1, "line": a[n]} for n in range(i, j)]
            out += [{"op": "+", "pos": n + 1, "line": b[n]} for n in range(k, m)]
    return out


def anchors(a: list[str], b: list[str], i: int, j: int, k: int, m: int, unique: bool) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, going up on both sides."""
    pairs: list[tuple[int, int]] = []
    if unique:
        n_a, n_b = Counter(a[i:j]), Counter(b[k:m])
        place = {b[y]: y for y in range(k, m) if n_b[b[y]] == 1}
        pairs = [(x, place[a[x]]) for x in range(i, j) if n_a[a[x]] == 1 and a[x] in place]
    if not pairs:
        nth: dict[str, count] = defaultdict(count)
        place = {(b[y], next(nth[b[y]])): y for y in range(k, m)}
        nth = defaultdict(count)
        keys = ((x, (a[x], next(nth[a[x]]))) for x in range(i, j))
        pairs = [(x, place[key]) for x, key in keys if key in place]
    return rising(pairs)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (their first places go up) whose second places go up too."""
    ends: list[int] = []  # least last second place of a run of each length
    at: list[int] = []  # its pair
    back = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        length = bisect_left(ends, y)
        back[n] = at[length - 1] if length else -1
        ends[length : length + 1] = [y]
        at[length : length + 1] = [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]
