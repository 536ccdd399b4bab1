"""Alignment scores that built-in functions can't express, as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def semi_global(short: str, long: str) -> int:
    """Least edit distance of ``short`` to any substring of ``long``.

    One row of the table per base of the short string, vectorised along the
    long one: the running minimum settles insertions.
    """
    a, b = _codes(short), _codes(long)
    ramp = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for i, letter in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (b != letter), out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def turned(s: str) -> str:
    """Reverse complement."""
    return s[::-1].translate(_COMPLEMENT)


def semi_global_both(a: str, b: str) -> int:
    """Of the shorter in the longer string, the better of both strands."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return min(semi_global(short, long), semi_global(short, turned(long)))


def edit_distance(a: str, b: str) -> int:
    """Unit-cost distance of two whole strings, one row of the table per base of ``a``."""
    x, y = _codes(a), _codes(b)
    ramp = np.arange(len(y) + 1)
    row = ramp.copy()
    for i, letter in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (y != letter), out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row[-1])


def edit_both(a: str, b: str) -> int:
    """The smaller distance over both strands of ``a``."""
    return min(edit_distance(a, b), edit_distance(turned(a), b))


def ungapped_score(a: str, b: str) -> int:
    """Best local score without gaps: 2 for a match, -1 for a mismatch."""
    x, y = _codes(a), _codes(b)
    row, best = np.zeros(len(y) + 1, np.int64), 0
    for letter in x:
        row[1:] = np.maximum(row[:-1] + np.where(y == letter, 2, -1), 0)
        row[0] = 0
        best = max(best, int(row.max()))
    return best


def matches_without_gaps(a: str, b: str) -> int:
    """Most equal bases of two strings laid along each other at any offset."""
    x, y = _codes(a), _codes(b)
    if not len(x) or not len(y):
        return 0
    equal = sum(np.convolve((x == letter).astype(float), (y == letter)[::-1].astype(float)) for letter in np.unique(x))
    return int(equal.round().max())


def _pairwise(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return F.pandas_udf(run, LongType())


semi_global_distance = _pairwise(semi_global_both)
semi_global_one_strand = _pairwise(lambda a, b: semi_global(*sorted((a, b), key=len)))
ungapped_local_score = _pairwise(ungapped_score)
ungapped_matches = _pairwise(matches_without_gaps)


def register(spark) -> None:
    """Make the functions callable from SQL."""
    spark.udf.register("semi_global_distance", semi_global_distance)
    spark.udf.register("ungapped_local_score", ungapped_local_score)
