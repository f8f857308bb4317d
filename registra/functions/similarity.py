"""Jaro-Winkler similarity over whole Arrow batches.

Spark has no built-in for it. Names become matrices of UTF-8 bytes and the matching loop runs once per
position for all pairs of a batch at the same time, so Python cost does not grow with rows. Places of names of up
to 64 bytes are the bits of one number. Bytes and not characters are compared, as SQL engines do, which only
shows in accented names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_WEIGHT = 0.1
PREFIX_LENGTH = 4
BOOST_ABOVE = 0.7
WORD = 64


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (rows padded with 0) and lengths."""
    lengths = np.fromiter(map(len, values), dtype=np.int32, count=len(values))
    width = max(int(lengths.max(initial=0)), 1)
    fixed = np.array(values, dtype=f"S{width}")
    return fixed.view(np.uint8).reshape(len(values), width), lengths


def _matched_matrix(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of both sides are matched, for names of any length."""
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    columns = np.arange(b.shape[1])
    taken_b = columns[None, :] >= lb[:, None]  # padding can never be matched
    taken_a = np.zeros(a.shape, dtype=bool)
    rows = np.arange(len(la))
    for i in range(a.shape[1]):
        fits = (
            (b == a[:, i : i + 1])
            & ~taken_b
            & (columns[None, :] >= (i - reach)[:, None])
            & (columns[None, :] <= (i + reach)[:, None])
        )
        first = fits.argmax(axis=1)
        hit = fits[rows, first] & (i < la)
        taken_a[:, i] = hit
        taken_b[rows[hit], first[hit]] = True
    taken_b &= columns[None, :] < lb[:, None]
    return taken_a, taken_b


def _matched_words(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where both have at most 64 columns: a row's places are the bits of one number."""
    one, width = np.uint64(1), b.shape[1]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    # Bits below lb, without a shift by 64.
    free = np.where(lb > 0, ~np.uint64(0) >> (WORD - np.maximum(lb, 1)).astype(np.uint64), np.uint64(0))
    valid = free.copy()
    # Places from i - reach to i + reach, for i = 0 and then one further each time.
    near = (one << (reach + 1).astype(np.uint64)) - one
    equal = np.zeros((len(la), 8), dtype=np.uint8)
    taken_a = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        packed = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little")
        equal[:, : packed.shape[1]] = packed
        fits = equal.view("<u8")[:, 0] & free & near
        fits[i >= la] = 0
        taken_a[:, i] = fits != 0
        free &= ~(fits & (~fits + one))
        near = (near << one) | (i < reach)
    bits = (valid & ~free).astype("<u8").view(np.uint8).reshape(-1, 8)
    return taken_a, np.unpackbits(bits, axis=1, count=width, bitorder="little").astype(bool)


def jaro_winkler_codes(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Similarity of row i of `a` with row i of `b`."""
    n = len(la)
    if n == 0:
        return np.zeros(0)
    rows = np.arange(n)
    taken_a, taken_b = (_matched_words if max(a.shape[1], b.shape[1]) <= WORD else _matched_matrix)(a, la, b, lb)
    matches = taken_a.sum(axis=1)

    # Matched characters of both sides in order: k-th match of a against k-th match of b. Both masks
    # hold the same number of true cells per row, so row-major extraction pairs them up.
    differs = a[taken_a] != b[taken_b]
    owner = np.repeat(rows, matches)
    swapped = np.bincount(owner[differs], minlength=n) // 2

    m = matches.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(matches > 0, (m / la + m / lb + (m - swapped) / m) / 3.0, 0.0)
    width = min(PREFIX_LENGTH, a.shape[1], b.shape[1])
    same = a[:, :width] == b[:, :width]
    same &= (np.arange(width)[None, :] < la[:, None]) & (np.arange(width)[None, :] < lb[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    known = left.notna() & right.notna()
    scores = similarities(left.fillna("").to_numpy(dtype=object), right.fillna("").to_numpy(dtype=object))
    return pd.Series(scores, index=left.index).where(known)


def name_similarity(left: Column, right: Column) -> Column:
    return _jaro_winkler(left, right)


def with_postcode_bonus(score: Column, same_postcode: Column) -> Column:
    """Five points more for an equal postcode, never above 1."""
    bonus = F.when(F.coalesce(same_postcode, F.lit(False)), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), score + bonus)


CELLS_PER_STEP = 4_000_000


def similarities(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of left[i] with right[i] for string arrays of any length.

    Pairs are taken in length order, so one very long name does not widen the matrices of all others.
    """
    scores = np.zeros(len(left))
    sides = [[name.encode() for name in side] for side in (left, right)]
    longest = np.fromiter((max(len(a), len(b)) for a, b in zip(*sides)), dtype=np.int64, count=len(left))
    order = np.argsort(longest, kind="stable")
    start = 0
    while start < len(order):
        stop = min(len(order), start + max(1, CELLS_PER_STEP // max(1, int(longest[order[start]]))))
        while stop > start + 1 and (stop - start) * longest[order[stop - 1]] > CELLS_PER_STEP:
            stop = start + (stop - start + 1) // 2
        step = order[start:stop]
        scores[step] = jaro_winkler_codes(*[part for side in sides for part in _matrix([side[i] for i in step.tolist()])])
        start = stop
    return scores
