"""String similarities of the Indel family, 0 to 100."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, [shared, " ".join(sorted(d))])) for d in (x - y, y - x))
    pairs = [(left, right)] + [(shared, left), (shared, right)] * bool(shared)
    return max(ratio(p, q) for p, q in pairs)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against a window of the longer, windows over its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    best = max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))
    return max(best, max(ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n))) if len(a) == len(b) else best


#: Pairs whose score a Python worker keeps, as candidates repeat.
KEPT = 1 << 16


@lru_cache(KEPT)
def _title(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return max(ratio(a.replace(" ", ""), b.replace(" ", "")), token_sort_ratio(a, b))


@lru_cache(KEPT)
def _artist(names: tuple[str | None, ...], s: str | None) -> float:
    if not s:
        return 0.0
    scores = [max(token_set_ratio(v, s), ratio(v, s), partial_ratio(v, s) if len(v) >= 4 else 0.0) for v in names if v]
    return max(scores, default=0.0)


@lru_cache(KEPT)
def _audit(names: tuple[str | None, ...], s: str) -> float:
    return max((max(partial_ratio(v, s), token_set_ratio(v, s)) for v in names if v), default=0.0)


@F.pandas_udf(T.DoubleType())
def title_score(clean_a: pd.Series, clean_b: pd.Series) -> pd.Series:
    """Of two cleaned titles: the better of the glued and the word-sorted ratio; 0 if either is empty."""
    return pd.Series([_title(a, b) for a, b in zip(clean_a, clean_b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def artist_score(variants: pd.Series, artist: pd.Series) -> pd.Series:
    """The best of an artist's cleaned variants against a cleaned name; partial matches need four characters."""
    return pd.Series([0.0 if v is None else _artist(tuple(v), s) for v, s in zip(variants, artist)], dtype=float)


@F.pandas_udf(T.DoubleType())
def audit_score(variants: pd.Series, artist: pd.Series) -> pd.Series:
    """The audit's score: raw names, partial or word-set ratio."""
    return pd.Series([0.0 if s is None or v is None else _audit(tuple(v), s) for v, s in zip(variants, artist)], dtype=float)


@F.pandas_udf(T.StructType().add("title", "double").add("artist", "double").add("ratio", "double"))
def all_scores(clean_a: pd.Series, clean_b: pd.Series) -> pd.DataFrame:
    """Of two cleaned strings: title_score, artist_score of one variant, and the plain ratio; 0 where one is null."""
    rows = [(0.0, 0.0, 0.0) if a is None or b is None else (_title(a, b), _artist((a,), b), ratio(a, b)) for a, b in zip(clean_a, clean_b)]
    return pd.DataFrame(rows, columns=["title", "artist", "ratio"], dtype=float)
