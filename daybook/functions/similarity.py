"""Name similarity: Jaro-Winkler, its bounds for names that end in numbers, and one name's words within another's."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .text import fold_text


def _matched(a: str, b: str, reach: int) -> tuple[list[str], list[str]]:
    """The characters of a and b that match, each side's in its own order."""
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if free[j] and b[j] == c), None)
        if at is not None:
            free[at] = False
            left.append(c)
    return left, [c for c, f in zip(b, free, strict=True) if not f]


def _reach(a: int, b: int) -> int:
    return max(0, max(a, b) // 2 - 1)


def _jaro_of(m: int, unlike: int, a: int, b: int) -> float:
    """Of lengths a and b with m characters matched, unlike of which meet another one when both sides are read in order."""
    return (m / a + m / b + (m - unlike / 2) / m) / 3 if m else 0.0


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    left, right = _matched(a, b, _reach(len(a), len(b)))
    return _jaro_of(len(left), sum(x != y for x, y in zip(left, right, strict=True)), len(a), len(b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, closer to 1 by a tenth for each of up to four equal first characters; no least similarity for that."""
    j, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


_DIGITS = "0123456789"


def numbered_bounds(a: str, da: int, b: str, db: int) -> tuple[float, float]:
    """The least and the greatest Jaro-Winkler similarity that a with da digits behind it and b with db digits may have.

    Characters match like ones only, so those of the stems that are no digits match the same way whatever the digits are. Of the
    digits none to all may match. Where the stems have none of their own, what the digits change in order is among them alone.
    """
    la, lb = len(a) + da, len(b) + db
    if not la or not lb:
        return (1.0, 1.0) if la == lb else (0.0, 0.0)
    left, right = _matched(a.translate(str.maketrans(_DIGITS, "\0" * 10)), b.translate(str.maketrans(_DIGITS, "\1" * 10)), _reach(la, lb))
    m, unlike = len(left), sum(x != y for x, y in zip(left, right, strict=True))
    inside = [sum(c in _DIGITS for c in s) for s in (a, b)]
    most, mixed = min(inside[0] + da, inside[1] + db), any(inside)
    low = min(_jaro_of(m + k, m + k if mixed else unlike + k, la, lb) for k in range(most + 1))
    high = _jaro_of(m + most, 0 if mixed else unlike, la, lb)
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    boost = lambda j, n: j + min(4, n) * 0.1 * (1 - j)
    return boost(low, same), boost(high, 4 if same == min(len(a), len(b)) else same)


def numbered_near_udf(least: float) -> Callable[..., Column]:
    """For two stems with their numbers' lengths: 1 if all such names are at least so similar, 0 if none is, else -1."""

    def near(a: str, da: int, b: str, db: int) -> int:
        ends = [*numbered_bounds(a, da, b, db), *numbered_bounds(b, db, a, da)]
        return 1 if min(ends) >= least + 1e-9 else 0 if max(ends) < least - 1e-9 else -1

    @F.pandas_udf(IntegerType())
    def told(a: pd.Series, da: pd.Series, b: pd.Series, db: pd.Series) -> pd.Series:
        return pd.Series([near(*x) for x in zip(a, da, b, db, strict=True)], dtype="int32")

    return told


def name_words(key: Column) -> Column:
    """The distinct words of a folded name."""
    return F.array_distinct(F.filter(F.split(key, r"\s+"), lambda w: w != ""))


def contained(a: str, b: str) -> bool:
    x, y = set(fold_text(a).split()), set(fold_text(b).split())
    return bool(x and y) and (x < y or y < x)
