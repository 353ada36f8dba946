"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A Column used twice in an expression may be computed twice, and one used inside
    a lambda is computed per element; binding it through a one-element array avoids
    both for costly values such as a split or a regex scan.
    """
    return F.transform(F.array(value), body).getItem(0)


def count_substring(text: ColumnOrName, piece: str) -> Column:
    t = col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(piece), F.lit("")))) / F.lit(len(piece))
