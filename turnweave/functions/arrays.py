"""Array functions: padding, flipping, masking, thinning, batching shapes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.features import apply_1d


def pad_right(x: Column, length: Column | int, value: Column) -> Column:
    """``x`` followed by ``value`` up to ``length``; longer arrays stay whole."""
    return F.concat(x, F.array_repeat(value, F.greatest(F.lit(0), F.lit(length) - F.size(x)) if isinstance(length, int) else F.greatest(F.lit(0), length - F.size(x))))


def pad_left(x: Column, length: Column | int, value: Column) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(value, F.greatest(F.lit(0), n - F.size(x))), x)


def head(x: Column, n: int) -> Column:
    return F.slice(x, 1, n)


def tail(x: Column, n: int) -> Column:
    """The last ``n`` elements, or all if there are fewer."""
    return F.slice(x, F.greatest(F.size(x) - n, F.lit(0)) + 1, n)


def flip_channels(x: Column) -> Column:
    """Two channels swapped; one channel stays."""
    return F.when(F.size(x) == 2, F.array(x[1], x[0])).otherwise(x)


def thin(x: Column, k: int) -> Column:
    """Every ``k``-th element, the first included."""
    return F.filter(x, lambda _, i: i % k == 0)


def set_where(x: Column, test, value: Column) -> Column:
    return F.transform(x, lambda v: F.when(test(v), value).otherwise(v))


def indices_where(x: Column, test) -> Column:
    """Positions (from 0) of the elements for which ``test`` holds."""
    return F.filter(F.transform(x, lambda v, i: F.when(test(v), i)), lambda i: i.isNotNull())


def changes(x: Column) -> Column:
    """Whether each element but the first differs from the one before."""
    n = F.size(x)
    return F.when(n < 2, F.array().cast("array<boolean>")).otherwise(F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b != a))


def running_sum(x: Column) -> Column:
    """Sums of all elements up to each one, in one pass over Arrow arrays: an expression would copy the sums so far at
    every element."""
    return apply_1d(x, np.cumsum)


def argmax(x: Column) -> Column:
    """Position (from 0) of the first greatest element; null for an empty array."""
    return F.when(F.size(x) > 0, F.array_position(x, F.array_max(x)) - 1)


def repeat_last(x: Column, length: Column) -> Column:
    """Padded to ``length`` with its last element, an empty one with 0."""
    return pad_right(x, length, F.coalesce(F.get(x, F.size(x) - 1), F.lit(0.0)))
