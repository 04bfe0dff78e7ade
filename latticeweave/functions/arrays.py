"""The array toolbox as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_transform(a, f) -> Column:
    return F.transform(a, f)


def array_reduce(a, base, f) -> Column:
    """Fold from a base value; the base's type is the result's."""
    return F.aggregate(a, base, f)


def array_collapse(a, f) -> Column:
    """Fold from the first element; null for an empty array."""
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.try_element_at(a, F.lit(1)), f))


def array_fill(a, value) -> Column:
    return F.transform(a, lambda _: F.lit(value) if not isinstance(value, Column) else value)


def array_fill_interval(a, begin, end, value) -> Column:
    """The value at indices [begin, end), the rest as it is."""
    return F.transform(a, lambda x, i: F.when((i >= begin) & (i < end), value).otherwise(x))


def array_fill_list(a, values) -> Column:
    """The listed values in place of the array's, in order. A list of another size leaves what it doesn't reach."""
    listed = F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)) if not isinstance(values, Column) else values
    return F.transform(a, lambda x, i: F.coalesce(F.try_element_at(listed, i + 1), x))


def array_fill_from(a, other) -> Column:
    """The other array's values, in order (nulls leave what stands there)."""
    return array_fill_list(a, other)


def array_none(a, f=lambda x: x) -> Column:
    return ~F.exists(a, f)


def array_any(a, f=lambda x: x) -> Column:
    return F.exists(a, f)


def array_not_all(a, f=lambda x: x) -> Column:
    return ~F.forall(a, f)


def array_all(a, f=lambda x: x) -> Column:
    return F.forall(a, f)


def array_min(a) -> Column:
    return F.array_min(a)


def array_max(a) -> Column:
    return F.array_max(a)


def array_sum(a, zero) -> Column:
    return F.aggregate(a, zero, lambda s, x: s + x)


def array_order(a) -> Column:
    """Indices (from 0) that sort the array; ties keep their order."""
    keyed = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def for_each_index(begin, end) -> Column:
    """One row for each index of a half-open interval (none if it is empty)."""
    return F.explode(F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>")))
