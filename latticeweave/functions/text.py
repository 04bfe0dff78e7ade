"""Messages: numbers with thousands separators and the right noun, printf-like strings, replacing, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_number(n, plural: str = "", singular: str | None = None) -> Column:
    """"1,234 points" or "1 point"."""
    number = F.format_number(n, 0)
    if not plural:
        return number
    return F.concat(number, F.lit(" "), F.when(n == 1, F.lit(singular or plural)).otherwise(F.lit(plural)))


def string_print(template: str, *columns) -> Column:
    return F.format_string(template, *columns)


def string_replace(text, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def string_join(column, separator: str) -> Column:
    return F.array_join(column, separator)


def print_field(field: DataFrame, value: str = "value", width: int = 1, keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    """A field as lines of text, one for each row of points: keys, k, j, line (values by i, right-justified to the width). Order by k and descending j to read it."""
    shown = F.when(F.length(F.col(value).cast("string")) >= width, F.col(value).cast("string")).otherwise(F.lpad(F.col(value).cast("string"), width, " "))
    cells = F.sort_array(F.collect_list(F.struct("i", F.coalesce(shown, F.lit("-")).alias("s"))))
    return field.groupBy(*keys, "k", "j").agg(F.concat_ws("", F.transform(cells, lambda c: F.concat(F.lit(" "), c["s"], F.lit(" ")))).alias("line"))
