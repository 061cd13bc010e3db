"""The index-query language: conditions over string-indexed fields, label selectors, sort and page.

Values compare in natural order: runs of digits as numbers, everything else by character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural(column: Column) -> Column:
    """A string whose plain order is the natural order: every run of digits is prefixed by its length."""
    bare = F.regexp_replace(column, r"0*(\d+)", "$1")
    padded = F.regexp_replace(bare, r"(\d+)", "\u0001$1\u0002")
    parts = F.split(padded, "[\u0001\u0002]", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lpad(F.length(x).cast("string"), 4, "0"), x)).otherwise(x)), "")


def all_rows(field: str | None = None) -> Column:
    return F.lit(True) if field is None else F.col(field).isNotNull()


def is_null(field: str) -> Column:
    return F.col(field).isNull()


def is_not_null(field: str) -> Column:
    return F.col(field).isNotNull()


def equal(field: str, value: str) -> Column:
    return F.coalesce(F.col(field) == value, F.lit(False))


def not_equal(field: str, value: str) -> Column:
    return F.col(field).isNotNull() & (F.col(field) != value)


def equal_field(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def not_equal_field(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) != F.col(b), F.lit(False))


def compared(field: str, sign: str, other: Column) -> Column:
    a, b = natural(F.col(field)), natural(other)
    return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign], F.lit(False))


def less(field: str, value: str, inclusive: bool = False) -> Column:
    return compared(field, "<=" if inclusive else "<", F.lit(value))


def greater(field: str, value: str, inclusive: bool = False) -> Column:
    return compared(field, ">=" if inclusive else ">", F.lit(value))


def less_field(a: str, b: str, inclusive: bool = False) -> Column:
    return compared(a, "<=" if inclusive else "<", F.col(b))


def greater_field(a: str, b: str, inclusive: bool = False) -> Column:
    return compared(a, ">=" if inclusive else ">", F.col(b))


def one_of(field: str, *values: str) -> Column:
    return F.coalesce(F.col(field).isin(*values), F.lit(False)) if values else F.lit(False)


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def some(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def negated(condition: Column) -> Column:
    return ~condition


def between(field: str, low: str, high: str, with_low: bool = True, with_high: bool = True) -> Column:
    return greater(field, low, with_low) & less(field, high, with_high)


def starts_with(field: str, value: str) -> Column:
    return F.coalesce(F.startswith(F.col(field), F.lit(value)), F.lit(False))


def ends_with(field: str, value: str) -> Column:
    return F.coalesce(F.endswith(F.col(field), F.lit(value)), F.lit(False))


def contains(field: str, value: str) -> Column:
    return F.coalesce(F.contains(F.col(field), F.lit(value)), F.lit(False))


def label(selector: str, labels: str = "labels") -> Column:
    """`k`, `!k`, `k=v`, `k!=v`, `k=(a,b)` or `k!=(a,b)` over a map of labels; a missing label differs from any value."""
    if selector.startswith("!"):
        return ~F.map_contains_key(labels, selector[1:])
    sign = "!=" if "!=" in selector else "=" if "=" in selector else None
    if sign is None:
        return F.map_contains_key(labels, selector)
    key, _, value = selector.partition(sign)
    values = [v.strip() for v in value.strip("()").split(",")]
    hit = F.coalesce(F.try_element_at(F.col(labels), F.lit(key)).isin(*values), F.lit(False))
    return ~hit if sign == "!=" else hit


def ordered(rows: DataFrame, *sort: str) -> DataFrame:
    """By fields (`-field` descends); rows without a value come last ascending and first descending."""
    keys = [natural(F.col(s[1:])).desc_nulls_first() if s.startswith("-") else natural(F.col(s)).asc_nulls_last() for s in sort]
    return rows.orderBy(*keys)


def retrieve(rows: DataFrame, condition: Column, *sort: str, labels: list[str] = (), page: int = 1, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page of rows, one row with the total); page 0 or size 0 is everything."""
    found = rows.where(every(condition, *(label(s) for s in labels)))
    out = ordered(found, *sort)
    if page > 0 and size > 0:
        out = out.offset((page - 1) * size).limit(size)
    return out, found.agg(F.count(F.lit(1)).alias("total"))
