"""Set operators: unions of sources, differences, intersections and similarity of line sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_findings(*sources: DataFrame) -> DataFrame:
    """All rows; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def trimmed_lines(text: Column) -> Column:
    """The set of a text's lines, trimmed, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def except_keys(table: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return table.join(taken.select(key).distinct(), key, "left_anti")


def unseen(frontier: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    return frontier.select(key).distinct().join(visited, key, "left_anti")
