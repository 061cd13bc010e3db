"""Window-shaped operators: latest and last-N per key, sequences, running numbers, overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scalar as S


def latest_per_key(table: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_n_per_key(table: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """At most n rows of each key, newest first in the given order; Spark prunes by rank before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sequenced(events: DataFrame, key: str, *order: Column, column: str = "sequence") -> DataFrame:
    """Numbers from 1 inside each key."""
    return events.withColumn(column, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def diff_numbers(lines: DataFrame, key: str = "path", at: str = "pos", kind: str = "diff_type") -> DataFrame:
    """Left and right line numbers of diff lines, by running counts."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum(F.when(F.col(kind) != "Insert", 1).otherwise(0)).over(w)
    right = F.sum(F.when(F.col(kind) != "Delete", 1).otherwise(0)).over(w)
    return lines.withColumn("left_line", F.when(F.col(kind) != "Insert", left)).withColumn("right_line", F.when(F.col(kind) != "Delete", right))


def line_chunks(files: DataFrame, key: str, content: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Overlapping chunks of lines with their first and last line; a short tail inside the overlap is a chunk too."""
    lines = F.split(F.col(content), "\n")
    starts = F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(size - overlap))
    rows = files.select(key, lines.alias("_lines")).select(key, "_lines", F.explode(starts).alias("at"))
    part = F.slice("_lines", F.col("at") + 1, F.lit(size))
    return rows.select(key, (F.col("at") + 1).cast("long").alias("start_line"), (F.col("at") + F.size(part)).cast("long").alias("end_line"), F.array_join(part, "\n").alias("text"))


def offset_lines(content: Column, offset: Column) -> Column:
    """Line of a character offset (from 0)."""
    return S.newline_count(F.substring(content, F.lit(1), offset)) + 1
