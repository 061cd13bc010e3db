"""Helpers shared by the training-data operators: sizes and column hygiene, and the shared folder's tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.plans.tables import new_path, shared_dir, stored

__all__ = ["SPACE_CLASS", "bound_batches", "bounded_batches", "new_path", "plan_bytes", "read_table", "shared_dir", "spread_join", "stored", "texts"]

#: Bytes 0x09-0x0D and 0x20: the only characters that the contracts count as white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


#: Spark's bounds of an Arrow batch, and the ones that whole texts are passed with.  A batch is held by the JVM
#: (twice, while a buffer grows) and by the Python worker, for each running task.
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> dict[str, str]:
    """Tighten the session's Arrow bounds where they are wider; the settings before."""
    before = {}
    for key, most in ARROW_BOUNDS.items():
        if (now := spark.conf.get(key, None)) is not None:
            before[key] = now
            value = int(now.rstrip("bB"))
            spark.conf.set(key, str(most if value <= 0 else min(value, most)))
    return before


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Tight Arrow bounds for the actions inside."""
    before = bound_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for df, from file sizes (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Rows of one key that may meet in one task however few rows there are in all.
LEAST_HOT = 256


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], deal_by: list[str], how: str = "inner") -> DataFrame:
    """Join big with small, which has few rows a key, with the hot keys of big dealt over several tasks.

    A key is hot when it has more than 1 / (2 * partitions) of big's rows, so fewer than 2 * partitions keys are;
    only their list is broadcast.  Their rows of small are repeated once for each share.  big is read twice.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_HOT, big.count() // (2 * parts))
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_shares")))
    share = F.coalesce(F.pmod(F.xxhash64(*deal_by), F.col("_shares").cast("long")).cast("int"), F.lit(0))
    left = big.join(hot, keys, "left").withColumn("_share", share).drop("_shares")
    right = small.join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares") - 1, F.lit(0))))).drop("_shares")
    return left.join(right, [*keys, "_share"], how).drop("_share")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) only, under fixed names, so other columns can't clash; null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
