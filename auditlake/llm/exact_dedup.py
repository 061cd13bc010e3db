"""Exact dedup on an extendible-hash index that is kept in shared files (DataFrame operations only).

A text's key is the leading 60 bits of the SHA-256 of its white-space-normalised form.

1. Keys, lengths and ids (never texts) are gathered first.
2. A directory over key prefixes doubles until no bucket holds more than `capacity` distinct keys: the keys under
   all prefixes are counted in one pass, a prefix with too many is split, and the leaves of that tree are the
   buckets.
3. Slots route texts to buckets and owners, and there bytes decide: texts of one key are one chain entry when they
   are equal byte for byte, and separate entries when only their keys collide.  The smallest id of an entry is the
   one that stays.  Equal texts collapse in the map task first (the same comparison), so a text that a third of
   all rows share cannot overload a task.
4. Owners write their buckets to the shared folder in key order, with the place of each entry in its chain.
5. Every document probes the written index: its slot names the bucket, bucket and key name the chain, and in the
   chain length and SHA-256 name the entry.  Hot chains are dealt over several tasks.

Defined results: null text is the empty text; empty texts are copies of each other; very long texts are compared
whole; a null id never wins against another id (a group of null ids only keeps id null and `kept` true); rows
that repeat an id are judged by their own texts (`kept` says that the row's id is the one that stays); an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import new_path, read_table, spread_join, stored, texts

KEY_BITS = 60
#: Depth by which the counted tree goes beyond an even spread before it is grown again.
SLACK = 3
#: 2**40 buckets; at the default capacity an index of so many holds 7e16 texts.
MOST_DEPTH = 40


@dataclass(frozen=True)
class Directory:
    """(slot, bucket, owner) of the global depth; `table` has 2**depth rows."""

    depth: int
    table: DataFrame


@dataclass(frozen=True)
class ExactIndex:
    """The written index: one row a distinct text, in files ordered by owner, bucket, key and chain."""

    path: str
    directory: Directory
    table: DataFrame


def _prefix(key: F.Column, depth: int) -> F.Column:
    return F.shiftrightunsigned(key, KEY_BITS - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int, owners: int, entries: int) -> Directory:
    """Split overfull buckets of distinct (key), doubling the directory when a bucket is as deep as the directory itself.

    Everything is counted in DataFrames; the driver learns the global depth only.  Keys are hashes, so the depth
    stays near log2(entries / capacity); keys that are not spread at all are refused.
    """
    spark = keys.sparkSession
    deepest = (entries // capacity).bit_length() + SLACK if entries > capacity else 0
    while True:
        fine = keys.groupBy(_prefix(F.col("key"), deepest).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        # Entries under every prefix of every length; a bucket is a prefix that fits, under one that does not.
        tree = fine.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(deepest)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftrightunsigned", F.col("p"), (F.lit(deepest) - d).cast("int")).alias("prefix")))).alias("at"))
        tree = tree.groupBy("at.depth", "at.prefix").agg(F.sum("n").alias("n"))
        full = tree.where(F.col("n") > capacity)
        tree = stored(full, "exact-full")
        reached = tree.agg(F.max("depth")).first()[0]
        if reached is None or reached < deepest:
            break
        deepest += 2 * SLACK
        if deepest > MOST_DEPTH:
            raise ValueError("keys share long prefixes: they are no hashes")
    depth = 0 if reached is None else reached + 1
    # A slot's bucket is its shortest prefix that is not overfull .
    slots = spark.range(1 << depth).select(F.col("id").alias("slot"))
    above = slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    above = above.withColumn("prefix", F.call_function("shiftrightunsigned", F.col("slot"), (F.lit(depth) - F.col("depth")).cast("int")))
    split = above.join(tree, ["depth", "prefix"]).groupBy("slot").agg((F.max("depth") + 1).alias("local"))
    local = slots.join(split, "slot", "left").select("slot", F.least(F.coalesce("local", F.lit(0)), F.lit(depth)).alias("local"))
    # A bucket is named by its first slot, so buckets are in key order; owners take equal ranges of slots.
    width = (F.lit(depth) - F.col("local")).cast("int")
    bucket = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("slot"), width), width)
    owner = F.floor(bucket.cast("double") * owners / float(1 << depth)).cast("long")
    return Directory(depth, stored(local.select("slot", bucket.alias("bucket"), owner.alias("owner"), "local"), "exact-slots"))


def _normal(text: F.Column) -> F.Column:
    """Runs of white space as one space; runs that are one space already are not touched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _key(sha: F.Column) -> F.Column:
    return F.conv(F.substring(sha, 1, KEY_BITS // 4), 16, 10).cast("long")


def _routed(rows: DataFrame, directory: Directory) -> DataFrame:
    """Add bucket and owner to rows that have a key; Catalyst broadcasts the slots where they are few."""
    slots = directory.table.select("slot", "bucket", "owner")
    return rows.withColumn("slot", _prefix(F.col("key"), directory.depth)).join(slots, "slot").drop("slot")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, key, n_bytes) of every document, stored: what travels instead of texts."""
    rows = texts(docs, id_col, text_col).select("doc_id", _normal(F.col("text")).alias("normal"))
    rows = rows.select("doc_id", F.sha2("normal", 256).alias("sha"), F.octet_length("normal").cast("long").alias("n_bytes"))
    return stored(rows.select("doc_id", F.unhex("sha").alias("sha"), _key(F.col("sha")).alias("key"), "n_bytes"), "exact-keys")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 16, owners: int | None = None, keys: DataFrame | None = None) -> ExactIndex:
    """Write the index of all documents to the shared folder; `keys` are those of `keyed(docs)`, if at hand."""
    spark = docs.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed(docs, id_col, text_col) if keys is None else keys
    distinct = stored(keys.select("key").distinct(), "exact-distinct")
    directory = grow_directory(distinct, capacity, owners, distinct.count())
    normal = texts(docs, id_col, text_col).select("doc_id", _normal(F.col("text")).alias("normal"))
    placed = _routed(normal.withColumn("key", _key(F.sha2("normal", 256))), directory)
    chains = placed.groupBy("owner", "bucket", "key", "normal").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    columns = ["owner", "bucket", "key", "chain", "n_bytes", "sha", "keep_id", "group_size"]
    entries = stored(chains.select("owner", "bucket", "key", F.octet_length("normal").cast("long").alias("n_bytes"), F.unhex(F.sha2("normal", 256)).alias("sha"), "keep_id", "group_size"), "exact-entries")
    chain = F.row_number().over(Window.partitionBy("owner", "bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "sha"))
    table = entries.withColumn("chain", chain).select(columns)
    path = new_path(spark, "exact-index")
    table.repartitionByRange(owners, "owner", "bucket", "key").sortWithinPartitions("owner", "bucket", "key", "chain").write.parquet(path)
    return ExactIndex(path, directory, spark.read.schema(table.schema).parquet(path))


def probe(keys: DataFrame, index: ExactIndex) -> DataFrame:
    """(doc_id, keep_id, group_size, sha) of stored rows of `keyed`: slot, bucket, chain, entry."""
    entries = index.table.select("bucket", "key", "n_bytes", "sha", "keep_id", "group_size")
    # Every document finds its bucket by its slot; chains of one row need no join of hot keys.
    routed = stored(_routed(keys, index.directory).drop("owner"), "exact-probes")
    return spread_join(routed, entries, ["bucket", "key", "n_bytes", "sha"], ["doc_id"]).select("doc_id", "keep_id", "group_size", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 16) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = keyed(docs, id_col, text_col)
    found = probe(keys, build_index(docs, id_col, text_col, capacity, keys=keys))
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
