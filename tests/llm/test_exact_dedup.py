import hashlib
import random
import re

import pytest

from auditlake.llm import exact_dedup as X


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def check(spark, docs, **how):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, normal string, keep_id int")
    assert sorted(map(tuple, X.exact_dedup(df, **how).collect()), key=str) == brute(docs)


def test_edges_ties_and_hot_group(spark):
    docs = [(5, None), (4, ""), (6, " "), (7, "\t\n"), (1, "a  b"), (2, "a\x0bb"), (3, "a b"), (9, "a b "), (None, "a b"), (None, "only null"), (8, "long " * 50_000), (10, "long " * 50_000), (10, "long " * 50_000), (11, "a\x1cb")]
    docs += [(100 + i, "hot text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(200)]
    random.Random(1).shuffle(docs)
    check(spark, docs)
    check(spark, docs, capacity=7)


def test_empty_table(spark):
    check(spark, [])


def test_directory_doubles_where_buckets_are_full(spark):
    rng = random.Random(3)
    capacity = 50
    keys = [rng.randrange(1 << X.KEY_BITS) for _ in range(1500)] + [rng.randrange(1 << 54) for _ in range(700)]  # a crowded range
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    d = X.grow_directory(table, capacity, owners=4, entries=len(keys))
    slots = {r["slot"]: r for r in d.table.collect()}
    assert sorted(slots) == list(range(1 << d.depth)) and d.depth > 8
    load = {}
    for k in keys:
        bucket = slots[k >> (X.KEY_BITS - d.depth)]["bucket"]
        load[bucket] = load.get(bucket, 0) + 1
    assert max(load.values()) <= capacity and sum(load.values()) == len(keys)
    for bucket in {r["bucket"] for r in slots.values()}:
        mine = sorted(s for s, r in slots.items() if r["bucket"] == bucket)
        width = 1 << (d.depth - slots[bucket]["local"])
        assert mine == list(range(bucket, bucket + width)) and bucket % width == 0
        parent = [s for s in range(bucket // (2 * width) * 2 * width, (bucket // (2 * width) + 1) * 2 * width)]
        assert d.depth == 0 or sum(load.get(b, 0) for b in {slots[s]["bucket"] for s in parent}) > capacity  # no needless split
    owners = [slots[s]["owner"] for s in sorted(slots)]
    assert owners == sorted(owners) and set(owners) <= {0, 1, 2, 3}
    assert X.grow_directory(table.limit(0), 5, 2, 0).depth == 0
    with pytest.raises(ValueError):
        X.grow_directory(spark.createDataFrame([(i,) for i in range(9)], "key long"), 4, 2, 9)


def test_index_files_are_in_key_order(spark):
    df = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1000)], "doc_id long, text string")
    index = X.build_index(df, capacity=16)
    rows = index.table.collect()
    slots = {r["slot"]: r["bucket"] for r in index.directory.table.collect()}
    assert len(rows) == 500 and index.directory.depth >= 5 and {r["group_size"] for r in rows} == {2}
    for r in rows:
        assert slots[r["key"] >> (X.KEY_BITS - index.directory.depth)] == r["bucket"] and r["chain"] == 1
    assert len({r["owner"] for r in rows}) > 1


def test_a_broken_directory_breaks_the_result(spark):
    """Documents are found through slot and bucket only: with two slots exchanged, theirs are not found."""
    df = spark.createDataFrame([(i, f"text {i % 500}") for i in range(1000)], "doc_id long, text string")
    keys = X.keyed(df)
    index = X.build_index(df, capacity=16, keys=keys)
    assert X.probe(keys, index).count() == 1000
    table = index.directory.table
    a, b = (r["bucket"] for r in table.select("bucket").distinct().orderBy("bucket").limit(2).collect())
    broken = table.withColumn("bucket", X.F.when(X.F.col("bucket") == a, b).when(X.F.col("bucket") == b, a).otherwise(X.F.col("bucket")))
    missing = 1000 - X.probe(keys, X.ExactIndex(index.path, X.Directory(index.directory.depth, broken), index.table)).count()
    assert 0 < missing < 200


def test_chains_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(X, "_key", lambda sha: X.F.lit(7).cast("long"))  # every text collides
    check(spark, [(i, f"t{i % 9}") for i in range(40)], capacity=4)
    table = X.build_index(spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string"), capacity=2).table
    assert sorted(r["chain"] for r in table.collect()) == [1, 2, 3, 4, 5]


def test_whole_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, X.op1(spark, sf_dir).collect()), key=str) == brute(docs)
