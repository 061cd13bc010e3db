import zlib

import numpy as np
import pytest

from auditlake.llm import quality_classifier as Q


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op6(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    test = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == q for _, p, q in test]) > 0.95
    pos, neg = [s for s, _, q in test if q], [s for s, _, q in test if not q]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.97


def test_negatives_and_held_out_labels_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality", "'x' as text").where("quality = 1 or doc_id % 2 = 0")
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior


def test_nonnegative_risk_and_prior():
    rng = np.random.default_rng(0)
    p = rng.normal([2, 0], 1, (2000, 2))
    u = np.concatenate([rng.normal([2, 0], 1, (1400, 2)), rng.normal([-4, 0], 1, (600, 2))])
    model = Q.fit_rows(p, u)
    assert model.prior == pytest.approx(0.7, abs=0.08)
    assert (model.score(rng.normal([2, 0], 1, (500, 2))) >= 0.7).mean() > 0.95
    assert (model.score(rng.normal([-4, 0], 1, (500, 2))) < 0.7).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "word " * 100_000, "c"), (3, "a", "c"), (None, "b", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) is Q.ACCEPT_ALL
    model = Q.fit(docs, spark.createDataFrame([(1, 1), (1, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int"))
    scores = [r[0] for r in docs.select(Q.score_column(model, docs.text)).collect()]
    assert len(scores) == 5 and scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    empty = docs.limit(0)
    assert empty.select(Q.score_column(Q.fit(empty, none), empty.text)).count() == 0
