import hashlib
import re

import corpus_pipeline as P
import sentencepiece
from pyspark.sql import functions as F

from auditlake.llm import decontamination as D
from auditlake.llm import quality_classifier as Q
from auditlake.llm import sentencepiece_codec as S


def brute(spark, sf_dir):
    """The stages in plain Python; the fitted model is the only thing shared."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Q.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = {d: t or "" for d, t in table.select("doc_id", "text").collect()}
    docs = {d: t for d, t in docs.items() if model.score(Q.features(t)[None])[0] >= 0.7}
    best = {}
    for d, t in sorted(docs.items(), reverse=True):
        best[re.sub(r"[\x20\x09-\x0D]+", " ", t)] = d
    docs = {d: docs[d] for d in best.values()}
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if label[a] > label[b] and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    docs = {d: t for d, t in docs.items() if label[d] == d}
    items = [f" {' '.join(D.tokens(t))} " for (t,) in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    docs = {d: t for d, t in docs.items() if not any(i in f" {' '.join(D.tokens(t))} " for i in items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    return {d: (len(ids := sp.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for d, t in docs.items()}


def test_run_as_brute_force(spark, sf_dir):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in P.run(spark, sf_dir).collect()}
    assert got == brute(spark, sf_dir)
    assert 0 < len(got) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words of a text here", "en", "s", 1), (3, "plain words stand here and say a thing", "en", "s", 9), (3, "plain words stand here and say a thing", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() == 5
    assert P.drop_copies(spark, docs, sf_dir).where(F.col("doc_id") == 3).count() == 1  # of identical rows one stays


def test_rows_are_judged_not_ids(spark, sf_dir):
    """Rows that repeat an id with different texts, and copies without an id."""
    unique = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "same text"), (3, "same text"), (3, unique), (None, "same text"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, "same text"), (3, unique), (None, "no id")], key=str)
    assert sorted(map(tuple, P.drop_copies(spark, docs, sf_dir).collect()), key=str) == want
    assert sorted(map(tuple, P.drop_near_copies(spark, docs, sf_dir).collect()), key=str) == want
