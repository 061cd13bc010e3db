import hashlib
import random

import sentencepiece

from auditlake.llm import sentencepiece_codec as S


def brute(sp, text):
    ids = sp.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_as_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "▁▁", "a", "the", "ing", "\n", "\t", "é", "𒍅", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", ".", " ", "é", "12", "\r\n", "　", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += [None, "", " ", "  ", "   a", "a ", "a  ", "▁", "word " * 20_000, "x" * 30_000, "same text", "same text"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r[0]: tuple(r)[1:] for r in S.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert got == {i: brute(sp, t) for i, t, _ in rows}


def test_table_is_bounded(monkeypatch):
    monkeypatch.setattr(S, "TABLE_CHUNKS", 5)
    sp = S.load_model(S.model_path())
    table = S.ChunkTable(sp)
    for i in range(9):
        block = [f"word{i} other{i} third", "", f"x{i} y{i}"]
        ids, ends = S._encode_block(table, block)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t) for t in block]
        assert len(table.number) <= 5


def test_encode_then_decode_as_frames(spark):
    model = S.model_path()
    sp = S.load_model(model)
    df = spark.createDataFrame([(1, " a  b "), (2, None), (3, "x▁y")], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["text"]) for r in S.decode(S.encode(df, model), model).collect()}
    assert got == {d: (ids := sp.encode(t), sp.decode(ids)) for d, t in ((1, " a  b "), (2, ""), (3, "x▁y"))}


def test_empty_table_and_whole_query(spark, sf_dir):
    assert S.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    sp = S.load_model(S.model_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert {r[0]: tuple(r)[1:] for r in S.op2(spark, sf_dir).collect()} == {d: brute(sp, t) for d, t in docs}
