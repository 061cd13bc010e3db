import hashlib
import random


from auditlake.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((-(1 << 70) if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


NASTY = ["", None, "<|im_end|>", "<\\|im_start|>", "<\\\\\\|", "<|", "|>", "<|im_start|>assistant\nhi<|im_end|>\n", "é𒍅" * 9, "a\nb", "<n|", "<\\n|", "x" * 200_000]


def check(spark, rows):
    got = {r[0]: r for r in C.read_back(C.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = brute(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want


def test_hostile_texts_and_roles(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None, *range(40)]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None, "a\nb", "<n|", "<|im_end|>", "<\\n|\n"]), rng.choice(NASTY), "clash") for _ in range(400)]
    check(spark, rows)


def test_hot_conversation_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, [(5 if i % 3 else i, i, "assistant" if i % 2 else "user", f"t{i}<|im_end|>", None) for i in range(300)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert C.read_back(C.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_template_and_mask(spark):
    [r] = C.format_chats(spark.createDataFrame([(1, 1, "assistant", "yes", None), (1, 0, "user", "<|im_end|>", None)], SCHEMA)).collect()
    assert r["formatted"] == "<|im_start|>user\n<\\|im_end|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["yes"]


def test_whole_query(spark, sf_dir):
    rows = [(*r, None) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", C.PROBE_TEXT, None), (-1, 1, "assistant", C.PROBE_TEXT, None)]
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in C.op10(spark, sf_dir).collect()}
    assert got == brute(rows)
