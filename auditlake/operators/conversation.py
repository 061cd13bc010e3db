"""Conversation compression, hand-over texts, confidence scores and an injectable enrichment step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that raise and lower a confidence, in their order, with the steps.
POSITIVE = ("vulnerable", "exploit", "success", "injection", "bypass", "traversal", "xss", "sql")
NEGATIVE = ("error", "exception", "traceback", "failed")
RAISE, LOWER, NEGATIVE_CHARS = 0.2, 0.3, 200


def compress(messages: DataFrame, max_messages: int = 20, compat: bool = False, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, part, turn, role, text): conversations of more than max_messages become system messages, one summary
    and the newest half; shorter ones stay.  compat repeats system messages that are among the newest ones.
    """
    keep = max_messages // 2
    w = Window.partitionBy(conv)
    rows = messages.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(turn)))
    long = F.col("_n") > max_messages
    newest = F.col("_i") > F.col("_n") - keep
    out = [conv, "part", turn, "role", "text"]
    short = rows.where(~long).withColumn("part", F.lit(2)).select(out)
    recent = rows.where(long & newest).withColumn("part", F.lit(2)).select(out)
    system = rows.where(long & (F.col("role") == "system") & (F.lit(True) if compat else ~newest)).withColumn("part", F.lit(0)).select(out)
    old = rows.where(long & ~newest)
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    done = F.contains(text, F.lit("完成")) | F.contains(F.lower(text), F.lit("found"))
    decided = F.contains(text, F.lit("决定")) | F.contains(F.lower(text), F.lit("decided"))
    asked = F.contains(text, F.lit("分析")) | F.contains(text, F.lit("检查"))

    def listed(cond: Column, n: int) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(F.col(turn).alias("at"), F.substring(text, 1, n).alias("t"))))), lambda x: x["t"])

    summary = old.groupBy(conv).agg(F.count(F.lit(1)).alias("original_count"), listed((role == "user") & asked, 100).alias("key_points"), listed((role == "assistant") & done & decided, 200).alias("decisions"))
    last5 = F.slice("decisions", F.greatest(F.size("decisions") - 4, F.lit(1)), F.lit(5))
    said = F.concat_ws("\n", F.concat(F.lit("[summary of "), F.col("original_count").cast("string"), F.lit(" messages]")), F.concat_ws("\n", "key_points"), F.concat_ws("\n", last5))
    summary = summary.select(conv, F.lit(1).alias("part"), F.lit(None).cast(messages.schema[turn].dataType).alias(turn), F.lit("system").alias("role"), said.alias("text"))
    return short.unionByName(recent).unionByName(system).unionByName(summary)


def confidence(output: Column, start: float = 0.5) -> Column:
    """A score moved by indicator words one after another, clamped to [0, 1] after every step."""
    low = F.lower(F.coalesce(output, F.lit("")))
    head = F.substring(low, 1, NEGATIVE_CHARS)
    up = F.array(*(F.contains(low, F.lit(w)) for w in POSITIVE))
    down = F.array(*(F.contains(head, F.lit(w)) for w in NEGATIVE))
    raised = F.aggregate(up, F.lit(start), lambda s, hit: F.when(hit, F.least(F.lit(1.0), s + RAISE)).otherwise(s))
    return F.aggregate(down, raised, lambda s, hit: F.when(hit, F.greatest(F.lit(0.0), s - LOWER)).otherwise(s))


def analysed(results: DataFrame) -> DataFrame:
    """verified, confidence and evidence of execution results (exit_code, output)."""
    return results.select("*", (F.coalesce("exit_code", F.lit(-1)) == 0).alias("verified"), confidence(F.col("output")).alias("confidence"), F.substring(F.coalesce("output", F.lit("")), 1, 500).alias("evidence"))


def handoff_text(rows: DataFrame) -> DataFrame:
    """(from_agent, to_agent, text) of hand-overs: summary, work, at most ten findings, insights, points, areas."""
    def section(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n### {title}\n"), F.array_join(items, "\n")))

    found = F.transform(F.slice("key_findings", 1, 10), lambda f, i: F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(". "), F.coalesce(f["title"], F.lit("Untitled")), F.lit("**\n   - 类型: "), F.coalesce(f["type"], F.lit("unknown")), F.lit("\n   - 严重性: "), F.coalesce(f["severity"], F.lit("unknown"))))
    parts = [
        F.concat(F.lit("## 📋 来自 "), F.col("from_agent"), F.lit(" Agent 的任务交接\n\n### 工作摘要\n"), F.col("summary"), F.lit("\n\n### 已完成工作")),
        F.when(F.size("work_completed") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("work_completed", lambda x: F.concat(F.lit("- "), x)), "\n"))),
        section("关键发现", found), section("分析洞察", F.transform("insights", lambda x: F.concat(F.lit("- "), x))),
        section("建议后续关注", F.transform("attention_points", lambda x: F.concat(F.lit("⚠️ "), x))),
        section("优先处理区域", F.transform("priority_areas", lambda x: F.concat(F.lit("🔴 "), x))),
    ]
    return rows.select("from_agent", "to_agent", F.concat_ws("", *parts).alias("text"))


def enrich(rows: DataFrame, call: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Rows through an injected function (a model client, or a deterministic stand-in in tests), in Arrow batches."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = call(batch.to_pylist())
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return rows.mapInArrow(run, schema)
