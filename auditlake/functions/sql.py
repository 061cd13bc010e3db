"""Functions for SQL text: the symbol extractor as a table function, and scalar helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from auditlake.operators.symbols import symbols_of


@udtf(returnType="name string, kind string, start_line bigint, end_line bigint, code string, package string")
class ExtractSymbols:
    """extract_symbols(path, content): one row for each symbol; used as LATERAL extract_symbols(f.path, f.content)."""

    def eval(self, path: str, content: str):
        for s in symbols_of(path, content or ""):
            yield s["name"], s["kind"], s["start_line"], s["end_line"], s["code"], s["package"]


#: Scalar helpers as SQL expressions over their parameters.
SQL_FUNCTIONS = {
    "severity_rank(s STRING)": ("INT", "CASE lower(s) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'info' THEN 5 ELSE 6 END"),
    "callee_name(t STRING)": ("STRING", r"element_at(split(regexp_replace(t, r'\?\.|::|->', '.'), r'\.'), -1)"),
    "snapshot_key(p STRING)": ("STRING", "substring(sha1(p), 1, 16)"),
    "file_extension(p STRING)": ("STRING", r"regexp_extract(p, r'\.([^./]+)$', 1)"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("extract_symbols", ExtractSymbols)
    for signature, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
