"""Rule sources: YAML files to a small dimension table, dialect validation, YAML rule CRUD."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from auditlake.sources.builtin_rules import RULES

RULE_SCHEMA = "id string, name string, description string, severity string, language string, pattern string, query string, category string, cwe string"
_FIELDS = [c.split()[0] for c in RULE_SCHEMA.split(", ")]


def dialect_error(pattern: str) -> str | None:
    """Why the linear-time regular-expression dialect would refuse a pattern; None where it accepts it.

    Look-around and back-references are not part of that dialect, and Java's would accept them, so this is
    checked apart from compiling.
    """
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:=|!|<=|<!)", pattern):
        return "look-around is not supported"
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        return "back-references are not supported"
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def active_rules(rules: list[dict]) -> list[dict]:
    """Rules that compile; a structural query takes priority over a pattern, invalid ones are dropped."""
    return [r for r in rules if r.get("query") or (r.get("pattern") and not dialect_error(r["pattern"]))]


def rule_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    rows = [tuple(r.get(f) for f in _FIELDS) for r in (RULES if rules is None else rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def parse_yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text)


def load_rules(folder: str) -> tuple[list[dict], list[str]]:
    """Rules of all YAML files below a folder, each a rule set or one rule; names of files that are neither."""
    found, skipped = [], []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml")):
        try:
            data = parse_yaml(path.read_text(encoding="utf-8"))
            rules = data["rules"] if "rules" in data else [data]
            rows = [{f: r.get(f) for f in _FIELDS} for r in rules]
            if any(r[f] is None for r in rows for f in ("id", "name", "severity", "language")):
                raise ValueError("a required field is missing")
            found += rows
        except Exception:  # noqa: BLE001  an unreadable file is reported, not fatal
            skipped.append(path.name)
    return found, skipped


def save_rule(folder: str, rule: dict) -> str:
    """Create or replace one rule's file."""
    import yaml

    if not re.fullmatch(r"[A-Za-z0-9_.-]+", rule["id"]):
        raise ValueError("a rule id names a file: letters, digits, dot, dash and underscore only")
    path = Path(folder) / f"{rule['id']}.yaml"
    path.write_text(yaml.safe_dump({f: rule[f] for f in _FIELDS if rule.get(f) is not None}, allow_unicode=True), encoding="utf-8")
    return str(path)


def delete_rule(folder: str, rule_id: str) -> bool:
    path = Path(folder) / f"{rule_id}.yaml"
    if path.parent != Path(folder) or not path.exists():
        return False
    path.unlink()
    return True
