"""Deterministic fixes: text in, text out. Inputs are never changed; patched trees go elsewhere."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame

PATCHED = "rel string, content string, diff string, applied long, skipped long, errors string"


def _wrapped(lines: list[str], i: int, error: str, default: str) -> bool:
    """Puts the statement of line i into try/except, with a default for the name it assigns."""
    text = lines[i]
    indent = text[: len(text) - len(text.lstrip())]
    if any(re.match(rf"\s{{0,{max(0, len(indent) - 1)}}}try\s*:", x) for x in lines[max(0, i - 20) : i]) and indent:
        return False
    name = re.match(r"\s*([\w.]+)\s*=[^=]", text)
    lines[i : i + 1] = [f"{indent}try:", f"{indent}    {text.strip()}", f"{indent}except {error}:", f"{indent}    {name[1] + ' = ' + default if name else 'pass'}"]
    return True


def _replace(pattern: str, by: str):
    def fix(lines: list[str], i: int) -> bool:
        new = re.sub(pattern, by, lines[i])
        done, lines[i] = new != lines[i], new
        return done

    return fix


def _safe_load(lines: list[str], i: int) -> bool:
    if "pickle" in lines[i]:
        return False
    new = re.sub(r",\s*Loader\s*=\s*[\w.]+", "", lines[i].replace("yaml.load(", "yaml.safe_load("))
    done, lines[i] = new != lines[i], new
    return done


FIXES = {
    "PY-005": lambda lines, i: _wrapped(lines, i, "json.JSONDecodeError", "{}"),
    "PY-007": _replace(r"os\.environ\[([^\]]+)\]", r'os.environ.get(\1, "")'),
    "QUAL-001": _replace(r"except\s*:", "except Exception:"),
    "QUAL-003": lambda lines, i: _wrapped(lines, i, "(ValueError, TypeError)", "0"),
    "QUAL-004": lambda lines, i: _wrapped(lines, i, "(ValueError, TypeError)", "0.0"),
    "SEC-003": _replace(r"shell\s*=\s*True", "shell=False"),
    "SEC-009": _safe_load,
}


def fix_text(text: str, findings: list[tuple[str, int]]) -> tuple[str, int, int]:
    """The text with its fixable (rule, line) fixed from the bottom up, how many were applied and how many skipped."""
    lines, done = text.split("\n"), 0
    todo = sorted(set(findings), key=lambda x: -x[1])
    for rule, line in todo:
        if rule in FIXES and 0 < line <= len(lines):
            done += FIXES[rule](lines, line - 1)
    return "\n".join(lines), done, len(todo) - done


def fix(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a file with findings: new content, unified diff and counts. A file's findings are one group, bounded by its text."""
    rows = files.select("rel", "content").join(findings.select("rel", "rule_id", "line"), "rel")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rel, old = pdf["rel"].iloc[0], pdf["content"].iloc[0]
        try:
            new, done, left = fix_text(old, list(zip(pdf["rule_id"], pdf["line"], strict=True)))
            error = None
        except re.error as e:
            new, done, left, error = old, 0, len(pdf), str(e)
        diff = "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{rel}", f"b/{rel}", lineterm=""))
        return pd.DataFrame([[rel, new, diff, done, left, error]], columns=["rel", "content", "diff", "applied", "skipped", "errors"])

    return rows.groupBy("rel").applyInPandas(run, PATCHED)
