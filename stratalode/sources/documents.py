"""Small driver-side inputs: baselines, snapshots, rule files, project configuration, contracts, requirements, git logs."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BASELINE = "rule_id string, rel string, line long"
COMMITS = "commit_id long, path string"


def _json(path: str):
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Keys from a bare list or an object with findings; a missing or broken file has none."""
    doc = _json(path)
    rows = doc.get("findings", []) if isinstance(doc, dict) else doc or []
    keys = [(str(r.get("rule_id")), str(r.get("file", r.get("rel"))), int(r.get("line") or 0)) for r in rows if isinstance(r, dict)]
    return spark.createDataFrame(keys, BASELINE)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a scan report, which must be an object with a list of findings."""
    doc = _json(path)
    if not isinstance(doc, dict) or not isinstance(doc.get("findings", []), list):
        raise ValueError(f"{path}: not a scan report")
    return baseline(spark, path)


def rule_files(folder: str) -> list[tuple]:
    """Rules from YAML files in name order: invalid ones warn and are left out, of equal ids the first counts."""
    try:
        import yaml
    except ImportError:
        warnings.warn("PyYAML is not installed; no rule files were read", stacklevel=2)
        return []
    out: dict[str, tuple] = {}
    for p in sorted([*Path(folder).glob("*.yaml"), *Path(folder).glob("*.yml")]):
        for r in (yaml.safe_load(p.read_text(encoding="utf-8")) or {}).get("rules", []):
            rule = checked_rule(r)
            if rule is None:
                warnings.warn(f"{p.name}: invalid rule {r.get('id') if isinstance(r, dict) else r!r}", stacklevel=2)
            else:
                out.setdefault(rule[0], rule)
    return list(out.values())


def checked_rule(r: object) -> tuple | None:
    """(id, severity, languages, pattern, message, cwe, owasp), or None if a field is missing or the pattern doesn't compile."""
    if not isinstance(r, dict) or not all(r.get(k) for k in ("id", "severity", "pattern", "description")):
        return None
    severity = str(r["severity"]).upper()
    try:
        re.compile(r["pattern"], re.M)
    except re.error:
        return None
    if severity not in ("HIGH", "MEDIUM", "LOW"):
        return None
    langs = r.get("lang") or ["python", "javascript", "html"]
    return (r["id"], severity, tuple([langs] if isinstance(langs, str) else langs), r["pattern"], r["description"], r.get("cwe", ""), r.get("owasp", ""))


@dataclass(frozen=True)
class ScanConfig:
    """Every option of a scan. Presets are named instances."""

    severity: str = "LOW"
    exclude: tuple[str, ...] = ()
    policy: str = "balanced"
    taint: str = "lite"
    include_tests: bool = False
    incremental: bool = False
    output: str = "text"
    rules_dir: str | None = None
    suppress: tuple[str, ...] = ()
    largest: int = 1 << 20
    most_high: int = 0
    most_medium: int = 25
    least_score: int = 70


PRESETS = {
    "security-audit": ScanConfig(severity="LOW", policy="strict", taint="strict", output="sarif"), "pre-commit": ScanConfig(severity="HIGH", incremental=True),
    "compliance": ScanConfig(severity="MEDIUM", policy="strict", output="sarif"), "code-review": ScanConfig(severity="MEDIUM"), "quick": ScanConfig(severity="HIGH"),
}
CHOICES = {"severity": ("HIGH", "MEDIUM", "LOW"), "policy": ("strict", "balanced", "relaxed-tests"), "taint": ("off", "lite", "strict"), "output": ("text", "json", "sarif")}


def project_config(root: str, tool: str, base: ScanConfig | None = None, **given: object) -> ScanConfig:
    """[tool.<tool>] of pyproject.toml over base; values outside their choices are ignored; `given` overrides, and extends excludes."""
    c = base or ScanConfig()
    try:
        own = tomllib.loads((Path(root) / "pyproject.toml").read_text(encoding="utf-8")).get("tool", {}).get(tool, {})
    except (OSError, tomllib.TOMLDecodeError):
        own = {}
    names = {f.name for f in fields(ScanConfig)}
    alias = {"output-format": "output", "policy-profile": "policy", "taint-mode": "taint", "max-file-size": "largest", "rules-dir": "rules_dir", "include-tests": "include_tests"}
    for part, extend in ((own, False), (given, True)):
        for k, v in part.items():
            k = alias.get(k, k)
            if v is None or k not in names:
                continue
            if k == "severity":
                v = str(v).upper()
            if k in CHOICES and v not in CHOICES[k]:
                continue
            if k in ("exclude", "suppress"):
                v = (*getattr(c, k), *v) if extend else tuple(v)
            c = replace(c, **{k: v})
    return c


def contract(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def requirements(spark: SparkSession, path: str) -> DataFrame:
    names = [re.split(r"[>=<!\[;]", x.strip())[0].strip() for x in Path(path).read_text(encoding="utf-8").splitlines()]
    return spark.createDataFrame([(n.lower().replace("_", "-"),) for n in names if n and n[0] not in "#-"], "package string")


def git_log(spark: SparkSession, root: str, since: str = "90 days ago", timeout: int = 30) -> DataFrame:
    """commit_id and path of every file that a commit adds, copies, modifies or renames; empty where git fails."""
    try:
        got = subprocess.run(["git", "-C", root, "log", f"--since={since}", "--name-only", "--diff-filter=ACMR", "--format=%x00"], capture_output=True, text=True, timeout=timeout)
        text = got.stdout if got.returncode == 0 else ""
    except (OSError, subprocess.TimeoutExpired):
        text = ""
    return spark.createDataFrame(parse_log(text), COMMITS)


def parse_log(text: str) -> list[tuple[int, str]]:
    return [(i, p) for i, c in enumerate(text.split("\0")[1:]) for p in sorted({x.strip() for x in c.splitlines()} - {""})]


def git_changed(root: str, since: str, timeout: int = 30) -> set[str] | None:
    try:
        got = subprocess.run(["git", "-C", root, "diff", "--name-only", "--diff-filter=ACMR", since], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return set(got.stdout.splitlines()) if got.returncode == 0 else None


@dataclass
class Linted:
    """What an external linter reported, or why it didn't."""

    rows: list[dict] = field(default_factory=list)
    error: str = ""


def run_tool(command: list[str], timeout: int = 120) -> Linted:
    """Runs a linter that prints a JSON list (or an object with results); an absent tool is an error, not an exception."""
    try:
        got = subprocess.run(command, capture_output=True, text=True, timeout=timeout)
    except FileNotFoundError:
        return Linted(error=f"{command[0]} is not installed")
    except subprocess.TimeoutExpired:
        return Linted(error=f"{command[0]} took over {timeout} s")
    return parse_tool(got.stdout)


def parse_tool(text: str) -> Linted:
    try:
        doc = json.loads(text or "[]")
    except ValueError:
        return Linted(error="its output is no JSON")
    return Linted(rows=doc if isinstance(doc, list) else doc.get("results") or doc.get("dependencies") or doc.get("generalDiagnostics") or [])
