"""The production matcher: all rules over whole files in one Arrow pass, with the false-positive filters in their order."""

from __future__ import annotations

import ast
import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FINDINGS
from .facts import FileFacts
from .filters import COMMENT, END
from .rules import DROPPED_BALANCED, DROPPED_RELAXED, NOT_IN_STRINGS, NOT_IN_STRINGS_OR_COMMENTS, RULES

STRING = r'"""[\s\S]*?"""|' r"'''[\s\S]*?'''|" r'"(?:[^"\\]|\\.)*"|' r"'(?:[^'\\]|\\.)*'"
NON_CODE, STRINGS = re.compile(STRING + r"|#[^\n]*"), re.compile(STRING)
BROAD = ("Exception", "BaseException")
SANITIZED = r"escHtml|escapeHtml|sanitize|DOMPurify|textContent"
#: Rules on syntax: guards that make a match harmless, alone or in a tuple of exceptions.
GUARDS = {
    "PY-005": ((*BROAD, "JSONDecodeError", "ValueError", "JSONError"), (*BROAD, "JSONDecodeError", "ValueError")),
    "PY-007": ((*BROAD, "KeyError", "OSError"), (*BROAD, "KeyError")),
    "QUAL-003": ((*BROAD, "ValueError", "TypeError"),) * 2,
    "QUAL-004": ((*BROAD, "ValueError", "TypeError"),) * 2,
}
SYNTAX = ("PY-001", "PY-005", "PY-006", "PY-007", "PY-008", "QUAL-003", "QUAL-004")
#: Rules on context: (first line, last line, pattern) around the match that make it harmless.
HARMLESS = {
    "SEC-001": [(0, 20, SANITIZED)],
    "SEC-002": [(-5, 15, SANITIZED)],
    "SEC-004": [(0, 0, r"execute\(\s*['\"][^'\"]*%s[^'\"]*['\"],\s*(?:[\[(]|\w+)"), (1, 3, r"^\s*[\[(]|,\s*[\[(]")],
    "SEC-005": [(0, 0, r"localhost|127\.0\.0\.1|0\.0\.0\.0|(?i:allowlist|noqa)")],
    "SEC-007": [(0, 0, r"page\.eval|literal_eval|\w+\.exec\(|re\.(?:search|match|findall|sub)\(.*eval|(?:assert|assert_not|not in|should not).*['\"].*eval|['\"].*eval.*['\"].*not in")],
    "SEC-010": [(0, 0, r"^(?!.*(?:\.\.|join\(|open\(|Path\())")],
}
CONTEXT = (*HARMLESS, "QUAL-010")
TAINT_RULES = ("SEC-004", "SEC-005", "SEC-010")
# Words that count as taint in lite mode, and rules whose fixes are safe.
TAINT_WORDS = re.compile(r"(request\.|input\(|sys\.argv|os\.environ|query|path|url|filename)")
SAFE = ("PY-004", "QUAL-013", "PY-008", "PY-010")


def line_of(starts: list[int], at: int) -> int:
    return bisect.bisect_right(starts, at)


class File:
    """One file's text with what the filters need, each made once and only if asked for."""

    def __init__(self, rel: str, lang: str, text: str):
        self.rel, self.lang, self.text = rel, lang, text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = text.split("\n")
        name = rel.rpartition("/")[2]
        self.test = "/tests/" in f"/{rel}" or name.startswith("test_") or name.endswith("_test.py") or name == "conftest.py"
        #: Other tests of some rules: by the name alone, and by either, with a dash too.
        self.named_test = name.startswith("test_") or name.endswith("_test.py")
        self.page_test = "/tests/" in f"/{rel}" or name.startswith(("test_", "test-"))
        self._made: dict[str, object] = {}

    def made(self, what: str, how):
        if what not in self._made:
            self._made[what] = how()
        return self._made[what]

    @property
    def facts(self) -> FileFacts:
        return self.made("facts", lambda: FileFacts(self.text))

    def inside(self, pattern: re.Pattern, at: int) -> bool:
        spans = self.made(pattern.pattern, lambda: [m.span() for m in pattern.finditer(self.text)])
        i = bisect.bisect_right(spans, (at, 1 << 62)) - 1
        return i >= 0 and spans[i][0] <= at < spans[i][1]

    def suppressed(self, rule: str, line: int) -> bool:
        spans = self.made("suppressed", self._suppressions)
        return any(a <= line <= b for a, b in spans.get(rule, ()))

    def _suppressions(self) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {}
        opened: dict[str, list[int]] = {}
        for i, text in enumerate(self.lines, 1):
            for kind, ids in re.findall(COMMENT, text):
                for r in filter(None, map(str.strip, ids.split(","))):
                    spans = out.setdefault(r, [])
                    if kind == "ignore":
                        spans.append((i, i))
                    elif kind == "ignore-file":
                        spans.append((0, END))
                    elif kind == "ignore-next" and i < len(self.lines):
                        spans.append((i + 1, i + 1))
                    elif kind == "ignore-start":
                        opened.setdefault(r, []).append(i)
                    elif kind == "ignore-end" and opened.get(r):
                        spans.append((opened[r].pop(), i))
        for r, at in opened.items():
            out[r] += [(a, END) for a in at]
        return out

    def near(self, line: int, first: int, last: int) -> list[str]:
        return self.lines[max(0, line - 1 + first) : line + last]

    def real_syntax(self, rule: str, line: int) -> bool:
        """Whether the syntax around a match leaves it a finding."""
        f, text = self.facts, self.lines[line - 1].strip()
        if rule == "PY-001":
            return any(r[2] == line and r[11] for r in f.rows["functions"]) if any(r[2] == line for r in f.rows["functions"]) else True
        if rule == "PY-006":
            return any(r[2] <= line <= r[3] for r in f.rows["functions"])
        if rule == "PY-008":
            return self._opens_without_encoding(line)
        if rule == "PY-007" and (self.named_test or re.search(r"os\.environ\[[^\]]+\]\s*=", text) or text.startswith("del ") or ".pop(" in text):
            return False
        if rule == "QUAL-004" and re.search(r"float\(\s*args\.\w", text):
            return False
        return not f.guarded(line, *GUARDS[rule])

    def real_context(self, rule: str, line: int) -> bool:
        if rule == "QUAL-010":
            return not (self.page_test or self._caught(line))
        if any(re.search(p, x) for a, b, p in HARMLESS[rule] for x in self.near(line, a, b)):
            return False
        if rule == "SEC-007":
            text = self.lines[line - 1]
            quoted = re.search(r"['\"].*\beval\b.*['\"]", text)
            return not (quoted and (self.page_test or "eval(" not in re.split(r"['\"]", text)[0]) or self.page_test and "pytest.fail" in text and "eval" in text)
        if rule == "SEC-004":
            name = re.search(r"\{(\w+)\}", self.lines[line - 1])
            if name and re.search(r"execute\(\s*f['\"]", self.lines[line - 1]):
                v = re.escape(name[1])
                known = rf"\bfor\s+{v}\s+in\s+[\(\[{{]|\b{v}\b.*\bin\s+\w*[Aa]llow|re\.match\(.*{v}"
                return not any(re.search(known, x) for x in self.near(line, -18, -1))
        return True

    def _opens_without_encoding(self, line: int) -> bool:
        """Of the line's calls, level by level through the tree, the first method call or open() decides."""
        calls = self.made("levels", lambda: [x for x in ast.walk(self.facts.tree) if isinstance(x, ast.Call)])
        for c in (c for c in calls if c.lineno == line):
            if isinstance(c.func, ast.Attribute):
                return False
            if isinstance(c.func, ast.Name) and c.func.id == "open":
                modes = [*c.args[1:2], *(k.value for k in c.keywords if k.arg == "mode")]
                binary = any(isinstance(m, ast.Constant) and isinstance(m.value, str) and "b" in m.value for m in modes)
                return not (binary or any(k.arg == "encoding" for k in c.keywords))
        return True

    def _caught(self, line: int) -> bool:
        """Whether the nearest try within 40 lines above, with no function between, has a catch within 40 below."""
        here = self.lines[line - 1]
        if "try" in here and "catch" in here:
            return True
        for text in reversed([x.strip() for x in self.near(line, -38, -1)]):
            if re.search(r"\btry\s*\{?$", text) or text.startswith("try{"):
                return any("catch" in x for x in self.near(line, 1, 40))
            if re.search(r"\b(?:function|class|=>)\b", text) and "{" in text:
                return False
        return False

    def tainted(self, line: int) -> bool:
        names = set().union(*(n for a, b, n in self.made("taint", self.facts.taint_scopes) if a <= line <= b))
        return any(re.search(rf"\b{re.escape(n)}\b", self.lines[line - 1]) for n in names)


def confidence(rule: str, ast_ok: bool, context_ok: bool) -> float:
    if ast_ok:
        return 0.95
    if context_ok:
        return 0.85
    return 0.8 if rule.startswith("SEC-") else 0.7 if rule.startswith("QUAL-") else 0.65


def scan_text(rel: str, lang: str, text: str, rules: list[tuple], policy: str = "balanced", taint: str = "lite", include_tests: bool = False) -> list[tuple]:
    """Findings of one file, as rows of FINDINGS."""
    f, out, python = File(rel, lang, text), [], lang == "python"
    dropped = () if policy == "strict" or include_tests or not f.test else DROPPED_RELAXED if policy == "relaxed-tests" else DROPPED_BALANCED
    for rule, severity, langs, pattern, message, cwe, owasp in rules:
        if lang not in langs:
            continue
        for m in re.finditer(pattern, text, re.M):
            at, line = m.start(), line_of(f.starts, m.start())
            if python:
                if rule in NOT_IN_STRINGS_OR_COMMENTS and f.inside(NON_CODE, at) or rule in NOT_IN_STRINGS and f.inside(STRINGS, at) or f.suppressed(rule, line):
                    continue
            if rule in dropped:
                continue
            ast_ok = python and rule in SYNTAX and f.facts.tree is not None
            if ast_ok and not f.real_syntax(rule, line):
                continue
            context_ok = rule in CONTEXT
            if context_ok and not f.real_context(rule, line):
                continue
            hit = None
            if python and taint != "off" and rule in TAINT_RULES:
                hit = f.tainted(line) or taint == "lite" and bool(TAINT_WORDS.search(f.lines[line - 1]))
                if taint == "lite" and not hit:
                    continue
            tier = "safe" if rule in SAFE else "cautious" if severity == "LOW" else "manual"
            path = " + ".join(["pattern", *["ast"] * ast_ok, *["context"] * context_ok, *["taint"] * (hit is not None)])
            out.append((rel, rule, severity, line, at - f.starts[line - 1] + 1, at, m[0], message, cwe, owasp, ast_ok, context_ok, python and f.inside(NON_CODE, at), hit, confidence(rule, ast_ok, context_ok), tier, path))
    return out


def scan(files: DataFrame, rules: list[tuple] | None = None, policy: str = "balanced", taint: str = "lite", include_tests: bool = False) -> DataFrame:
    """Findings of all files. A file is one row of text, so tasks are as even as Spark's batches; nothing is shuffled."""
    rules = RULES if rules is None else rules
    langs = sorted({x for r in rules for x in r[2]})
    names = [c.split()[0] for c in FINDINGS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [x for rel, lang, text in zip(pdf["rel"], pdf["lang"], pdf["content"], strict=True) for x in scan_text(rel, lang, text or "", rules, policy, taint, include_tests)]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("lang").isin(*langs)).select("rel", "lang", "content").mapInPandas(run, FINDINGS)
