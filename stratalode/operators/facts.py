"""Syntax facts of Python files: one Arrow pass parses each file once and fills every fact table."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import FACTS

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert)
BLOCKS = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ExceptHandler)
# Base classes of models, entry decorators, numbers that aren't magic.
MODELS = ("BaseModel", "Schema", "TypedDict", "SQLModel")
ENTRIES = ("route", "get", "post", "put", "delete", "patch", "command", "fixture")
PLAIN = (0, 1, -1, 2, 100)
# What taints a name or expression.
TAINTED = re.compile(r"(?:user|input|query|param|body|payload|request|req|url|path|file|name|dest|target)", re.I)
TAINTED_ATTRIBUTES = ("args", "form", "json", "GET", "POST", "values", "query_params", "path_params", "headers", "body", "data", "argv", "environ")


def parsed(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def label(node: ast.AST | None) -> str:
    """The last name of a name or attribute."""
    return getattr(node, "id", None) or getattr(node, "attr", None) or ""


def annotation(node: ast.AST | None) -> str:
    if isinstance(node, ast.Constant):
        return "None" if node.value is None else str(node.value)
    if isinstance(node, ast.Subscript):
        return f"{annotation(node.value)}[{annotation(node.slice)}]"
    if isinstance(node, ast.Tuple):
        return ", ".join(map(annotation, node.elts))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return f"{annotation(node.left)} | {annotation(node.right)}"
    return label(node) or "Any"


def depth(node: ast.AST) -> int:
    """The most blocks within one another below node; try and its handlers each count."""
    most, todo = 0, [(node, 0)]
    while todo:
        n, d = todo.pop()
        most = max(most, d)
        todo += [(c, d + isinstance(c, BLOCKS)) for c in ast.iter_child_nodes(n)]
    return most


class FileFacts:
    """Every fact of one file, as rows in the order of the schemas, without rel."""

    def __init__(self, text: str):
        self.rows: dict[str, list[tuple]] = {k: [] for k in FACTS}
        self.tree = parsed(text)
        if self.tree is None:
            self.rows["errors"].append(("unparsable",))
            return
        self._scope(self.tree, "", "<module>", 0, False)
        for node in ast.walk(self.tree):
            self._node(node)

    def _scope(self, node: ast.AST, prefix: str, caller: str, line: int, in_class: bool) -> None:
        """Calls with the function they stand in, and functions with their qualified names."""
        for c in ast.iter_child_nodes(node):
            if isinstance(c, FUNCTION):
                self._function(c, f"{prefix}{c.name}", in_class)
                self._scope(c, f"{prefix}{c.name}.", f"{prefix}{c.name}", c.lineno, False)
            elif isinstance(c, ast.ClassDef):
                methods = sum(isinstance(x, FUNCTION) for x in c.body)
                self.rows["classes"].append((c.name, c.lineno, (c.end_lineno or c.lineno) - c.lineno + 1, methods, [label(b) for b in c.bases]))
                if any(label(b) in MODELS for b in c.bases):
                    self.rows["fields"] += [(c.name, x.target.id, annotation(x.annotation)) for x in c.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
                self._scope(c, f"{prefix}{c.name}.", caller, line, True)
            else:
                if isinstance(c, ast.Call) and label(c.func):
                    words = {k.arg: k.value for k in c.keywords}
                    mode = words.get("mode") or (c.args[1] if len(c.args) > 1 else None)
                    binary = isinstance(mode, ast.Constant) and isinstance(mode.value, str) and "b" in mode.value
                    self.rows["calls"].append((caller, line, label(c.func), c.lineno, isinstance(c.func, ast.Attribute), "encoding" in words, binary))
                self._scope(c, prefix, caller, line, in_class)

    def _function(self, f: ast.FunctionDef, qualname: str, in_class: bool) -> None:
        a = f.args
        n = len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg) - bool(a.args and a.args[0].arg in ("self", "cls"))
        within = list(ast.walk(f))
        complexity = 1 + sum(isinstance(x, BRANCHES) for x in within) + sum(len(x.values) - 1 for x in within if isinstance(x, ast.BoolOp))
        returns = [x for x in within if isinstance(x, ast.Return)]
        valued = any(r.value is not None and not (isinstance(r.value, ast.Constant) and r.value.value is None) for r in returns)
        mutable = any(isinstance(d, (ast.List, ast.Dict, ast.Set, ast.Call)) for d in [*a.defaults, *[x for x in a.kw_defaults if x]])
        entry = f.name == "main" or any(label(d.func if isinstance(d, ast.Call) else d) in ENTRIES for d in f.decorator_list)
        end = f.end_lineno or f.lineno
        self.rows["functions"].append((qualname, f.name, f.lineno, end, end - f.lineno + 1, n, complexity, depth(f), len(returns), mutable, entry, valued, in_class))
        for x in within:
            if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) and x.value not in PLAIN:
                self.rows["constants"].append((qualname, x.lineno, repr(x.value)))

    def _node(self, x: ast.AST) -> None:
        if isinstance(x, ast.Import):
            self.rows["imports"] += [(x.lineno, n.name, "", n.asname or n.name.split(".")[0], False) for n in x.names]
        elif isinstance(x, ast.ImportFrom):
            self.rows["imports"] += [(x.lineno, x.module or "", n.name, n.asname or n.name, x.level > 0) for n in x.names]
        elif isinstance(x, ast.Name):
            self.rows["names"].append((x.id,))
        elif isinstance(x, ast.Constant) and isinstance(x.value, str):
            self.rows["strings"].append((x.value,))
        elif isinstance(x, ast.Try):
            caught, bare = [], False
            for h in x.handlers:
                bare |= h.type is None
                caught += [f"({label(e)}" for e in h.type.elts] if isinstance(h.type, ast.Tuple) else [label(h.type)] if h.type is not None else []
            first = x.handlers[0].lineno if x.handlers else x.end_lineno or x.lineno
            self.rows["tries"].append((x.lineno, first, caught, bare))

    def guarded(self, line: int, alone: tuple[str, ...], in_tuple: tuple[str, ...]) -> bool:
        """Whether a try body that holds the line catches everything or one of the names."""
        return any(a <= line < b and (bare or any(c in alone or c[:1] == "(" and c[1:] in in_tuple for c in caught)) for a, b, caught, bare in self.rows["tries"])

    def taint_scopes(self) -> list[tuple[int, int, set[str]]]:
        """(first line, last line, tainted names) of the module and of each function."""
        if self.tree is None:
            return []
        out = [(1, 1 << 30, self._tainted([x for x in ast.walk(self.tree) if isinstance(x, ast.Assign)], set()))]
        for f in ast.walk(self.tree):
            if isinstance(f, FUNCTION):
                names = {a.arg for a in [*f.args.args, *f.args.kwonlyargs] if TAINTED.search(a.arg)}
                own = sorted((x for x in ast.walk(f) if isinstance(x, ast.Assign)), key=lambda x: x.lineno)
                out.append((f.lineno, f.end_lineno or f.lineno, self._tainted(own, names)))
        return out

    @staticmethod
    def _tainted(assigns: list[ast.Assign], names: set[str]) -> set[str]:
        for x in assigns:
            source = any(
                isinstance(c, ast.Name) and (TAINTED.search(c.id) or c.id in names) or isinstance(c, ast.Attribute) and c.attr in TAINTED_ATTRIBUTES
                or isinstance(c, ast.Call) and label(c.func) in ("input", "raw_input") for c in ast.walk(x.value)
            )
            if source:
                names |= {n.id for t in x.targets for n in ast.walk(t) if isinstance(n, ast.Name)}
        return names


def _columns(schema: str) -> str:
    return schema.removeprefix("rel string, ")


NESTED = "rel string, " + ", ".join(f"{k} array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in _columns(s).split(', '))}>>" for k, s in FACTS.items())


def extract(files: DataFrame) -> DataFrame:
    """One row a Python file with an array for each fact table. Store it, then take tables from it."""
    names = {k: [c.split()[0] for c in _columns(s).split(", ")] for k, s in FACTS.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for rel, text in zip(pdf["rel"], pdf["content"], strict=True):
                rows = FileFacts(text or "").rows
                out.append([rel, *([dict(zip(names[k], r, strict=True)) for r in rows[k]] for k in FACTS)])
            yield pd.DataFrame(out, columns=["rel", *FACTS])

    return files.where("lang = 'python'").select("rel", "content").mapInPandas(run, NESTED)


def fact(extracted: DataFrame, name: str) -> DataFrame:
    return extracted.select("rel", F.explode(name).alias("f")).select("rel", "f.*")
