"""Calls of user interfaces and routes of servers as places: file, line, method, and whether the handler reads the request."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_relative, route
from . import relational

# Call patterns of user interfaces and route patterns of servers, group 1 is the path; what tells a method; what reads a request.
CALLS = [
    (r"""fetch\(\s*['"`]([^'"`\s]+)['"`]""", "fetch"), (r"""axios\.(?:get|post|put|delete|patch)\(\s*['"`]([^'"`\s]+)['"`]""", "axios"), (r"""\$\.(?:ajax|get|post)\(\s*['"`]([^'"`\s]+)['"`]""", "jquery"),
    (r"""api\(\s*['"`]([^'"`\s]+)['"`]""", "api"), (r"""XMLHttpRequest[^;]*\.open\(\s*['"][^'"]*['"]\s*,\s*['"]([^'"]+)['"]""", "xhr"), (r"""action\s*=\s*['"]([^'"]+)['"]""", "form_action"), (r"""href\s*=\s*['"](/api/[^'"]+)['"]""", "href"),
]
ROUTES = [
    (r"""@\w+\.route\(\s*['"]([^'"]+)['"]""", "flask"), (r"""@\w+\.(?:get|post|put|delete|patch)\(\s*['"]([^'"]+)['"]""", "fastapi"), (r"""(?:^|,)\s*path\(\s*['"]([^'"]+)['"]""", "django"), (r"""re_path\(\s*['"]([^'"]+)['"]""", "django"),
    (r"""(?:app|router)\.(?:get|post|put|delete|patch|all|use)\(\s*['"]([^'"]+)['"]""", "express"), (r"""path\s*==\s*['"]([^'"]+)['"]""", "equality"),
]
METHOD = r"(?i)(?:method|methods)\s*[:=]\s*['\"\[]*\s*(GET|POST|PUT|DELETE|PATCH)"
VERB = r"(?i)\.(get|post|put|delete|patch)\("
RECEIVES = r"request\.(?:json|form|args|data|files|values|get_json|POST|GET|body|query_params)|req\.(?:body|params|query|file|files)|self\._read_body\(\)"
PLACE = "rel string, kind string, url string, line long, start long, context string, body string"


def places(files: DataFrame, patterns: list[tuple[str, str]], around: int, body: int = 0) -> DataFrame:
    """Every match of every pattern: its group 1 as url, 1-based line, offset, the text from `around` signs before to as many after it, and the `body` lines that follow its own.

    One pass over each file for all patterns; the starts of its lines are found once.
    """
    names = [c.split()[0] for c in PLACE.split(", ")]

    def of(rel: str, text: str) -> Iterator[tuple]:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        for pattern, kind in patterns:
            for m in re.finditer(pattern, text, re.M):
                line = bisect.bisect_right(starts, m.start())
                last = starts[line + body] if line + body < len(starts) else len(text)
                after = text[starts[line] : last] if body and line < len(starts) else ""
                yield rel, kind, m[1], line, m.start(), text[max(0, m.start() - around) : m.end() + around], after

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for rel, text in zip(pdf["rel"], pdf["content"], strict=True) for x in of(rel, text or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("rel", "content").mapInPandas(run, PLACE)


def ui_calls(files: DataFrame) -> DataFrame:
    """rel, line, kind, url (without its query), method and route of every relative call in script and markup files."""
    rows = places(files.where("ext in ('js', 'jsx', 'ts', 'tsx', 'html', 'htm', 'vue')"), CALLS, 100).where(is_relative(F.col("url")))
    hint = F.upper(F.regexp_extract("context", METHOD, 1))
    method = F.when(hint != "", hint).when((F.col("kind") == "form_action") | F.col("kind").contains("post"), "POST").otherwise("UNKNOWN")
    return rows.select("rel", "line", "kind", F.substring_index("url", "?", 1).alias("url"), method.alias("method"), route(F.col("url")).alias("route"))


def server_routes(files: DataFrame) -> DataFrame:
    """rel, line, kind, url, method, receives_input and route of every handler. A verb close by tells the method, else a hint, else it is ANY."""
    rows = places(files.where("ext in ('py', 'js', 'ts')"), ROUTES, 60, 30)
    url = F.when(F.col("url").startswith("/"), F.col("url")).otherwise(F.concat(F.lit("/"), F.col("url")))
    verb, hint = (F.upper(F.regexp_extract("context", p, 1)) for p in (VERB, METHOD))
    method = F.when(verb != "", verb).when(hint != "", hint).otherwise("ANY")
    return rows.select("rel", "line", "kind", url.alias("url"), method.alias("method"), F.col("body").rlike(RECEIVES).alias("receives_input"), route(url).alias("route"))


def connected(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Both sides' places with what they are: route, status (wired, orphan_ui, orphan_backend), cardinality, side, rel, line, kind, url, method, receives_input."""
    both = calls.withColumns({"side": F.lit("ui"), "receives_input": F.lit(None).cast("boolean")}).unionByName(routes.withColumn("side", F.lit("backend")))
    kinds = relational.wiring(calls, routes, "route").select("route", "status", "cardinality")
    return both.join(kinds, "route").select("route", "status", "cardinality", "side", "rel", "line", "kind", "url", "method", "receives_input")
