"""Scalar expressions over paths, routes, versions, tokens and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their languages.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "html": "html", "htm": "html", "rs": "rust"}


def language(path: Column) -> Column:
    """Language by extension, in any case; null for other files."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def module_name(rel: Column) -> Column:
    """pkg/mod.py and pkg/mod/__init__.py to pkg.mod."""
    return F.regexp_replace(F.regexp_replace(F.replace(rel, F.lit("/"), F.lit(".")), r"\.py$", ""), r"\.__init__$", "")


def parent(rel: Column) -> Column:
    """Everything before the last slash, or '.'."""
    return F.coalesce(F.nullif(F.regexp_extract(rel, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def route(url: Column) -> Column:
    """Query dropped, then end slashes; empty is '/'; every kind of parameter becomes _PARAM_."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)\?.*$", ""), "/+$", "")
    return F.regexp_replace(F.when(bare == "", "/").otherwise(bare), r"<[^>]+>|:\w+|\{[^}]+\}", "_PARAM_")


def route_key(url: Column) -> Column:
    """The other route form: end slashes dropped before the query, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"(?s)\?.*$", "")
    for p in (r"<(\w+)(?::\w+)?>", r":(\w+)", r"\{(\w+)\}"):
        bare = F.regexp_replace(bare, p, "_PARAM_")
    return F.lower(bare)


def is_relative(url: Column) -> Column:
    return url.startswith("/") & ~url.startswith("//")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    terms = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: -share(c) * F.log2(share(c)))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def package(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "_.", "--")


def safe_id(text: Column) -> Column:
    return F.left(F.regexp_replace(text, r"\W", "_"), F.lit(40))


def version_parts(version: Column) -> Column:
    """Leading digits of each dotted part, as numbers; parts without any are 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))


def version_at_least(a: Column, b: Column) -> Column:
    """a >= b, the shorter padded with zeros."""
    n = F.greatest(F.size(version_parts(a)), F.size(version_parts(b)))
    pad = lambda v: F.slice(F.concat(version_parts(v), F.array_repeat(F.lit(0), 16)), F.lit(1), n)
    return pad(a) >= pad(b)


def grade(score: Column, *steps: tuple[float, str], below: str, ascending: bool = False) -> Column:
    """A ladder: the first step that the score reaches (or, ascending, doesn't exceed)."""
    out = None
    for at, name in steps:
        test = score <= at if ascending else score >= at
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(below)


def cut_to(score: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def normal_line(line: Column) -> Column:
    """A code line as fingerprints compare it: comment off, lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"(#|//).*$", ""), r"\s+", " ")))
