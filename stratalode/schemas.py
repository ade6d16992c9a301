"""Schemas of the fact tables."""

from __future__ import annotations

FILES = "rel string, name string, ext string, lang string, size long, sha256 string, content string"
FINDINGS = (
    "rel string, rule_id string, severity string, line long, col long, start long, matched_text string, message string, cwe string, owasp string, "
    "ast_validated boolean, context_validated boolean, in_string boolean, taint_matched boolean, confidence double, tier string, signal_path string"
)
FUNCTIONS = (
    "rel string, qualname string, name string, line long, end_line long, n_lines long, n_params long, complexity long, nesting long, n_returns long, "
    "mutable_default boolean, is_entry boolean, returns_value boolean, in_class boolean"
)
CALLS = "rel string, caller string, caller_line long, callee string, line long, is_attr boolean, has_encoding boolean, is_binary boolean"
CLASSES = "rel string, name string, line long, n_lines long, n_methods long, bases array<string>"
FIELDS = "rel string, model string, field string, type string"
IMPORTS = "rel string, line long, module string, name string, bound string, relative boolean"
NAMES = "rel string, name string"
STRINGS = "rel string, value string"
TRIES = "rel string, first long, handler long, caught array<string>, is_bare boolean"
CONSTANTS = "rel string, function string, line long, value string"
ERRORS = "rel string, error string"
FACTS = {
    "functions": FUNCTIONS, "calls": CALLS, "classes": CLASSES, "fields": FIELDS, "imports": IMPORTS, "names": NAMES, "strings": STRINGS, "tries": TRIES,
    "constants": CONSTANTS, "errors": ERRORS,
}
EVENTS = "rel string, change string"
