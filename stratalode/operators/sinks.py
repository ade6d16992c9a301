"""Findings as SARIF, JSON, Markdown, text and Mermaid. Each is built from at most the rows it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_id


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "HIGH", "error").when(severity == "MEDIUM", "warning").when(severity == "LOW", "note").otherwise("warning")


def category(rule_id: Column) -> Column:
    return F.when(rule_id.startswith("SEC-"), "security").when(rule_id.startswith("QUAL-"), "quality").when(rule_id.startswith("PY-"), "python").when(rule_id.startswith("PORT-"), "portability").otherwise("general")


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One JSON result a row; rules has rule_id and rule_index."""
    place = F.struct(F.struct(F.struct(F.col("rel").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("col", F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.join(F.broadcast(rules.select("rule_id", "rule_index")), "rule_id").select("rel", "line", "col", F.to_json(row).alias("result"))


def sarif(findings: DataFrame, tool: str, version: str = "1.0.0") -> str:
    """A whole SARIF 2.1.0 document on the driver, for reports that fit there; sarif_results() writes any number of rows."""
    import json

    rules: dict[str, dict] = {}
    results = []
    for r in findings.orderBy("rel", "line", "col", "rule_id").toLocalIterator():
        tags = [t for t in ({"SEC": "security", "QUAL": "quality", "PY": "python", "PORT": "portability"}.get(r.rule_id.split("-")[0], "general"), r.cwe, r.owasp) if t]
        rules.setdefault(r.rule_id, {"id": r.rule_id, "index": len(rules), "properties": {"tags": tags}, "shortDescription": {"text": r.message}})
        level = {"HIGH": "error", "MEDIUM": "warning", "LOW": "note"}.get(r.severity, "warning")
        where = {"physicalLocation": {"artifactLocation": {"uri": r.rel}, "region": {"startLine": max(1, r.line), "startColumn": max(1, r.col)}}}
        results.append({"ruleId": r.rule_id, "ruleIndex": rules[r.rule_id]["index"], "level": level, "message": {"text": r.message}, "locations": [where]})
    for x in rules.values():
        del x["index"]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": list(rules.values())}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def review_comments(findings: DataFrame, most: int = 25) -> DataFrame:
    """The first findings by severity, file and line, as Markdown lines; most is kept between 1 and 100."""
    most = max(1, min(100, most))
    order = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).when(F.col("severity") == "LOW", 2).otherwise(3)
    line = F.format_string("- **%s** `%s:%d` %s (%s)", "severity", "rel", "line", "message", "rule_id")
    return findings.orderBy(order, "rel", "line", "rule_id").limit(most).select("rel", "line", line.alias("comment"))


def mermaid(wires: DataFrame, key: str, most_wired: int = 30, most_orphans: int = 15) -> str:
    """A flow chart of wired and orphan routes, of at most so many nodes a kind."""
    out = ["graph LR"]
    for status, most in (("wired", most_wired), ("orphan_ui", most_orphans), ("orphan_backend", most_orphans)):
        for r in wires.where(F.col("status") == status).orderBy(key).limit(most).select(safe_id(F.col(key)).alias("i"), key).collect():
            out.append(f'  {r.i}["{r[1]}"]:::{status}')
    return "\n".join(out)
