"""Project-level audits: health, readiness, portability, dependencies, design thresholds, contracts of tools' output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import package, version_at_least
from . import relational

# What a healthy project has; any of the paths will do.
HEALTH = [
    ("README", "HIGH", ("README.md", "README.rst", "README.txt", "README")), ("LICENSE", "MEDIUM", ("LICENSE", "LICENSE.md", "LICENSE.txt", "LICENCE", "COPYING")), (".gitignore", "MEDIUM", (".gitignore",)),
    ("Requirements", "HIGH", ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "poetry.lock", "uv.lock")),
    ("CI Config", "LOW", (".github/workflows", ".gitlab-ci.yml", "Jenkinsfile", ".circleci", ".travis.yml", "azure-pipelines.yml")), ("Tests", "HIGH", ("tests", "test", "tests.py", "test.py")),
    ("Type Hints", "LOW", ("py.typed", "pyproject.toml", "mypy.ini", ".mypy.ini", "pyrightconfig.json")), ("Linter Config", "LOW", (".ruff.toml", "ruff.toml", "pyproject.toml", ".flake8", ".pylintrc", "tox.ini")),
    ("Changelog", "LOW", ("CHANGELOG.md", "CHANGELOG.rst", "CHANGES.md", "HISTORY.md")), ("Editor Config", "LOW", (".editorconfig",)),
]
# Thresholds of the design review: measure, test, severity, category.
DESIGN = [
    ("orphan_ui", "> 5", "HIGH", "connectivity"), ("orphan_backend", "> 10", "MEDIUM", "connectivity"), ("health", "< 50", "HIGH", "health"), ("smells", "> 50", "MEDIUM", "quality"),
    ("duplicates", "> 20", "MEDIUM", "quality"), ("cycles", "> 0", "HIGH", "structure"), ("dead", "> 20", "LOW", "quality"),
]
USER_PATH, DRIVE_PATH = r"(?i)[A-Z]:[/\\]+Users[/\\]+\w+|/(?:home|Users)/\w+/", r"[A-Z]:[/\\]+(?!Users|Windows|Program)\w+"
EXISTENCE = r"\.(?:is_dir|is_file|exists)\(|os\.path\.(?:exists|isdir|isfile)\("


def health(files: DataFrame) -> DataFrame:
    """name, severity, found (the first alternative in order that exists), passed. A directory exists if a file lies in it."""
    spark = files.sparkSession
    want = spark.createDataFrame([(i, n, s, j, p) for i, (n, s, ps) in enumerate(HEALTH) for j, p in enumerate(ps)], "i int, name string, severity string, j int, path string")
    have = files.select(F.explode(F.array("rel", F.split("rel", "/")[0], F.array_join(F.slice(F.split("rel", "/"), 1, 2), "/"))).alias("path")).distinct()
    got = want.join(have, "path", "left_semi").groupBy("i").agg(F.min_by("path", "j").alias("found"))
    names = want.select("i", "name", "severity").distinct()
    return names.join(got, "i", "left").select("i", "name", "severity", "found", F.col("found").isNotNull().alias("passed"))


def health_score(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bround(100.0 * F.count_if("passed") / F.count(F.lit(1)), 0).cast("long").alias("score"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def readiness(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Seven checks (name, severity, passed) of one pass over the files and one over Python lines."""
    f = files.agg(
        F.bool_or((F.col("rel") == "pyproject.toml") & F.lower("content").contains("version")).alias("Version defined"), F.bool_or(F.col("rel").isin("CHANGELOG.md", "CHANGELOG.rst", "CHANGES.md", "HISTORY.md")).alias("Changelog exists"),
        F.bool_or(F.col("rel").rlike("^tests?/")).alias("Tests exist"), F.bool_or(F.col("rel").rlike("^README")).alias("README exists"), F.bool_or(F.col("rel").rlike("^LICEN[CS]E|^COPYING")).alias("License exists"),
    )
    py = lines.where(F.col("rel").endswith(".py")).agg((F.count_if(F.col("text").rlike(r"(?i)\b(FIXME|XXX|BUG)\b")) == 0).alias("No critical markers"), (F.count_if(F.col("text").rlike(r"^\s*print\s*\(")) < 5).alias("Few prints"))
    names = [("Version defined", "HIGH"), ("Changelog exists", "MEDIUM"), ("No critical markers", "HIGH"), ("Tests exist", "HIGH"), ("README exists", "HIGH"), ("License exists", "MEDIUM"), ("Few prints", "LOW")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias("passed")) for n, s in names]))
    return f.crossJoin(py).select(rows.alias("c")).select("c.*")  # one row each


def hardcoded_paths(lines: DataFrame) -> DataFrame:
    """Path literals of one machine, outside comments, docstrings, asserts and chains that test for existence within 5 lines."""
    ls = relational.quote_parity(lines, "rel")
    kind = F.when(F.col("text").rlike(USER_PATH), "PORT-001").when(F.col("text").rlike(r"[A-Z]:[/\\]+AI[/\\]"), "PORT-002").when(F.col("text").rlike(DRIVE_PATH), "PORT-003")
    hit = ls.where(~F.col("in_docstring") & ~F.col("text").rlike(r"^\s*#") & ~F.col("text").rlike(r"^\s*assert .*==")).withColumn("rule_id", kind).where("rule_id is not null")
    chain = lines.where(F.col("text").rlike(EXISTENCE)).select(F.col("rel").alias("r"), F.explode(F.sequence(F.col("line") - 5, F.col("line") + 5)).alias("l")).distinct()
    out = hit.join(chain, (F.col("rel") == F.col("r")) & (F.col("line") == F.col("l")), "left_anti")
    return out.select("rel", "line", "rule_id", F.when(F.col("rule_id") == "PORT-003", "MEDIUM").otherwise("HIGH").alias("severity"), "text")


def audit_summary(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """PASS for each project without HIGH issues, with counts."""
    by = issues.groupBy("project").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")])
    got = projects.select("project").distinct().join(by, "project", "left").na.fill(0)
    return got.withColumn("status", F.when(F.col("high") == 0, "PASS").otherwise("FAIL"))


def path_flags(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A boolean column a pattern, for files that any matches."""
    got = files.select("rel", *[F.col("content").rlike(p).alias(n) for n, p in patterns.items()])
    return got.where(reduce(lambda a, b: a | b, [F.col(n) for n in patterns]))


def vulnerabilities(reports: DataFrame) -> DataFrame:
    """package, version, id, severity of dependency reports (JSON strings): HIGH with a CVE alias or GHSA id, else MEDIUM."""
    schema = "dependencies array<struct<name: string, version: string, vulns: array<struct<id: string, aliases: array<string>, fix_versions: array<string>>>>>"
    d = reports.select(F.explode(F.from_json("report", schema)["dependencies"]).alias("d")).select("d.name", "d.version", F.explode("d.vulns").alias("v"))
    high = F.exists(F.coalesce("v.aliases", F.array().cast("array<string>")), lambda a: a.startswith("CVE-")) | F.col("v.id").startswith("GHSA") | F.col("v.id").startswith("CVE-")
    return d.select(package(F.col("name")).alias("package"), "version", F.col("v.id").alias("id"), F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"), F.col("v.fix_versions").alias("fixed_in"))


def imported_report(reports: DataFrame) -> DataFrame:
    """Findings of another linter's JSON report."""
    schema = "results array<struct<filename: string, line_number: long, test_id: string, issue_severity: string, issue_text: string>>"
    r = reports.select(F.explode(F.from_json("report", schema)["results"]).alias("r"))
    return r.select(F.col("r.filename").alias("rel"), F.col("r.line_number").alias("line"), F.col("r.test_id").alias("rule_id"), F.upper("r.issue_severity").alias("severity"), F.col("r.issue_text").alias("message"))


def outdated(installed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packages below their least version, numerically part by part."""
    w = wanted.select(package(F.col("package")).alias("package"), F.col("version").alias("least"))
    return installed.select(package(F.col("package")).alias("package"), "version").join(w, "package").where(~version_at_least(F.col("version"), F.col("least")))


def design_review(measures: DataFrame) -> DataFrame:
    """Findings for the measures (name, value) beyond their thresholds, and the overall recommendation in each row."""
    tests = reduce(lambda a, b: a.unionByName(b), [measures.where(f"name = '{n}' and value {t}").select("name", "value", F.lit(s).alias("severity"), F.lit(c).alias("category")) for n, t, s, c in DESIGN])
    high, medium = F.count_if(F.col("severity") == "HIGH"), F.count_if(F.col("severity") == "MEDIUM")
    advice = tests.agg(F.when(high >= 2, "refactor first").when(medium >= 3, "plan improvements").otherwise("fine").alias("advice"))
    return tests.crossJoin(advice)  # one row


def test_runs(outputs: DataFrame) -> DataFrame:
    """passed, failed, errors of each run's text: the last line that has counts."""
    last = F.element_at(F.filter(F.split("output", "\n"), lambda x: x.rlike(r"\d+ (passed|failed|error)")), -1)
    n = lambda w: F.coalesce(F.nullif(F.regexp_extract(last, rf"(\d+) {w}", 1), F.lit("")).cast("long"), F.lit(0)).alias(w)
    return outputs.where(F.col("output").rlike(r"\d+ (passed|failed|error)")).select("run", n("passed"), n("failed"), n("error"))


def test_stubs(functions: DataFrame) -> DataFrame:
    """A test stub for every public function of 3 lines or more outside tests."""
    f = functions.where(~F.col("name").startswith("_") & (F.col("n_lines") >= 3) & ~F.col("rel").contains("test"))
    return f.select("rel", "name", F.format_string("def test_%s():\n    result = %s()\n    assert result is not None", "name", "name").alias("stub"))
