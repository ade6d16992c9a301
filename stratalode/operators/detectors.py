"""Line and text detectors: debt markers, generated-code marks, web smells, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy

# Debt markers in order, the first that a line holds counts; their category and hours.
DEBT = [
    (r"(?i)\b(FIXME)\b", "defect", 1.0), (r"(?i)\b(BUG|BUGFIX)\b", "defect", 1.0), (r"(?i)\b(XXX)\b", "defect", 1.0), (r"(?i)\b(SECURITY)\b", "defect", 1.0),
    (r"(?i)\b(HACK)\b", "design", 2.0), (r"(?i)\b(WORKAROUND)\b", "design", 2.0), (r"(?i)\b(KLUDGE)\b", "design", 2.0), (r"(?i)\b(TODO)\b", "design", 2.0), (r"(?i)\b(OPTIMIZE|PERF)\b", "design", 2.0),
    (r"(?i)\b(TECH.?DEBT|DEBT)\b", "debt", 3.0), (r"(?i)\b(NOQA|type:\\s*ignore)\b", "test", 0.5), (r"(?i)\b(DOCME|DOCUMENT|UNDOCUMENTED)\b", "documentation", 0.25),
]
# Marks of generated code.
GENERATED = [
    (r"(?i)#\s*(Generated by|Auto-generated|AI-generated|Created by ChatGPT|Created by Copilot|Generated with)", "generation comment"),
    (r"(?i)#\s*TODO:?\s*(implement|add|fill|complete)\s+(this|the|your)", "placeholder marker"),
    (r'(?i)"""[\s\S]{0,20}(Args|Returns|Raises|Example|Note):', "formulaic docstring"),
    (r"(?i)pass\s*#\s*(placeholder|implement|todo)", "pass with placeholder"),
]
# Web smells and their severities.
WEB = [
    (r"\bdocument\.write\b", "HIGH"), (r"\beval\s*\(", "HIGH"), (r"\binnerHTML\s*=", "MEDIUM"), (r"console\.(log|debug|info|warn|error)\s*\(", "LOW"),
    (r"font-size:\s*\d+px", "LOW"), (r"!important", "LOW"), (r"\bvar\s+", "MEDIUM"), (r"==(?!=)", "MEDIUM"), (r"\.then\s*\(.*\.then\s*\(", "MEDIUM"),
    (r"setTimeout\s*\([^,]+,\s*0\s*\)", "LOW"), (r"<script\s+src\s*=\s*[\"']http:", "HIGH"), (r"<img(?![^>]*alt\s*=)[^>]*>", "MEDIUM"),
]
# Key formats, and names whose values are suspicious.
KEYS = [r"sk-[a-zA-Z0-9]{20,}", r"ghp_[a-zA-Z0-9]{36,}", r"gho_[a-zA-Z0-9]{36,}", r"AKIA[0-9A-Z]{16}", r"xox[bpsar]-[a-zA-Z0-9\-]+", r"AIza[0-9A-Za-z\-_]{35}", r"EAAC[a-zA-Z0-9]+"]
NAMES = r"(?i)(api_key|apikey|secret|password|passwd|token|auth_token|access_key|private_key|credentials)"
ASSIGNED = NAMES + r"\w*\s*[:=]\s*[\"']([^\"']{8,})[\"']"


def first_of(patterns: list[tuple], column: str):
    """The index of the first pattern that a line holds, or null: one pass over a ladder."""
    out = F.lit(None).cast("int")
    for i in range(len(patterns) - 1, -1, -1):
        out = F.when(F.col(column).rlike(patterns[i][0]), F.lit(i)).otherwise(out)
    return out


def debt(lines: DataFrame, key: str) -> DataFrame:
    """key, line, marker (as written, in capitals), category, hours, note of each line with a debt marker: what follows its #, or the whole line."""
    rows = lines.withColumn("i", first_of(DEBT, "text")).where("i is not null")
    marker = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p, _, _ in DEBT])
    cats, hours = (F.array(*map(F.lit, x)) for x in ([c for _, c, _ in DEBT], [h for _, _, h in DEBT]))
    note = F.trim(F.when(F.col("text").contains("#"), F.regexp_extract("text", r"#\s*(.*)", 1)).otherwise(F.col("text")))
    return rows.select(key, "line", F.upper(marker).alias("marker"), F.get(cats, F.col("i")).alias("category"), F.get(hours, F.col("i")).alias("hours"), F.left(note, F.lit(200)).alias("note"))


def generated(lines: DataFrame, key: str) -> DataFrame:
    what = F.array(*[F.lit(w) for _, w in GENERATED])
    return lines.withColumn("i", first_of(GENERATED, "text")).where("i is not null").select(key, "line", F.get(what, F.col("i")).alias("mark"))


def web(lines: DataFrame, key: str) -> DataFrame:
    """All smells of every line."""
    flags = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"))) for p, s in WEB])
    return lines.select(key, "line", F.explode(F.array_compact(flags)).alias("s")).select(key, "line", "s.pattern", "s.severity")


def web_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences of the lookaround-free smells in whole texts, by severity."""
    plain = [r"\bdocument\.write\b", r"\beval\s*\(", r"<script\s+src\s*=\s*[\"']http:"], [r"\binnerHTML\s*=", r"\bvar\s+"], [r"console\.(log|debug|info|warn|error)\s*\(", r"!important"]
    cols = [F.regexp_count(text, F.lit("|".join(p))).cast("long").alias(n) for p, n in zip(plain, ("high", "medium", "low"), strict=True)]
    return df.select(key, *cols).where("high + medium + low > 0")


def secrets(lines: DataFrame, key: str, least_bits: float = 4.0) -> DataFrame:
    """Key formats (the first a line holds), and values of suspicious names with high entropy."""
    known = lines.withColumn("i", first_of([(k,) for k in KEYS], "text")).where("i is not null").select(key, "line", F.lit("key").alias("kind"))
    value = F.regexp_extract("text", ASSIGNED, 2)
    named = lines.where(F.col("text").rlike(ASSIGNED)).where(entropy(value) > least_bits).select(key, "line", F.lit("value").alias("kind"))
    return known.unionByName(named)
