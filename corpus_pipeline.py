"""Corpus pipeline: each stage is one of the corpus operators, applied to what the stage before kept."""

from __future__ import annotations

from stratalode.llm import decontaminate, language, pieces, private_data, simhash
from stratalode.llm.common import stored, table

STAGES = [
    ("language_id", language.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("private_data", private_data.stage),
    ("sentencepiece", pieces.stage),
]

#: No stage here can be told in SQL as a whole; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents in order. Each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
