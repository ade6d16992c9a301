"""Operators that size their parts by bytes, on tables that are neither files nor cached: rows in memory, and a join that the planner takes for huge."""

import pytest
from pyspark.sql import functions as F

from stratalode.llm import common, fingerprints, katz, repeats, token_files

D = "/root/testdata/sf0.001"


def files_of(docs):
    import public_tokenizers

    path = common.scratch(docs.sparkSession, "ids")
    token_files.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_files.read_ids(docs.sparkSession, path).select("doc_id", "ids")


RUN = {"fingerprints": fingerprints.fingerprint_edits, "katz": katz.score, "token_files": files_of, "repeats": repeats.remove_repeats}


@pytest.fixture(scope="module")
def inputs(spark):
    docs = common.table(spark, D, "documents").where("doc_id < 12").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    memory = spark.createDataFrame(rows, "doc_id long, text string")
    orders = common.table(spark, D, "lineitem").select(F.col("l_orderkey").alias("doc_id")).union(docs.select("doc_id")).distinct()
    joined = docs.join(orders, "doc_id").select("doc_id", "text")
    return {"files": docs, "memory": memory, "joined": joined}


@pytest.mark.parametrize("kind", ["memory", "joined"])
def test_parts_by_measured_bytes(inputs, kind):
    assert common.plan_bytes(inputs[kind]) > 1 << 25 or kind == "joined"
    assert common.parts_for(inputs[kind], 32 << 20, 200) <= 8


@pytest.mark.parametrize("name", RUN)
@pytest.mark.parametrize("kind", ["memory", "joined"])
def test_same_rows_as_from_files(inputs, name, kind):
    got, want = RUN[name](inputs[kind]), RUN[name](inputs["files"])
    key = lambda df: sorted(repr(tuple(r[c] for c in sorted(want.columns))) for r in df.collect())
    assert key(got) == key(want) and got.count() == 12
