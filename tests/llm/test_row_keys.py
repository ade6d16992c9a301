"""Stages on rows without doc_id and with repeated ones: a bad row takes no clean row with it."""

import pytest

from stratalode.llm import decontaminate, language, simhash
from stratalode.llm.common import table

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["language", "decontaminate", "simhash"])
def test_only_the_bad_row_goes(spark, name):
    base = table(spark, D, "documents").where("lang = 'en' and n_chars > 300").orderBy("doc_id").limit(4).collect()
    item = table(spark, D, "benchmark").where("length(text) > 80").orderBy("item_id").first().text
    clean = [f"{w} {' '.join(r.text.split()[5:45])}" for w, r in zip("qua que qui quo".split(), base, strict=True)]
    bad = {"language": "12345 67890", "decontaminate": f"before {item} after", "simhash": clean[3]}[name]
    rows = [(None, clean[0]), (None, clean[1]), (None, bad), (7, clean[2]), (7, bad + " "), (1, clean[3])]
    s = table(spark, D, "documents").select("doc_id", "text", "lang", "source").schema
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], s)
    stage = {"language": language, "decontaminate": decontaminate, "simhash": simhash}[name].stage
    got = sorted((str(r.doc_id), r.text) for r in stage(spark, docs, D).collect())
    assert got == sorted((str(i), t) for i, t in rows if t in clean and (name != "simhash" or t != clean[3] or i == 1))
