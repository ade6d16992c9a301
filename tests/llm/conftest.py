"""Rows that every operator must take: whole small tables, odd texts, null and repeated ids, repeated rows, columns with clashing names."""

import re

import pytest
from pyspark.sql import functions as F

from stratalode.llm.common import table

D = "/root/testdata/sf0.001"
BLOCK = " ".join(f"w{i}" for i in range(60))
ODD = [
    (900001, None), (900002, ""), (900003, "one"), (900004, " \n\t "), (900005, BLOCK), (900006, "x " + BLOCK + " y"), (900007, BLOCK),
    (900008, "É ÉCOLE İ ſ K " * 20), (900009, "tok " * 30000), (900011, "<|endoftext|> a\x00b\x1cc d"),
    (900010, "mail a.b@c.de ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (555) 010-9999"),
    # no id, an id that is another row's too, and rows that are there twice
    (None, "a clean text without id"), (None, "z " + BLOCK), (None, None), (None, "a clean text without id"), (900020, "one text of two"),
    (900020, "u v " + BLOCK), (900021, BLOCK + " twice"), (900021, BLOCK + " twice"), (-5, "a text with an id below zero"),
]
CLASHES = ("words", "key", "fp", "n", "part", "row", "k1", "node", "held_out", "block", "rows")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def order(x):
    """Sorts values of which some are None."""
    return sorted(x, key=repr)


@pytest.fixture(scope="session")
def docs(spark):
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    both = table(spark, D, "documents").unionByName(more)
    return both.withColumns({c: F.lit("z") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text), those without id first."""
    return sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
