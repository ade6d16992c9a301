"""The pipeline against plain versions of its stages, on rows with odd texts and ids."""

import re

import pytest
import xxhash

from stratalode.llm import pieces, private_data
from stratalode.llm.common import table

from .conftest import D, lower, order
from .test_language import plain
from .test_llm import WORD, plain_spans, signed
from .test_near_copies import kept


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    sp = pytest.importorskip("sentencepiece")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, D, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs.collect()
    said = plain([(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None], [(r.text, r.lang, r.source, None) for r in rows])
    left = [(r.doc_id, r.text) for r, x in zip(rows, said, strict=True) if x[0]]
    key = lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1], seed=42)))
    left = kept(sorted(left, key=key))
    windows = set()
    for r in table(spark, D, "benchmark").collect():
        w = WORD.findall(lower(r.text))
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = set(map(len, windows))

    def clean(t):
        w = WORD.findall(lower(t))
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    lib, want = sp.SentencePieceProcessor(model_file=pieces.model_file()), []
    for i, t in left:
        if clean(t):
            new = private_data.redacted(t, private_data.spans_of([t], private_data.model())[0][1])
            assert not plain_spans(new) and re.sub("<[A-Z]+>", "", new) in t or "<" in new
            want.append((i, tuple(lib.encode(new))))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert order((r.doc_id, tuple(r.ids)) for r in got.collect()) == order(want)
    assert len({i for i, _ in want}) > 50 and len(want) < len(rows)
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    table(spark, D, "benchmark").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
