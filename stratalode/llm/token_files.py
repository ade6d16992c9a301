"""Token ids in Parquet: dictionary-coded list columns, small row groups with page indexes, in doc_id order.

Files hold `shard` (their place in doc_id order), `row` (place in the shard), doc_id, n_tokens and
ids. Readers that want some documents, or only the metadata, push the predicate and the column
list down to row groups and pages.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_small_batches, parts_for, scratch, table

SCHEMA = "shard int, row long, doc_id long, n_tokens long, ids array<int>"
#: Writer settings: 16 MB row groups, 64 KB pages, dictionaries for ids, delta coding (format 2) elsewhere.
FORMAT = {
    "compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10), "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0", "parquet.dictionary.page.size": str(1 << 20), "parquet.page.row.count.limit": "1000",
}
#: Encoded words that a worker remembers, and again as many that it knew before.
REMEMBERED = 600_000
#: Stands between new words that are encoded together.
MARK, WORDS_A_CALL = "\x01", 100
#: Rows whose words are told apart together.
ROWS = 1500
#: Bytes of input that a file stands for at most.
PART_BYTES = 64 << 20

_tokenizers: dict = {}


class Encoder:
    """Whole texts to ids. No token spans ASCII white space, so each word between is encoded once and remembered.

    Words are cut, told apart and put together again as arrays; only a batch's distinct words become Python strings. New
    words are encoded many at a time, with a mark between them that is a token by itself; a call for each costs several times as
    much. Where the file treats A-Z as a-z and parts letters from closing punctuation, as is tried on each sign, words are
    remembered in lower case and without it. ASCII words in lower case skip a normalizer that would not change them."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.of, self.known, self.before = Tokenizer.from_file(file), {}, {}
        self.plain = self.of
        with open(file, encoding="utf-8") as f:
            normal = (json.load(f).get("normalizer") or {}).get("normalizers") or []
        if all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} for x in normal):
            self.plain = Tokenizer.from_file(file)
            self.plain.normalizer = None
        ids = lambda *t: [e.ids for e in self.of.encode_batch_fast(list(t), add_special_tokens=False)]
        one, between, last = ids(MARK, f"a {MARK} b", f"a b {MARK} {MARK}")
        self.mark = one[0]
        self.many = WORDS_A_CALL if len(one) == 1 and between.count(self.mark) == 1 and last[-2:] == one * 2 else 1
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        upper, lower = ids(f"{letters} {' '.join(letters)}", f"{letters} {' '.join(letters)}".lower())
        self.lowers = upper == lower  # but for added tokens, which are looked for before
        self.added = [x.content.lower() for x in self.of.get_added_tokens_decoder().values()]
        self.stem_ends = letters.lower() if self.lowers else ""
        low = self.stem_ends
        self.closing = "".join(x for x in ".,;:!?" if low and ids(f"{low}{x}{x}") == [sum(ids(low, f"{x}{x}"), [])])

    def ids(self, words: list[str]):
        """(word, ids) of words, each by itself."""
        own, ascii_, wide = [], [], []
        for w in words:
            (own if MARK in w else ascii_ if w.isascii() and self.lowers and w.islower() else wide).append(w)
        for of, many, some in ((self.plain, self.many, ascii_), (self.of, self.many, wide), (self.of, 1, own)):
            groups = [some[i : i + many] for i in range(0, len(some), many)]
            for i in range(0, len(groups), 1000):
                part = groups[i : i + 1000]
                got = of.encode_batch_fast([f" {MARK} ".join(g) for g in part], add_special_tokens=False)
                for g, e in zip(part, got, strict=True):
                    ids = np.array(e.ids, "<u4")
                    cut = (4 * np.flatnonzero(ids == self.mark)).tolist() if many > 1 else []
                    flat = ids.tobytes()
                    yield from zip(g, [flat[a:b] for a, b in zip([0, *(x + 4 for x in cut)], [*cut, len(flat)], strict=True)], strict=True)

    def learn(self, words: list[str]) -> None:
        """Adds new words to `known`: from `before`, which has those known earlier, or encoded."""
        known, before = self.known, self.before
        known.update([(w, before[w]) for w in words if w in before])
        stems, new = {}, set()
        for w in words:
            if w not in before:
                stem = w.rstrip(self.closing)
                if len(stem) < len(w) and stem and stem[-1] in self.stem_ends:
                    stems[w] = stem
                    new.add(stem)
                    new.add(w[len(stem) :])
                else:
                    new.add(w)
        known.update(self.ids([w for w in new if w not in known]))
        known.update([(w, known[x] + known[w[len(x) :]]) for w, x in stems.items()])

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.ListArray:
        """Ids of each text, and the end id after them."""
        texts = texts.fill_null("")
        low = pc.ascii_lower(texts) if self.lowers else texts
        if self.lowers:  # texts with an added token, however written, are taken as they are
            for x in self.added:
                low = pc.if_else(pc.match_substring(low, x), texts, low)
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > REMEMBERED:
            self.known, self.before = {"": b""}, self.known
        self.known.setdefault("", b"")
        self.learn([w for w in words if w not in self.known])
        found = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = size[codes]
        at = lists.offsets.to_numpy().astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(n)))[at - at[0]]
        rows, more = len(texts), int(end is not None)
        out = np.full(upto[-1] + rows * more, end or 0, np.uint32)
        place = np.ones(len(out), bool)
        if more:
            place[upto[1:] + np.arange(rows)] = False
        out[place] = flat[np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(upto[-1])]
        offsets = upto + more * np.arange(rows + 1)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out.view(np.int32)))


def encoder(file: str) -> Encoder:
    if file not in _tokenizers:
        _tokenizers[file] = Encoder(file)
    return _tokenizers[file]


def _encode(file: str, end: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, row = encoder(file), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = enc.encode(b.column("text").cast(pa.string()), end)
                n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
                rows = pa.array(np.arange(row, row + b.num_rows, dtype=np.int64))
                row += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("shard"), rows, b.column("doc_id"), n, ids], ["shard", "row", "doc_id", "n_tokens", "ids"])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Writes the ids of every text, each followed by `end`, in ascending doc_id order: rows without one first, equal ones by the texts' hashes.

    Every row is written, repeated ones too. A null or empty text has the end id alone; long texts are whole. Other columns are
    ignored. No rows: an empty table.
    """
    docs = in_small_batches(docs)
    n, key = parts_for(docs, PART_BYTES, 1 << 20), F.xxhash64("text")
    docs = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id", key).sortWithinPartitions("doc_id", key)
    out = docs.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(_encode(tokenizer, end), SCHEMA)
    out.write.options(**FORMAT).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All rows and columns of the files; select and filter on doc_id reach the row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds start, the ids of all rows before. sizes: shard and n_tokens of all rows; its totals, one number a file, are summed on the driver."""
    totals = sorted(sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = list(accumulate((r.n for r in totals), initial=0))
    offsets = [(r.shard, b) for r, b in zip(totals, before, strict=False)] or [(0, 0)]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "shard int, before long"))
    order = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, "shard").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).drop("before")


def _crc(batches):
    for b in batches:
        ids = b.column("ids")
        at, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        cols = [*(b.column(c) for c in ("shard", "row", "doc_id")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])


def op5_token_files(spark, sf_dir):
    import public_tokenizers

    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    files = read_ids(spark, path)
    rows = files.select("shard", "row", "doc_id", "ids").mapInArrow(_crc, "shard int, row long, doc_id long, n_tokens long, ids_crc32 long")
    return with_start(rows, files.select("shard", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
