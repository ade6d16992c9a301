"""SentencePiece encoding and decoding over a shared-prefix lattice.

A text is cut into marked words: a run of the space mark and what follows it up to the next run.
No piece crosses such a cut. The distinct words of a batch are sorted, so that neighbours share
prefixes, and walked as a depth-first traversal of their trie: the forward states of the common
prefix stay on the stack and only the rest is computed.

Unigram model files: the forward state is the best sum of piece scores (Viterbi). BPE model files:
the largest sum of scores gives other ids than the file's own merges, so the state of a prefix is
the last piece of its merged form; a piece can follow another if merging the two leaves both
whole, and exactly one piece of those ending at a position can follow the state where it begins.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, table

MARK = "▁"
#: Words, and pairs of pieces, that a worker remembers.
REMEMBERED = 900_000
#: The same in the pipeline, whose workers serve all stages.
STAGE_REMEMBERED = 150_000
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
BPE, UNIGRAM = 2, 1

_models: dict = {}


class Pieces:
    """The vocabulary of a model file, with encoding and decoding."""

    def __init__(self, file: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto if proto is not None else open(file, "rb").read())
        self.kind = m.trainer_spec.model_type
        if self.kind not in (BPE, UNIGRAM) or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE and unigram models with identity normalisation are supported")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.score = [p.score for p in m.pieces]
        self.text = [p.piece for p in m.pieces]
        byte = {int(BYTE.fullmatch(p.piece)[1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.bytes = [byte[i] for i in range(256)] if len(byte) == 256 else None
        self.raw = [p.piece.encode() if p.type in (1, 4) else b"" for p in m.pieces]
        self.raw[self.unk] = " ⁇ ".encode()
        for b, i in byte.items():
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece holds a space mark after another character, or a line end")
        self.low = min(self.score[i] for i in self.ids.values()) - 10
        self.known: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short string: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            ok = self.fits[key] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return ok

    def stands(self, k: int) -> bool:
        """Whether a piece is what its own text merges to."""
        key = -1 - k
        if key not in self.fits:
            self.fits[key] = self.merged(self.text[k]) == [self.text[k]]
        return self.fits[key]

    def walk(self, words: list[str]) -> None:
        """Encodes sorted distinct words into `known`. last[j], from[j]: the piece that ends prefix j, and where it begins; -1 for a character that no piece has."""
        last, start, best = [-1], [0], [0.0]
        ids, longest, before, bpe, score = self.ids, self.longest, "", self.kind == BPE, self.score
        for w in words:
            n = min(len(w), len(before))
            same = next((i for i in range(n) if w[i] != before[i]), n)
            del last[same + 1 :], start[same + 1 :], best[same + 1 :]
            for j in range(same + 1, len(w) + 1):
                piece, at, top = -1, j - 1, None
                if bpe:
                    for i in range(max(0, j - longest), j):  # the longest first
                        k = ids.get(w[i:j])
                        if k is not None and (self.follows(last[i], k) if last[i] >= 0 else self.stands(k)):
                            piece, at = k, i
                            break
                else:
                    top = best[j - 1] + self.low
                    for i in range(max(0, j - longest), j):
                        k = ids.get(w[i:j])
                        if k is not None and best[i] + score[k] > top:
                            piece, at, top = k, i, best[i] + score[k]
                    best.append(top)
                last.append(piece)
                start.append(at)
            out, j = [], len(w)
            while j:
                if last[j] >= 0:
                    out.append(last[j])
                elif self.bytes:
                    out += [self.bytes[b] for b in reversed(w[j - 1].encode())]
                else:
                    out.append(self.unk)
                j = start[j]
            self.known[w] = np.array(out[::-1], "<i4").tobytes()
            before = w

    def encode(self, texts: list[str], remembered: int = REMEMBERED) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Words of earlier calls are forgotten when there are more than `remembered`."""
        cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        words = [cut((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > remembered:
            self.known.clear()
        self.walk(sorted(set().union(*words).difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Space marks become spaces, so a text that held the mark itself comes back with a space there."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def pieces(file: str) -> Pieces:
    if file not in _models:
        _models[file] = Pieces(file)
    return _models[file]


def _encode(file: str, remembered: int, forget: bool):
    def run(batches):
        model = pieces(file)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                got = model.encode([t or "" for t in b.column("text").to_pylist()], remembered)
                n = np.array([len(x) // 4 for x in got], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), ids], ["doc_id", "n_tokens", "ids"])
        if forget:
            model.known.clear()
            model.fits.clear()

    return run


def _decode(file: str):
    def run(batches):
        model = pieces(file)
        for b in batches:
            ids = b.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().tolist()
            texts = [model.decode(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
            keep = [c for c in b.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids, pa.array(texts, pa.string())], [*keep, "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str, remembered: int = REMEMBERED, forget: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids for every row.

    A null text counts as empty, an empty one has no ids. doc_ids may be null or repeated, and equal texts have equal ids. Of
    pieces that lead to equal scores (ties, unigram files only) the longest is taken. Long texts are encoded whole. No rows: no rows.
    Other columns are ignored. remembered: words that a worker keeps from batch to batch; forget: whether it drops them when a task
    ends, for jobs whose later steps need the worker's memory. Neither changes the ids.
    """
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(model, remembered, forget), "doc_id long, n_tokens long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Adds decoded, the text of ids, to rows of doc_id, n_tokens, ids."""
    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(model), "doc_id long, n_tokens long, ids array<int>, decoded string")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir):
    """Ids of every document, with the digest of the text decoded from them."""
    rows = decode(encode(table(spark, sf_dir, "documents"), model_file()), model_file())
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark, docs, sf_dir):
    """The ids of every document that is left, one row for each row; null and empty texts have none."""
    return encode(docs, model_file(), remembered=STAGE_REMEMBERED, forget=True)
