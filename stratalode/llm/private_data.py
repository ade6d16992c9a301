"""Personal data: fixed patterns, plus candidates that boosted trees accept or refuse.

Generators of high recall propose spans that may overlap: written-out addresses, numbers without a
country code, digit runs with other separators, identity numbers, keys. Features describe a span's
format (lengths, digit share, separators, checksum, variety) and its context (cue words before it,
its neighbours). Trees are boosted on a synthetic labelled set made from a fixed seed; on a held-out
part of it, scores are calibrated and each kind gets the lowest threshold that reaches the wanted
precision. Accepted candidates are taken by score where they overlap; spans of the fixed patterns
always stay.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, table

KINDS = ("email", "ip", "card", "phone", "identity", "secret")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: BASE["ip"] without useless attempts: it can only begin where a run of digits does, and giving digits back never helps.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
GENERATORS = {
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_-][0-9]{4}){2,3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+"),
}
#: Of addresses that are spelled out: where one may begin, the signs of its two parts, and what stands for the two separators.
BEGIN, LOCALS, HOSTS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+"), re.compile(r"[A-Za-z0-9._%+-]++"), re.compile(r"[A-Za-z0-9-]++")
AT, AT_WITHIN = re.compile(r"(?i:[ ]?(?:\[at\]|\(at\))|[ ]at\b)[ ]?"), re.compile(r"(?i)\bat\b")
DOT, DOT_WITHIN = re.compile(r"(?i:[ ]?(?:\[dot\]|\(dot\)|\bdot\b))[ ]?(?=[A-Za-z0-9-])"), re.compile(r"(?i)\bdot\b")
#: Runs of digit groups with single separators; the national numbers of a run begin at its start, a bracket or a leading 0.
GROUPS = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]++\)?(?:(?: ?[/.-] ?| )\(?[0-9]++\)?)*+")
GROUP = re.compile(r"\(?([0-9]+)\)?")
#: Cheap tests that a text must pass for a pattern to be able to match in it.
NEEDS = {"email": re.compile(r"(?i)\bat\b|\[at\]|\(at\)"), "digit": re.compile("[0-9]"), "secret": re.compile(r"[A-Za-z0-9_/+-]{20}")}
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|reach"), "card": re.compile(r"(?i)card|visa|credit|payment|karte"), "phone": re.compile(r"(?i)tel|phone|call|fax|mobil"),
    "identity": re.compile(r"(?i)ssn|social|iban|passport|account|id\b"), "secret": re.compile(r"(?i)key|token|secret|passw|bearer|auth"),
}
AROUND = 24


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str):
    """What BASE["email"] finds, in linear time: from each @ back over its run of local characters, then on over the host."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        first = at
        while first > end and text[first - 1] in LOCAL:
            first -= 1
        if host and first < at:
            yield ("email", first, host.end())
            end = host.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start. A match that fails its test is dropped, not retried."""
    out = list(emails(text))
    if NEEDS["digit"].search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in BASE["card"].finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in BASE["phone"].finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def spelled(text: str):
    """Spans of addresses with their separators in words, in linear time: `name at host dot org`, `name[at]host[dot]org`, `name-at-host-dot-org`.

    Of a run of local signs the last `at` counts after which a host with a separator follows. Runs of host signs and the `dot`s
    within them are found once; for a run, whether separators follow it and how far they lead is kept.
    """
    ends, dots, leads = [], [], {}
    for m in HOSTS.finditer(text):
        ends.append(m.span())
    dots = [m.start() for m in DOT_WITHIN.finditer(text)]
    firsts = [x for x, _ in ends]

    def beyond(e: int) -> int:
        """Where the separators and hosts that follow a host's end at e end; e itself if none do."""
        way = []
        while e not in leads:
            way.append(e)
            m = DOT.match(text, e)
            if not m:
                leads[e] = e
            else:
                e = ends[bisect.bisect_right(firsts, m.end()) - 1][1]
        for x in way:
            leads[x] = leads[e]
        return leads[e]

    def host(p: int) -> int:
        """Where the host with a separator that begins at p ends, or -1."""
        k = bisect.bisect_right(firsts, p) - 1
        if k < 0 or p >= ends[k][1]:
            return -1
        e = ends[k][1]
        if (out := beyond(e)) > e:
            return out
        i = bisect.bisect_left(dots, e) - 1
        while i >= 0 and dots[i] > p:
            after = dots[i] + 3
            if after < e:
                return e
            if text[after : after + 1] == " " and (m := HOSTS.match(text, after + 1)):
                return beyond(m.end())
            i -= 1
        return -1

    at = 0
    while run := BEGIN.search(text, at):
        first, last = run.span()
        found = host(m.end()) if (m := AT.match(text, last)) else -1
        if found < 0:
            for p in reversed([m.start() for m in AT_WITHIN.finditer(text, first + 1, last)]):
                if p > first and not (text[p - 1].isalnum() or text[p - 1] == "_") and (p + 2 < last or not text[last : last + 1].isalnum()):
                    found = host(p + 3 if p + 2 == last and text[last : last + 1] == " " else p + 2)
                    if found >= 0:
                        break
        if found >= 0:
            yield first, found
        at = max(found, last)


def national(text: str):
    """Spans of 7 to 15 digits in whole groups that a phone number without country code may have, in linear time."""
    for run in GROUPS.finditer(text):
        groups = [(m.start(), m.end(), len(m[1]), m[0][0] in "(0") for m in GROUP.finditer(text, *run.span())]
        for i, (a, _, _, starts) in enumerate(groups):
            n = 0
            for _, b, digits, _ in groups[i:] if starts or i == 0 else ():
                n += digits
                if n > 15:
                    break
                if n >= 7 and (b - a > n or starts):
                    yield a, b


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidates of all generators; they may overlap."""
    kinds = [k for k, ok in (("email", NEEDS["email"]), ("secret", NEEDS["secret"])) if ok.search(text)]
    if NEEDS["digit"].search(text):
        kinds += ["card", "phone", "identity"]
    out = [("email", a, b) for a, b in spelled(text)] if "email" in kinds else []
    out += [(k, *m.span()) for k in kinds if k in GENERATORS for m in GENERATORS[k].finditer(text)]
    if "phone" in kinds:
        have = set(out)
        out += [c for a, b in national(text) if (c := ("phone", a, b)) not in have]
    return out


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]
    n, d = len(s), digits_of(s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    return [
        float(KINDS.index(kind)), n, len(d), len(d) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, len(re.findall("[^A-Za-z0-9]", s)),
        entropy, float(len(d) > 1 and luhn(d)), len(re.findall(r"[0-9][A-Za-z]|[A-Za-z][0-9]", s)), float("(" in s or "[" in s), float(s[0] in "0("),
        float(bool(CUES[kind].search(before))), float(bool(re.search(r"[=:\"']\s*$", before))), float(bool(re.match(r"[\"']", after))),
        float(bool(re.search(r"[A-Za-z0-9]$", before))), len(digits_of(before)), len(digits_of(after)), float(len(set(d)) <= 2), float(bool(re.search(r"(?i)\b(of|the|we|it|look|is|was|are)\b", s))),
    ]


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, with splits at quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = y.mean()
        self.bias = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._values(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for f, at in enumerate(cuts):
                for c in at:
                    left = x[rows, f] <= c
                    if self.least <= left.sum() <= len(rows) - self.least:
                        gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                        gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                        if gain > best[0]:
                            best = (gain, f, c)
        if best[1] is None:
            return self.rate * gs / (hs + 1)
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, cuts, rows[left], depth - 1), self._grow(x, g, h, cuts, rows[~left], depth - 1))

    def _values(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, c, a, b = tree
        return np.where(x[:, f] <= c, self._values(a, x), self._values(b, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._values(t, x) for t in self.trees)


class ByKind:
    """Trees for each kind (the first feature) alone, so look-alikes of one kind don't refuse candidates of another."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByKind:
        self.of = {k: Boosted().fit(x[x[:, 0] == k], y[x[:, 0] == k]) for k in np.unique(x[:, 0])}
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -50.0)
        for k, trees in self.of.items():
            if (own := x[:, 0] == k).any():
                out[own] = trees.score(x[own])
        return out


def labelled(n: int, seed: int) -> tuple[list[list[float]], list[int], list[str]]:
    """Synthetic candidates in filler text: true ones, and look-alikes from prose, code and tables. n bounds them."""
    r = random.Random(seed)
    word = lambda k=0: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(k or r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    x, y, kinds = [], [], []

    def card(good: bool) -> str:
        d = num(15)
        d = next(d + c for c in "0123456789" if luhn(d + c) == good)
        return r.choice("./_").join(d[i : i + 4] for i in range(0, 16, 4))

    def add(kind: str, s: str, good: bool, cue: str = "") -> None:
        text = f"{' '.join(word() for _ in range(r.randint(0, 5)))} {cue}{s}{r.choice(['', '.', ',', ' ' + word(), '!'])} {word()} {word()}"
        for k, a, b in proposals(text):
            if k == kind:
                inside = text.find(s) <= a + 1 and b <= text.find(s) + len(s) + 1 and (kind != "phone" or b - a >= len(s) - 1)
                x.append(features(text, k, a, b))
                y.append(int(good and inside))
                kinds.append(k)

    while len(x) < n:
        o, c = r.choice([("(", ")"), ("[", "]")]), None
        at, dot = r.choice([f"{o[0]}at{o[1]}", " (at) ", " at ", " [at] "]), r.choice([f"{o[0]}dot{o[1]}", " (dot) ", " dot ", " [dot] "])
        add("email", f"{word()}{r.choice(['.', '_', '', num(2)])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu'])}", True, r.choice(["mail: ", "contact ", "", ""]))
        add("email", f"{r.choice(['look', 'is', 'we are', 'it was'])} at {r.choice(['the', word()])} dot {r.choice(['of', 'product', word(7)])}", False)
        good = r.random() < 0.5
        add("card", card(good), good, r.choice(["card ", "visa: ", ""]) if good else r.choice(["id ", "", "part "]))
        sep = r.choice(" .-")
        tel = f"{r.choice('23456789')}{num(2)}{sep}{r.choice('23456789')}{num(2)}{sep}{num(4)}"
        add("phone", r.choice([tel, f"({tel[:3]}) {tel[4:]}"]), True, r.choice(["tel ", "phone: ", "call ", ""]))
        add("phone", f"{num(3)} {num(3)} {num(4)}", False, f"{num(4)} {num(4)} ")
        tel = r.choice([
            f"0{num(r.randint(2, 4))}{r.choice([' ', '/', '-', ' / '])}{num(r.randint(5, 8))}", f"(0{num(r.randint(2, 4))}) {num(r.randint(3, 4))} {num(r.randint(2, 4))}", f"01{num(8)}",
            r.choice(" .").join([f"0{r.choice('123456789')}", *(num(2) for _ in range(4))]), f"{r.choice('6789')}{num(2)} {num(3)} {num(3)}", f"{r.choice('6789')}{num(2)} {num(2)} {num(2)} {num(2)}",
        ])
        add("phone", tel, True, r.choice(["tel ", "Tel.: ", "Telefon ", "phone: ", "mobil ", ""]))
        add("phone", r.choice([f"{r.choice(['19', '20'])}{num(2)}-{r.choice(['0', '1'])}{num(1)}-{num(2)}", f"{num(2)}.{num(2)}.{r.choice(['19', '20'])}{num(2)}", f"{num(1)} {num(3)} {num(3)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(4)}-{num(4)}", " ".join(num(r.randint(1, 3)) for _ in range(7))]), False, r.choice(["", "", "on ", "no "]))
        add("identity", f"{r.choice('12345678')}{num(2)}-{num(2)}-{num(4)}", True, r.choice(["ssn ", "id: ", "social ", ""]))
        add("identity", f"{r.choice(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}", False, r.choice(["part ", "no ", ""]))
        add("identity", f"{r.choice(['DE', 'FR', 'ES'])}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", True, r.choice(["iban ", "account ", ""]))
        k = r.randint(24, 48) if r.random() < 0.7 else r.randint(49, 600)
        key = "".join(r.choice(r.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])) for _ in range(k))
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(k))
        add("secret", r.choice([key, hexa]), True, r.choice(['token = "', "key: ", 'secret = "', "auth ", ""]))
        add("secret", word(r.randint(20, 34)), False)
        add("secret", "-".join(word() for _ in range(5)), False)
        add("secret", "/".join(word() for _ in range(5)), False)
        add("secret", r.choice("=-_+") * r.randint(20, 60), False)
        add("secret", num(r.randint(20, 26)), False)
    return x[:n], y[:n], kinds[:n]


class Model:
    """Trees with a probability map and a threshold for each kind, all from `rows` synthetic rows (a bound, not a sample of the corpus)."""

    def __init__(self, rows: int = 6000, precision: float = 0.98, seed: int = 11):
        x, y, _ = labelled(rows, seed)
        self.trees = ByKind().fit(np.array(x), np.array(y, float))
        x, y, kinds = labelled(rows // 2, seed + 1)
        raw, y, kinds = self.trees.score(np.array(x)), np.array(y), np.array(kinds)
        self.a, self.b = self._platt(raw, y)
        p = self.probability(raw)
        self.at = {}
        for k in KINDS:
            own = np.argsort(-p[kinds == k])
            if len(own):
                right = np.cumsum(y[kinds == k][own]) / np.arange(1, len(own) + 1)
                ok = np.flatnonzero(right >= precision)
                self.at[k] = float(max(0.5, p[kinds == k][own][ok[-1]])) if len(ok) else 2.0

    @staticmethod
    def _platt(raw, y):
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            a, b = a - 0.01 * ((p - y) * raw).mean(), b - 0.1 * (p - y).mean()
        return a, b

    def probability(self, raw):
        return 1 / (1 + np.exp(-(self.a * raw + self.b)))


_fitted: list[Model] = []


def model() -> Model:
    if not _fitted:
        _fitted.append(Model())
    return _fitted[0]


def spans_of(texts: list[str], fitted: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; all candidates of the batch are scored at once."""
    base = [base_spans(t) for t in texts]
    found = [(i, *c) for i, t in enumerate(texts) for c in proposals(t)]
    added: list[list] = [[] for _ in texts]
    taken: dict[int, bytearray] = {}
    if found:
        p = fitted.probability(fitted.trees.score(np.array([features(texts[i], k, a, b) for i, k, a, b in found])))
        for q, (i, k, a, b) in sorted(zip(p.tolist(), found, strict=True), key=lambda x: (-x[0], x[1])):
            if i not in taken:
                taken[i] = bytearray(len(texts[i]))
                for _, c, d in base[i]:
                    taken[i][c:d] = b"\1" * (d - c)
            if q >= fitted.at.get(k, 2.0) and taken[i].find(1, a, b) < 0:
                added[i].append((k, a, b))
                taken[i][a:b] = b"\1" * (b - a)
    order = lambda s: (KINDS.index(s[0]), s[1])
    return [(b, sorted(b + a, key=order)) for b, a in zip(base, added, strict=True)]


def as_text(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list) -> str:
    """text with each covered stretch replaced by the kind of its first span."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in list(BASE)) + ", base_sha256 string, spans string"


def _find(fitted: Model):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                got = spans_of([t or "" for t in b.column("text").to_pylist()], fitted)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in BASE]
                digests = [hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in got]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([as_text(s) for _, s in got], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def _redact(fitted: Model):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column("text").to_pylist()
                got = spans_of([t or "" for t in texts], fitted)
                new = [None if t is None else redacted(t, s) for t, (_, s) in zip(texts, got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else b.column(c) for c in b.schema.names], b.schema.names)

    return run


def find(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """For every row: counts of base spans by kind, the digest of base spans, and all spans (kind:start:end in code points).

    One row for each row. A null text counts as empty and has no spans. doc_ids may be null or repeated, and repeated rows give
    repeated results. Of overlapping candidates with equal scores (ties) the first by kind and place is taken. Long texts are
    searched whole, in linear time. No rows: no rows. Other columns are ignored.
    """
    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_find(fitted or model()), SCHEMA)


def redact(docs: DataFrame, fitted: Model | None = None) -> DataFrame:
    """docs with every found span in text replaced by its kind; other columns, and null texts, stay as they are."""
    return in_small_batches(docs).mapInArrow(_redact(fitted or model()), docs.schema)


def op10_private_data(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Redacts every document and sets n_chars to the new length. Every row stays, whatever its doc_id; null texts stay null, with their n_chars."""
    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out
