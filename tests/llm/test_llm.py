"""Corpus operators against brute force, on the small tables and on odd rows (see conftest)."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from stratalode.llm import decontaminate, fingerprints, importance, katz, pieces, private_data, repeats, simhash, token_files
from stratalode.llm.common import even_keys, repeat_rows, table

from .conftest import BLOCK, D, lower, order

SPACE, WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_even_keys_and_repeats(spark):
    from pyspark.sql import functions as F

    for n in (1, 3, 50):
        at = spark.createDataFrame([(int(k), i) for i, k in enumerate(even_keys(n))], "part int, i int").repartition(n, "part")
        assert all(r.i == r.p for r in at.select("i", F.spark_partition_id().alias("p")).collect())
    df = spark.createDataFrame([(i, i) for i in (1, 2, 7, 100, 101)], "a int, n long")
    assert {r.a: r["count"] for r in repeat_rows(df, "n").groupBy("a").count().collect()} == {i: i for i in (1, 2, 7, 100, 101)}


@pytest.mark.parametrize("blocks", [None, 1, 40])
def test_fingerprints(docs, texts, empty, blocks):
    rows = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, h64(r[1].encode()) >> 1))
    terms = [sorted({signed(h64(w.encode())) for w in WORD.findall(lower(t))}) for _, t in rows]
    seen = Counter(h for t in terms for h in t)
    n = len(rows)
    band = {h for h, c in seen.items() if max(2, n * 0.001) <= c <= max(2, n * 0.1)}

    def signs(hs):
        hs, out = [h for h in hs if h in band] or hs, []
        subsets = [hs]
        for j in range(fingerprints.CHAINS):
            left = hs
            for i in range(fingerprints.LEVELS):
                left = [h for h in left if not h >> (fingerprints.LEVELS * j + i) & 1]
                subsets.append(left)
        for s in subsets:
            x = 42
            for h in s:
                x = h64(struct.pack("<q", h), x)
            out.append(x % (1 << 32) if s else None)
        return out

    def near(a, b):
        used = [x == y for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(used) / len(used) if used else 1.0

    show = lambda s: "".join("-" * 8 if x is None else f"{x:08x}" for x in s)
    own, want = [signs(t) for t in terms], []
    for k, (i, t) in enumerate(rows):
        q, m = len(t) // 4, (k + 1) % n
        edited = t[: len(t) - q] + rows[m][1][:q]
        after = signs(sorted({signed(h64(w.encode())) for w in WORD.findall(lower(edited))}))
        want.append((i, len(t), sha(edited), show(own[k]), show(after), round(near(own[k], after), 12), round(near(own[k], own[m]), 12)))
    got = [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in fingerprints.fingerprint_edits(docs, blocks).collect()]
    assert order(got) == order(want)
    long = [r for r in want if r[1] > 1000]
    assert np.mean([r[5] > r[6] for r in long]) > 0.9
    assert fingerprints.fingerprint_edits(empty, blocks).count() == 0


def test_pieces(docs, texts, empty):
    sp = pytest.importorskip("sentencepiece")
    file = pieces.model_file()
    lib = sp.SentencePieceProcessor(model_file=file)
    got = pieces.decode(pieces.encode(docs, file), file).collect()
    assert order((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in got) == order((i, len(x := lib.encode(t or "")), tuple(x), t or "") for i, t in texts)
    assert pieces.encode(empty, file).count() == 0
    forgetful = pieces.encode(docs, file, remembered=3, forget=True).collect()
    assert order((r.doc_id, tuple(r.ids)) for r in forgetful) == order((r.doc_id, tuple(r.ids)) for r in got)


def unigram(sp, names_scores):
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(pieces.model_file(), "rb").read())
    m.trainer_spec.model_type = pieces.UNIGRAM
    if names_scores:
        keep = [p for p in m.pieces if p.type != 1]
        del m.pieces[:]
        m.pieces.extend(keep)
        for name, score in names_scores.items():
            m.pieces.add(piece=name, score=score, type=1)
    return pieces.Pieces(proto=m.SerializeToString()), sp.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_unigram_ids():
    """The Viterbi path, id by id, with scores that leave no ties."""
    sp = pytest.importorskip("sentencepiece")
    rnd = np.random.default_rng(4)
    names = {s for n in (1, 2, 3, 4) for s in map("".join, rnd.choice(list("abcd"), (60, n)).tolist())} | set("abcd▁") | {"▁" + s for s in map("".join, rnd.choice(list("abcd"), (30, 2)).tolist())}
    ours, lib = unigram(sp, {s: -float(len(s)) * (1 + rnd.random()) - 1 for s in sorted(names)})
    texts = [" ".join("".join(rnd.choice(list("abcd"), rnd.integers(1, 14))) for _ in range(8)) for _ in range(60)] + ["", "a", "xa b", "é"]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == lib.encode(t), t


def test_unigram_scores(texts):
    """On the model file with its kind changed in memory, where scores tie often: no path scores better."""
    sp = pytest.importorskip("sentencepiece")
    ours, lib = unigram(sp, None)
    for _, t in texts[:20]:
        ids = np.frombuffer(ours.encode([(t or "")[:2000]])[0], "<i4").tolist()
        score = lambda x: sum(ours.score[i] for i in x)
        assert score(ids) >= score(lib.encode((t or "")[:2000])) - 1e-3 * abs(score(ids))


@pytest.mark.parametrize("most", [decontaminate.MOST, 500])
def test_decontamination(spark, docs, texts, empty, most):
    more = [(7001, "w1 w2"), (7002, None), (7003, BLOCK), (7004, "one"), (7005, BLOCK)]
    items = table(spark, D, "benchmark").unionByName(spark.createDataFrame(more, "item_id long, text string"))
    windows = {}
    for r in items.collect():
        w = WORD.findall(lower(r.text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    assert most > 500 or len(windows) > 2 * most
    want = []
    for i, t in texts:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    got = decontaminate.decontaminate(docs, items, most=most).drop("item_ids")
    assert order(map(tuple, got.collect())) == order(want)
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs.where("doc_id < 5"), items.limit(0)).collect())


def test_katz(spark, docs, texts, empty):
    tokens = [(i, [*(t or "").encode().lower().split(), "END"], zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) for i, t in texts]
    one, two = Counter(), {}
    for _, w, held in tokens:
        if not held:
            one.update(w)
            for a, b in zip(["BOS", *w[:-1]], w, strict=True):
                two.setdefault(a, Counter())[b] += 1

    def discounted(counts):
        """Good-Turing d[r] for r of 1 to 5, 1 above."""
        n = Counter(counts)
        last = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last < 1 else 0 for r in range(1, 6)}
        return lambda r: r * (d[r] if 0 < d[r] < 1 else (r - 0.5) / r) if r <= 5 else r

    d1, d2, n = discounted(one.values()), discounted(x for m in two.values() for x in m.values()), sum(one.values())
    left = n - sum(map(d1, one.values()))
    p1 = {w: d1(c) / (n if left else n + 1) for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    total = {a: sum(m.values()) + (min(m.values()) > 5) for a, m in two.items()}
    alpha = {a: (1 - sum(d2(c) for c in m.values()) / total[a]) / (1 - sum(p1[w] for w in m)) for a, m in two.items()}
    for a in list(two)[:50]:
        seen = sum(d2(c) / total[a] for c in two[a].values())
        assert abs(seen + alpha[a] * (sum(p for w, p in p1.items() if w not in two[a]) + unknown) - 1) < 1e-9
    want = []
    for i, w, held in tokens:
        s = 0.0
        for a, b in zip(["BOS", *w[:-1]], w, strict=True):
            c = two.get(a, {}).get(b, 0)
            s += math.log10(d2(c) / total[a]) if c else math.log10(alpha.get(a, 1.0) * p1.get(b, unknown))
        base = sum(math.log10((one[x] + 1) / (n + 1 * (len(one) + 1))) for x in w)
        want.append((i, held, len(w), sum(one[x] > 0 for x in w), n, base, s))
    for parts in ("4", "1"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = order(map(tuple, katz.score(docs).collect()))
        assert [r[:5] for r in got] == [r[:5] for r in order(want)]
        for r, x in zip(sorted(got, key=lambda r: (repr(r[:5]), r[5])), sorted(want, key=lambda r: (repr(r[:5]), r[5])), strict=True):
            assert r[5:] == pytest.approx(x[5:], rel=1e-9), x[0]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert katz.score(empty).count() == 0


def test_token_files(spark, docs, texts, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    lib, start, want, path = Tokenizer.from_file(file), 0, [], str(tmp_path / "ids")
    token_files.write_ids(docs, path, file, 1)
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, signed(h64(r[1].encode())) if r[1] is not None else 42)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, tuple(ids)))
        start += len(ids)
    files = token_files.read_ids(spark, path)
    got = [(r.doc_id, r.start, tuple(r.ids)) for r in token_files.with_start(files, files).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    token_files.write_ids(empty, str(tmp_path / "none"), file, 1)
    none = token_files.read_ids(spark, str(tmp_path / "none"))
    assert token_files.with_start(none, none).count() == 0


def test_token_layout(spark, tmp_path):
    """Row groups and pages of the set sizes, page indexes, dictionary ids, delta-coded numbers, and readers that skip."""
    import glob

    import pyarrow.parquet as pq
    import public_tokenizers

    path = str(tmp_path / "ids")
    token_files.write_ids(table(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 4000"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    at = -1
    for f in sorted(glob.glob(f"{path}/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert meta.row_group(g).total_byte_size < 64 << 20
            assert all(c.has_offset_index and c.has_column_index for n, c in cols.items() if not n.startswith("ids"))
            assert all(c.has_offset_index for c in cols.values())
            ids = next(c for n, c in cols.items() if n.startswith("ids"))
            assert "RLE_DICTIONARY" in ids.encodings and ids.has_dictionary_page and ids.compression == "ZSTD"
            assert set(cols["row"].encodings) & {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"}
            s = cols["doc_id"].statistics
            assert at < s.min <= s.max
            at = s.max
    some = token_files.read_ids(spark, path).where("doc_id between 100 and 120").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,120)]" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert some.count() == 21


def test_repeats(docs, texts, empty):
    first, want = {}, []
    for i, t in texts:
        w = SPACE.findall(t or "")
        for k in range(len(w) - 49 if i is not None else 0):
            first[x] = min(first.get(x := tuple(w[k : k + 50]), i), i)
    for i, t in texts:
        w = SPACE.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        left = [x for x, k in zip(w, keep, strict=True) if k]
        want.append((i, len(w), len(w) - len(left), sha(" ".join(left))))
    got = repeats.remove_repeats(docs).drop("kept").collect()
    assert order(map(tuple, got)) == order(want)
    assert (900021, 61, 60, sha("twice")) in want and repeats.remove_repeats(empty).count() == 0


def test_importance(spark, docs, texts, empty):
    ids = [r.doc_id for r in table(spark, D, "labels").where("quality = 1").collect()]
    good = spark.createDataFrame([(i,) for i in [*ids, None, ids[0]]], "doc_id long")
    m = (1 << 64) - 1

    def grams(t):
        h = [h64(w, 0) for w in (t or "").encode().lower().split()]
        two = [((a * 0x9E3779B97F4A7C15 & m) ^ b) for a, b in zip(h, h[1:], strict=False)]
        return [x >> 50 for x in h + [((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & m) for x in two]]

    raw, target = Counter(range(importance.BUCKETS)), Counter(range(importance.BUCKETS))
    for i, t in texts:
        raw.update(grams(t))
        target.update(grams(t) if i in set(ids) else [])
    a, b = sum(target.values()), sum(raw.values())
    want = [(i, len(g := grams(t)), sum(math.log(target[x] / a) - math.log(raw[x] / b) for x in g)) for i, t in texts]
    got = importance.resample(docs, good, 0.5).cache()
    rows = [tuple(r) for r in got.select("doc_id", "n_grams", "log_weight").collect()]
    assert order(r[:2] for r in rows) == order(r[:2] for r in want)
    assert sorted(r[2] for r in rows) == pytest.approx(sorted(r[2] for r in want), abs=1e-6)
    noise = [r.sample_key - r.log_weight for r in got.collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and abs(np.std(noise) - 1.2825) < 0.35
    chosen = [r.sample_key for r in got.where("selected").collect()]
    assert len(chosen) == len(texts) // 2 and min(chosen) >= max(r.sample_key for r in got.where("not selected").collect())
    same = spark.createDataFrame([(7, "same text")] * 30 + [(None, None)], "doc_id long, text string")
    assert importance.resample(same, good, 0.5).where("selected").count() == 15  # ties: exactly as many as wanted
    assert importance.resample(same, good.limit(0), 1.0).where("selected").count() == 31
    assert importance.resample(empty, good).count() == 0 and importance.resample(docs, good, 0.0).where("selected").count() == 0


def test_simhash(docs, texts, empty):
    prints = []
    for _, t in texts:
        w = SPACE.findall(lower(t))
        h = [h64(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    known = sorted({p for p, (i, _) in zip(prints, texts, strict=True) if i is not None})
    root = {p: p for p in prints}

    def find(p):
        return p if root[p] == p else find(root[p])

    for x in known:
        for y in known:
            if x < y and (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    least = {}
    for p, (i, _) in zip(prints, texts, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert order(got) == order((i, p, least.get(find(p))) for p, (i, _) in zip(prints, texts, strict=True))
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_tiles(spark, monkeypatch):
    """One block key in many tiles."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rnd = np.random.default_rng(1)
    fps = sorted({int(0x1234 ^ sum(1 << int(b) for b in rnd.choice(40, rnd.integers(0, 6), replace=False))) for _ in range(150)})
    classes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(classes)).collect()}
    root = list(range(len(fps)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert [got.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def plain_spans(t):
    """The contract's four patterns as they are written, one by one."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


def test_private_data(spark, docs, texts, empty):
    big = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(big)
    want, spans = [], {}
    for i, t in [*texts, *map(tuple, big.collect())]:
        s = plain_spans(t or "")
        n = Counter(k for k, _, _ in s)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(text)))
        spans.setdefault((i, sha(text)), set()).update(text.split(",") if text else [])
    got = private_data.find(both).collect()
    assert order(tuple(r)[:6] for r in got) == order(want)
    assert all(spans[r.doc_id, r.base_sha256] <= set(r.spans.split(",")) for r in got)  # base spans stay
    r = next(r for r in got if r.doc_id == 900010)
    assert r.spans == "email:5:13,ip:17:25,card:31:50,phone:55:72"
    for t in ("a@b.c@d.e", "x@@y.z", "@a.b", "a@b", "a..b@c-d.e.f.", "é+a@b.c", "a@b.c.d@e.f g@h.i", "u@v.w@", "1.2.3.4.5.6.7.8", "4111-1111 1111-1111-", "+1 (2) 3-4.5 6 7 8 9"):
        assert private_data.base_spans(t) == plain_spans(t), t
    for t in ("9" * 6000 + ".1.1.1", "a" * 50000 + " b@c.d"):
        private_data.base_spans(t)
        private_data.proposals(t)
    assert private_data.redacted("a b@c.de f", [("email", 2, 8)]) == "a <EMAIL> f"
    assert private_data.find(empty).count() == 0 and private_data.redact(docs).columns == docs.columns


def test_private_data_accuracy():
    """Thresholds on candidates that neither the trees nor the calibration saw."""
    x, y, kinds = private_data.labelled(4000, 99)
    m = private_data.model()
    p, y, kinds = m.probability(m.trees.score(np.array(x))), np.array(y, bool), np.array(kinds)
    taken = np.array([q >= m.at[k] for q, k in zip(p, kinds, strict=True)])
    assert (taken == y).mean() > 0.9
    for k in set(kinds[taken].tolist()):
        assert y[taken & (kinds == k)].mean() > 0.93, k


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op6_substring_dedup"])
def test_oracle(spark, name):
    import duckdb

    from stratalode.llm import catalog

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, D).toPandas(), c.sql(catalog.ORACLES[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(repr, ours[cols].astype(object).values.tolist())) == sorted(map(repr, theirs[cols].astype(object).values.tolist()))
