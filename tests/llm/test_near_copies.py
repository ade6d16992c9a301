"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random
import re

from stratalode.llm import simhash
from stratalode.llm.common import table

D = "/root/testdata/sf0.01"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """Of (doc_id, text): one row of each linked group."""
    sets, at, root = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, s in enumerate(sets):
        for j in {j for x in s for j in at.get(x, [])} if s else [j for j in range(i) if not sets[j]]:
            k = len(s & sets[j])
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            at.setdefault(x, []).append(i)
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_near_copies(spark):
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    edits = []
    for i in range(700):  # one large group of which some are linked only through others
        w = list(base if i < 5 or rnd.random() < 0.5 else edits[rnd.randrange(len(edits))][1].split())
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        edits.append((100000 + i, " ".join(w)))
    odd = [(200000, None), (200001, ""), (200002, " "), (200003, "one"), (200004, "ONE "), (200005, "a b c d e f"), (200006, "a b c d e f g")]
    docs = table(spark, D, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(edits + odd, "doc_id long, text string"))
    rows = sorted(tuple(r) for r in docs.collect())
    want = kept(rows)
    assert 0 < sum(i >= 100000 for i, _ in want) < 650
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, D).collect()) == sorted(i for i, _ in want)
    assert simhash.stage(spark, docs.limit(0), D).count() == 0


def test_simhash_brings_near_copies_together(spark, monkeypatch):
    from stratalode.llm import jaccard

    met = []

    def spied(classes, *rest):
        out = simhash.links(classes, *rest)
        met.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard, "links", spied, raising=False)
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(400))) for i in range(40)]
    rows += [(100 + i, t + f" end{i}") for i, t in rows[:20]]
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.grp, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted([[i, 100 + i] for i in range(20)] + [[i] for i in range(20, 40)])
    assert len(set(met)) >= 10  # most of the twenty pairs are within three bits

    equal = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 6), (5, 1 << 40)], "node long, fp long")
    assert {(r.a, r.b) for r in jaccard.drawn_together(equal).collect()} >= {(2, 1), (3, 1)}
