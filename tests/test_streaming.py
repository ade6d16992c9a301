"""Tree walks with their error rows, quiet times, incremental scans that may be replayed, and progress."""

import json
import os
import time

from pyspark.sql import functions as F

from stratalode.operators import matching
from stratalode.progress import watched
from stratalode.sources import tree
from stratalode.streaming import changes, debounce
from stratalode.streaming.incremental import FindingsTable, follow


def make(root, names):
    for name, text in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def listed(spark, root, walk):
    return sorted(r.rel for r in tree.listing(spark, str(root), walk).where("kind = 'file'").collect())


def test_walks(spark, tmp_path):
    make(tmp_path, dict.fromkeys(["a.py", "B.PY", "_p/x.py", ".hid/y.py", ".f.py", "venv2/z.py", "env/e.py", "node_modules/m.js", "s/t/u.js", "s/w.svelte", "s/n.txt", "target/o.rs", "dist/d.py"], "x = 1\n"))
    assert listed(spark, tmp_path, tree.SCAN) == sorted([".f.py", "B.PY", "_p/x.py", "a.py", "s/n.txt", "s/t/u.js", "s/w.svelte", "venv2/z.py"])
    assert listed(spark, tmp_path, tree.PYTHON) == sorted([".f.py", ".hid/y.py", "_p/x.py", "a.py", "venv2/z.py"])
    assert listed(spark, tmp_path, tree.WATCH) == sorted([".f.py", ".hid/y.py", "B.PY", "_p/x.py", "a.py", "env/e.py", "s/t/u.js", "s/w.svelte", "target/o.rs"])
    assert listed(spark, tmp_path, tree.by_extension(".js", ".py")) == sorted([".f.py", ".hid/y.py", "B.PY", "_p/x.py", "a.py", "s/t/u.js", "venv2/z.py"])


def test_nothing_vanishes(spark, tmp_path):
    make(tmp_path, {"ok.py": "x = 1\r\ny = 2\r", "big.py": "x" * 101, "edge.py": "x" * 100, ".git/c": "c", "in/ner.py": ""})
    os.symlink(tmp_path / "in", tmp_path / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.py")
    (tmp_path / "bytes.py").write_bytes(b"\xff\xfea\x00")
    t = tree.Tree(spark, str(tmp_path), largest=100)
    files, errors = {r.rel: r for r in t.files().collect()}, {r.rel: r.error for r in t.errors().collect()}
    assert set(files) == {"ok.py", "edge.py", "in/ner.py", "bytes.py"} and files["ok.py"].content == "x = 1\ny = 2\n" and "�" in files["bytes.py"].content
    assert errors["big.py"] == "larger than 100 bytes" and "skips" in errors[".git"] and "link" in errors["link"] and errors["broken.py"].startswith("FileNotFoundError")
    assert set(errors) == {"big.py", ".git", "link", "broken.py"}
    gone = tree.Tree(spark, str(tmp_path / "none"))
    assert gone.files().count() == 0 and gone.errors().first().error.startswith("FileNotFoundError")


def test_an_empty_tree(spark, tmp_path):
    t = tree.Tree(spark, str(tmp_path))
    assert t.files().collect() == [] and t.errors().collect() == []


def put(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{name}").rename(folder / name)


def wait(test, seconds=60):
    until = time.time() + seconds
    while not test() and time.time() < until:
        time.sleep(0.2)
    assert test()


def test_net_change():
    assert [debounce.net(*x) for x in (("created", "modified"), ("created", "deleted"), ("deleted", "created"), ("modified", "modified"), ("modified", "deleted"))] == ["created", "deleted", "modified", "modified", "deleted"]


def test_a_burst_is_one_change_after_a_quiet_time(spark, tmp_path):
    """Two files change in turns, faster than the quiet time; each comes out once, when it has been quiet."""
    src = tmp_path / "changes"
    src.mkdir()
    got = []
    stream = spark.readStream.schema("rel string, change string, at timestamp").json(str(src))
    with debounce.state_store(spark):
        q = debounce.debounced(stream, 5.0).writeStream.foreachBatch(lambda df, i: got.extend((r.rel, r.change, r.events, time.time()) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0.2 seconds").start()
    assert "RocksDB" not in spark.conf.get(debounce.PROVIDER)
    try:
        read = lambda: sum(p["numInputRows"] for p in q.recentProgress)
        put(src, "warm.json", [{"rel": "w", "change": "modified", "at": "2024-01-01 00:00:00"}])
        wait(lambda: got, 90)  # timers keep batches coming, so there is never a time when all is processed
        got.clear()
        put(src, "0.json", [{"rel": "a", "change": "created", "at": "2024-01-01 00:00:01"}, {"rel": "b", "change": "modified", "at": "2024-01-01 00:00:01"}])
        wait(lambda: read() >= 3)
        last = 0.0
        for i in range(1, 4):
            put(src, f"{i}.json", [{"rel": "a", "change": "modified", "at": f"2024-01-01 00:00:0{i + 1}"}])
            last = time.time()
            wait(lambda i=i: read() >= i + 3)
        assert not [g for g in got if g[0] == "a"]
        wait(lambda: len(got) == 2)
        put(src, "9.json", [{"rel": "b", "change": "deleted", "at": "2024-01-01 00:00:09"}])
        wait(lambda: len(got) == 3)
    finally:
        q.stop()
    assert sorted(g[:3] for g in got) == [("a", "created", 4), ("b", "deleted", 1), ("b", "modified", 1)]
    assert next(g[3] for g in got if g[0] == "a") - last >= 4.5


BAD, GOOD = "y = eval(data)\n", "y = 1\n"


def rules(table):
    return sorted((r.rel, r.rule_id) for r in table.current().where("rule_id = 'SEC-007'").collect())


def test_findings_follow_changes_and_replays(spark, tmp_path):
    """Create, modify, touch, delete; then a batch again, out of its turn, and everything in one batch."""
    root, table = tmp_path / "src", FindingsTable(spark, str(tmp_path / "table"))
    root.mkdir()
    read = lambda rels: tree.read(rels, str(root)).where("error is null")
    batch = lambda *rows: spark.createDataFrame(list(rows), "rel string, change string")
    assert rules(table) == []
    make(root, {"a.py": BAD, "b.py": BAD, "c.py": GOOD})
    table.apply(batch(("a.py", "created"), ("b.py", "created"), ("c.py", "created")), 0, read)
    assert rules(table) == [("a.py", "SEC-007"), ("b.py", "SEC-007")]
    make(root, {"a.py": GOOD, "c.py": BAD + BAD})
    table.apply(batch(("a.py", "modified"), ("c.py", "modified")), 1, read)
    want = [("b.py", "SEC-007"), ("c.py", "SEC-007"), ("c.py", "SEC-007")]
    assert rules(table) == want
    table.apply(batch(("a.py", "modified"), ("c.py", "modified")), 1, read)  # replayed
    assert rules(table) == want
    (root / "b.py").unlink()
    table.apply(batch(("b.py", "deleted")), 2, read)
    assert rules(table) == want[1:]
    table.apply(batch(("b.py", "deleted")), 2, read)
    assert rules(table) == want[1:] and [(r.batch, r.files, r.findings) for r in table.recent_scans().collect()] == [(1, 2, want.count(want[1]) + extra(table, 1)), (0, 3, 2 + extra(table, 0))]
    assert [r.rel for r in table.recent_changes(1).collect()] == ["b.py"]
    table.compact()
    assert rules(table) == want[1:] and table.touched().select("batch").distinct().count() == 1
    table.apply(batch(("c.py", "modified"), ("gone.py", "modified")), 3, read)
    assert rules(table) == want[1:]


def extra(table, batch):
    """Findings of other rules in a batch."""
    return table._read("findings", matching.FINDINGS).where(f"batch = {batch} and rule_id <> 'SEC-007'").count()


def test_ring_sizes(spark, tmp_path):
    table = FindingsTable(spark, str(tmp_path / "t"))
    none = lambda rels: spark.createDataFrame([], "rel string, lang string, content string")
    for i in range(12):
        table.apply(spark.createDataFrame([(f"{i}-{k}.py", "modified") for k in range(6)], "rel string, change string"), i, none)
    assert [r.batch for r in table.recent_scans().collect()] == list(range(11, 1, -1))
    recent = table.recent_changes().collect()
    assert len(recent) == 50 and {r.batch for r in recent} == set(range(3, 12))


def test_from_listings_to_findings(spark, tmp_path):
    """Polls of a tree, their changes by batch, and a stream that scans what changed. The first poll is the state and changes nothing."""
    root, polls, log = tmp_path / "src", tmp_path / "polls", tmp_path / "log"
    for p in (root, polls, log):
        p.mkdir()
    listings = spark.readStream.schema(changes.LISTING).option("maxFilesPerTrigger", 1).json(str(polls))
    q = changes.watch(listings, str(tmp_path / "snap"), changes.recorder(str(log)), str(tmp_path / "ck"), 0.1, announce_first=False).start()
    table = FindingsTable(spark, str(tmp_path / "table"))
    read = lambda rels: tree.read(rels, str(root)).where("error is null")

    def poll(i):
        got = tree.listing(spark, str(root), tree.WATCH).where("kind = 'file'").collect()
        put(polls, f"{i}.json", [{"poll_id": i, "rel": r.rel, "mtime": r.mtime, "digest": (root / r.rel).read_text(), "size": r.size} for r in got])
        q.processAllAvailable()

    try:
        make(root, {"old.py": BAD, "kept.py": GOOD})
        poll(0)
        make(root, {"new.py": BAD})
        (root / "old.py").unlink()
        os.utime(root / "kept.py", (time.time() + 5,) * 2)
        poll(1)
        seen = spark.readStream.schema("rel string, change string, at timestamp").json(str(log / "*"))
        w = follow(seen, table, read, str(tmp_path / "ck2"), seconds=0.1).start()
        try:
            w.processAllAvailable()
        finally:
            w.stop()
    finally:
        q.stop()
    assert rules(table) == [("new.py", "SEC-007")]
    assert {(r.rel, r.change) for r in table.touched().collect()} == {("new.py", "created"), ("old.py", "deleted")}


def test_progress_rises_to_the_end(spark):
    seen = []
    slow = spark.range(0, 24, 1, 24).select(F.pandas_udf(lambda s: s.map(lambda x: time.sleep(0.15) or x), "long")("id").alias("x"))
    total, last = watched(spark, lambda: slow.agg(F.sum("x")).first()[0], lambda p: seen.append(p.percent), 0.05, most=5)
    assert total == sum(range(24)) and seen == sorted(seen) and seen[-1] == 100 and len(seen) > 2
    assert last.status == "done" and len(last.ring) <= 5 and last.ring[-1][1] == 100
    try:
        watched(spark, lambda: spark.sql("select raise_error('no')").collect(), seen.append)
    except Exception as x:
        assert "no" in str(x) and seen[-1].status == "failed"
    else:
        raise AssertionError
