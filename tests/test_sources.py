"""Ignore rules, listings, stores, settings, embedding and streaming."""

import json
import math
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querrick.operators import embedding, evaluation, fusion, snapshots
from querrick.sources import ignore, listing
from querrick.sources.config import Config
from querrick.sources.store import Store, deleted_counts, upserted
from querrick.streaming import changes


def test_ignore_rules():
    rules = ignore.IgnoreRules(["*.log", "!keep.log", "/top.txt", "build/", "docs/*.md", "# note", "", "a/**/z"])
    ignored = ["x.log", "d/x.log", "top.txt", "build/a.py", "s/build/a.py", "docs/a.md", "a/z", "a/b/c/z", ".git/config", "d/node_modules/m.js", "yarn.lock", "x.min.js", "d/x.map"]
    kept = ["keep.log", "d/top.txt", "build", "docs/x/a.md", "a.md", "src/a.py"]
    assert all(rules.ignores(p) for p in ignored) and not any(rules.ignores(p) for p in kept)
    assert [ignore.to_glob(p) for p in ("/foo", "/foo/", "foo/", "*.log", "foo", "a.txt", "x/**/y")] == ["foo", "foo/**", "**/foo/**", "**/*.log", "**/foo/**", "**/a.txt", "x/**/y"]
    assert "**/tmp/**" in ignore.globs(["tmp", "!kept", "#c"]) and not any("kept" in g for g in ignore.globs(["!kept"]))


def test_listing(spark, tmp_path):
    for name, data in {"a.py": b"x = 1", "b.bin": b"x", "c.txt": b"a\0b", ".hidden/d.py": b"y", "e": b"z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    all_files = listing.listed(spark, str(tmp_path))
    assert {r.file_path for r in all_files.collect()} == {"a.py", "c.txt", ".hidden/d.py", "e"}
    assert {r.file_path for r in listing.listed(spark, str(tmp_path), (".py",)).collect()} == {"a.py", ".hidden/d.py"}
    first = listing.snapshot(all_files, None, str(tmp_path))
    assert {r.file_path for r in first.collect()} == {"a.py", ".hidden/d.py", "e"}
    marked = first.withColumn("hash", F.concat(F.lit("old-"), "hash"))
    (tmp_path / "e").write_bytes(b"longer")
    second = {r.file_path: r.hash for r in listing.snapshot(listing.listed(spark, str(tmp_path)), marked, str(tmp_path)).collect()}
    assert second["a.py"].startswith("old-") and not second["e"].startswith("old-")


def test_binary_column(spark):
    rows = spark.createDataFrame([("a.PNG", b"x"), ("a.txt", b"x\0"), ("a.txt", b"x"), ("a", None)], "p string, c binary")
    assert [r[0] for r in rows.select(F.coalesce(listing.is_binary(F.col("p"), F.col("c")), F.lit(False))).collect()] == [True, True, False, False]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    refs = spark.createDataFrame([("r1", "a.py", "call"), ("r2", "b.py", "call")], "ref_id string, file_path string, ref_kind string")
    store.upsert({"refs": refs})
    store.upsert({"refs": refs.where("ref_id = 'r1'").withColumn("ref_kind", F.lit("import"))})
    assert {(r.ref_id, r.ref_kind) for r in store.read("refs").collect()} == {("r1", "import"), ("r2", "call")}
    store.append("refs", refs.limit(1).withColumn("ref_id", F.lit("r3")))
    assert store.counts()["refs"] == 3 and store.counts()["files"] == 0
    gone = spark.createDataFrame([("a.py",)], "file_path string")
    assert deleted_counts({"refs": store.read("refs")}, gone).first()["n"] == 2
    store.delete_files(gone)
    assert [r.ref_id for r in store.read("refs").collect()] == ["r2"]
    store.upsert({"embedding_cache": spark.createDataFrame([("h", [1.0])], "input_hash string, vector array<float>")})
    store.reset()
    assert store.counts()["refs"] == 0 and store.read("embedding_cache").count() == 1
    assert store.vacuum() == 0
    assert store.vacuum(keep_seconds=0) >= 3 and store.read("embedding_cache").count() == 1
    store.reset(drop_cache=True)
    assert store.read("embedding_cache").count() == 0
    assert json.loads(Path(tmp_path, "manifest.json").read_text())["schema_version"] == 6


def test_config():
    c = Config.from_json('{"provider": "openai", "dimensions": 3, "extensions": [".py"], "theme": 1}')
    assert c.dimensions == 1536 and c.extensions == (".py",) and c.extra == {"theme": 1}
    assert Config.from_json(c.to_json()) == c
    for bad in ("[]", "{", '{"provider": "none"}'):
        with pytest.raises(ValueError):
            Config.from_json(bad)


def test_embedding(spark):
    e = embedding.HashEmbedder(16)
    a, b = e.embed(["hello", "é\U0001f600"])
    assert math.isclose(sum(x * x for x in a), 1) and a != b and e.embed(["hello"])[0] == a
    seed = 5381
    for c in "hi":
        seed = (seed * 33 ^ ord(c)) & 0xFFFFFFFF
    assert e.seed("hi") == seed

    class Failing(embedding.HashEmbedder):
        batch = 1

        def embed(self, texts):
            if "bad" in texts:
                raise ValueError("context length")
            return super().embed(texts)

    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("1", "a"), ("3", "c")], "input_hash string, input string")
    cache = spark.createDataFrame([("3", [0.5], "t")], "input_hash string, vector array<float>, created_at string")
    assert [r.input_hash for r in embedding.refreshed(rows, cache, Failing(4)).collect()] == ["1"]
    files = spark.createDataFrame([("x",)], "file_path string")
    held = embedding.attach(spark.createDataFrame([("x", "3"), ("y", "3"), ("x", "9")], "file_path string, embed_hash string"), cache, "vec", files=files)
    assert [(r.file_path, r.embed_hash) for r in held.collect()] == [("x", "3")]


def test_retry():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise RuntimeError("HTTP 429")
        return "ok"

    assert embedding.with_retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    for message, times in (("maximum context length", 1), ("bad request", 1), ("quota exceeded", 10), ("400 API key expired", 10), ("API key expired", 1), ("rate: exceeds max tokens", 1)):
        calls = []

        def fail(message=message, calls=calls):
            calls.append(1)
            raise RuntimeError(message)

        with pytest.raises(RuntimeError):
            embedding.with_retry(fail, sleep=lambda s: None)
        assert len(calls) == times


@settings(max_examples=8, deadline=None)
@given(old=st.dictionaries(st.sampled_from(["a", "b/c", "b/d", "e/f/g"]), st.sampled_from("123")), new=st.dictionaries(st.sampled_from(["a", "b/c", "b/d", "e/f/g"]), st.sampled_from("123")))
def test_diff_applies(spark, old, new):
    frame = lambda d: spark.createDataFrame(list(d.items()), "file_path string, hash string")
    told = {r.file_path: r.change for r in snapshots.diff(frame(old), frame(new)).collect()}
    done = {p: h for p, h in old.items() if told.get(p) != "deleted"} | {p: new[p] for p, c in told.items() if c != "deleted"}
    assert done == new and {p for p, c in told.items() if c == "new"} == new.keys() - old.keys()


def test_snapshots(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "file_path string, hash string")
    assert {r.change for r in snapshots.diff(None, frame({"a": "1"})).collect()} == {"new"}
    assert {r.change for r in snapshots.diff(frame({"a": "1"}), None).collect()} == {"deleted"}
    assert {r.change for r in snapshots.forced(frame({"a": "1"})).collect()} == {"new"}
    one, two = (snapshots.folder_hashes(frame(d)) for d in ({"x/a": "1", "y/b": "2", "c": "3"}, {"x/a": "1", "y/b": "9", "c": "3"}))
    assert {r.folder for r in snapshots.unchanged_folders(one, two).collect()} == {"x"}
    assert {r.folder: r.files for r in one.collect()} == {"": 3, "x": 1, "y": 1}
    rows = spark.createDataFrame([("node_modules/a",), ("s/node_modules/b",), ("a.pyc",), ("src/a.py",)], "p string")
    assert [r[0] for r in rows.select(snapshots.excluded(F.col("p"), ("node_modules", "*.pyc"))).collect()] == [True, True, True, False]


def test_upsert_takes_one_of_equal_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 5), ("a", 4), ("c", 6)], "k string, v int")
    assert sorted(map(tuple, upserted(old, new, "k").collect())) == [("a", 4), ("b", 2), ("c", 6)]


def test_sampling_and_metrics(spark):
    assert evaluation.seeded_sample(range(5), 9, 1) == [0, 1, 2, 3, 4] and evaluation.seeded_sample(range(50), 5, 1337) == evaluation.seeded_sample(range(50), 5, 1337)
    assert len(set(evaluation.seeded_sample(range(50), 20, 3))) == 20 and evaluation.seeded_sample([], 3, 1) == [] and evaluation.seeded_sample([1], 0, 1) == []
    draw = evaluation.random_numbers(1337)
    numbers = [draw() for _ in range(2000)]
    assert all(0 <= x < 1 for x in numbers) and 0.45 < sum(numbers) / 2000 < 0.55
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), ("d", 4)], "query_id string, rank long")
    got = ranks.agg(evaluation.reciprocal_rank(F.col("rank")).alias("m"), evaluation.ratio(F.col("rank").between(1, 3)).alias("r")).first()
    assert (got.m, got.r) == (0.4375, 0.5)
    assert ranks.limit(0).agg(evaluation.nearest_rank("rank", 0.5)).first()[0] == 0
    hits = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "query_id string, pos int, id string")
    assert [(r.query_id, r.top_hits) for r in evaluation.failures(ranks, hits).collect()] == [("c", ["x", "y"])]
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, evaluation.first_by(rows, ["k"], ["v"]).collect())) == [(1, "a"), (2, "c")]


def test_fusion_does_not_depend_on_partitions(spark):
    rows = [("q", "symbols", f"s{i % 7}", f"symbols.{n}", "fts", i, 1.0) for i, n in enumerate(["name", "qualname", "identifiers"] * 9)]
    frame = spark.createDataFrame(rows, "query_id string, table string, id string, source string, channel string, rank int, raw_score double")
    one, two = (sorted(map(tuple, fusion.merge([f], "definition").select("id", "rrf", "ord").collect())) for f in (frame.coalesce(1), frame.repartition(5)))
    assert one == two
    hit = spark.createDataFrame([("q", True, 1), ("q", False, 2), ("p", False, 3)], "query_id string, is_exact boolean, n int")
    assert sorted(r.n for r in fusion.prefer_exact(hit).collect()) == [1, 3]
    assert fusion.next_actions({"definitions": [], "files": [], "usages": [], "blocks": []}) == []


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("a.py", "2024-01-01 00:00:00.000"), ("a.py", "2024-01-01 00:00:00.300"), ("a.py", "2024-01-01 00:00:02.000"), ("b.py", "2024-01-01 00:00:00.100"), ("c.py", None)], "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    bursts = changes.debounced(events)
    assert sorted((r.path, r.n) for r in bursts.collect()) == [("a.py", 1), ("a.py", 2), ("b.py", 1)]
    assert sorted((r.paths, r.events) for r in changes.batched(bursts).collect()) == [(1, 1), (2, 3)]
    kinds = spark.createDataFrame([("a.py", "add"), ("b.txt", "add"), ("c.txt", "unlink"), (".gitignore", "change")], "path string, kind string")
    assert {r.path for r in changes.filtered(kinds, (".py",), (".gitignore",)).collect()} == {"a.py", "c.txt", ".gitignore"}
    tree, seen = tmp_path / "tree", []
    tree.mkdir()
    (tree / "a.py").write_text("1")
    spark.dataSource.register(changes.PolledListing)
    watcher = changes.Watcher(lambda paths: seen.append(sorted(r.path for r in paths.collect())))

    def poll():
        stream = spark.readStream.format("polled_listing").option("path", str(tree)).load()
        query = watcher.start(stream, str(tmp_path / "state"), every_ms=200)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    poll()
    assert seen == [["a.py"]]
    (tree / "a.py").unlink()
    (tree / "b.py").write_text("2")
    watcher.pause()
    poll()
    assert len(seen) == 1 and watcher.stats["deferred"] == 2
    watcher.resume()
    (tree / "c.py").write_text("3")
    poll()
    assert seen[-1] == ["a.py", "b.py", "c.py"]


def test_readers_always_find_a_manifest(spark, tmp_path):
    """While a writer replaces the manifest again and again, every read finds a whole one."""
    import threading

    from querrick.sources.store import Manifest, Store

    store = Store(spark, str(tmp_path))
    store.save(Manifest(repo_id="0"))
    stop, seen = threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append(store.compatibility()["status"])

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(40):
        store.save(Manifest(repo_id=str(i)))
    stop.set()
    reader.join()
    assert set(seen) == {"compatible"} and store.manifest().repo_id == "39"


def test_a_reader_keeps_its_version(spark, tmp_path):
    from querrick.sources.store import Store

    store = Store(spark, str(tmp_path))
    refs = spark.createDataFrame([("r1", "a.py")], "ref_id string, file_path string")
    store.upsert({"refs": refs})
    old = store.read("refs")
    store.upsert({"refs": refs.withColumn("ref_id", F.lit("r2"))})
    assert store.vacuum() == 0 and [r.ref_id for r in old.collect()] == ["r1"]
