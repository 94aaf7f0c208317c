"""The service's methods, sanitising, and pieces of a file by itself."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from querrick.extract.rows import chunk_file
from querrick.functions import sanitise as s
from querrick.functions import text
from querrick.operators.embedding import HashEmbedder, mean_pooled
from querrick.plans.engine import Engine
from querrick.plans.indexing import Cancelled, Indexer
from querrick.plans.service import Service, scope_of
from querrick.sources.store import Store
from querrick.streaming.changes import Watcher


def test_service(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def first_thing():\n    return second_thing()\n")
    store, watcher = Store(spark, str(tmp_path / "store")), Watcher(lambda paths: None)
    service = Service(Engine(store, HashEmbedder(), str(tree)), Indexer(store, str(tree), HashEmbedder()), watcher)
    assert service.call("ping") == {"result": "pong"} and service.call("nothing")["error"]["code"] == -32601
    assert service.call("status")["result"]["status"] == "not_indexed" and "not_indexed" in service.call("search", {"query": "x"})["error"]["message"]
    assert service.call("index")["result"]["stats"]["files_new"] == 1 and service.call("health")["result"] == {"healthy": True, "status": "compatible"}
    found = service.call("search", {"query": "first_thing", "intent": "definition", "scope": {"extension": [".py"]}})["result"]
    assert found["groups"]["definitions"][0]["title"] == "first_thing"
    for params in ({"query": ""}, {"query": "x", "k": 0}, {"query": "x", "scope": {"no": []}}, {"wrong": 1}):
        assert service.call("search", params)["error"]["code"] == -32602
    assert service.call("findUsages", {"symbol_name": "second_thing"})["result"]["total"] == 1
    assert service.call("readFileLines", {"path": "a.py", "start": 1, "end": 1})["result"]["lines"] == ["def first_thing():"]
    assert service.call("cancel")["result"] and service.call("watchStatus")["result"]["paused"]
    (tree / "b.py").write_text("x = 1\n")
    service.indexer.on_phase = lambda phase: service.indexer.cancel() if phase == "scan" else None
    with pytest.raises(Cancelled):
        service.indexer.index()
    assert store.counts()["files"] == 1
    assert service.call("shutdown")["result"] == {"open": False} and not service.call("health")["result"]["healthy"]
    assert service.log[4]["params"] == {} and all("first_thing" not in str(x) or "sha256" in str(x) for x in service.log)
    with pytest.raises(ValueError):
        scope_of({"x": []})


def test_pause():
    watcher = Watcher(lambda paths: None)
    watcher.pause(0.05)
    watcher.pause(0.01)
    assert watcher.is_paused()
    time.sleep(0.06)
    assert not watcher.is_paused()
    watcher.pause()
    assert watcher.is_paused()
    watcher.resume()
    assert not watcher.is_paused()


def test_sanitise(spark):
    got = s.sanitise({"code_text": "a\nb", "query": "mail a@b.org", "n": math.nan, "items": list(range(30)), "deep": {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}, "ok": True, "long": "x" * 3000})
    assert got["code_text"] == {"sha256": s._sha("a\nb"), "byte_count": 3, "line_count": 2} and got["query"] == "mail [REDACTED_EMAIL]" and got["n"] is None and got["ok"] is True
    assert got["items"]["original_length"] == 30 and len(got["items"]["items"]) == 20 and got["long"].endswith(s.TRUNCATED) and got["deep"]["a"]["b"]["c"]["d"]["e"]["truncated"]
    bare = s.sanitise({"query": "find x", "file_path": "a/b.py", "id": "abc", "note": "two words", "Text": ["l"]}, stripped=True)
    assert bare["query"] == s.summary_of_string("find x") and bare["file_path"]["ext"] == ".py" and bare["id"] == "abc" and bare["note"]["length"] == 9 and bare["Text"]["byte_count"] == 5
    assert s.sanitise({str(i): i for i in range(90)})["__truncated_keys"]["kept"] == 80
    rows = spark.createDataFrame([("a\nb", "me@x.org", 1), (None, None, None)], "content string, query string, n int")
    first, second = s.sanitised(rows).collect()
    assert first["content"]["line_count"] == 2 and first["query"] == "[REDACTED_EMAIL]" and first["n"] == 1 and second["content"] is None and second["query"] is None
    strip = s.sanitised(rows.withColumn("id", F.lit("abc")), stripped=True).first()
    assert strip["query"]["sha256"] and strip["id"]["value"] == "abc" and strip["id"]["sha256"] is None
    assert spark.range(1).select(text.scrub(F.lit("A1@b.CO x"))).first()[0] == s.scrub("A1@b.CO x")


def test_pooling():
    states, mask = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    assert np.allclose(mean_pooled(states, mask), [[0.6, 0.8]])


def test_chunk_file():
    assert [c["kind"] for c in chunk_file("a.py", "x = 1\n")] == ["module"] and chunk_file("a.py", "") == []
    assert [(c["kind"], c["name"]) for c in chunk_file("a.py", "def f():\n    pass\n")] == [("function", "f")]
