"""A small source tree indexed, searched, changed and indexed again."""

import json

import pytest

from querrick.operators.embedding import HashEmbedder
from querrick.operators.scope import Scope
from querrick.plans import search as plans
from querrick.plans.engine import Engine, bounded, evaluation_queries, fit, report, safe_path
from querrick.plans.indexing import Incompatible, Indexer
from querrick.sources.store import Store

FILES = {
    "math_tools.py": '"""Sums."""\nfrom http_client import HttpClient\n\n\ndef add_numbers(a, b):\n    """Add two numbers together."""\n    return a + b\n\n\ndef caller():\n    return add_numbers(1, 2)\n',
    "http_client.py": 'class HttpClient:\n    """Sends requests over the network."""\n\n    def fetch_data(self, url):\n        return self.open(url, "no such status code")\n',
    "src/api/use.ts": "import {login} from '../auth';\nexport function useLogin() { return login('me'); }\n",
    "src/auth.ts": "/** Signs a user in. */\nexport function login(name: string) { return name; }\n",
    "src/__tests__/auth.test.ts": "import {login} from '../auth';\nfunction checksLogin() { login('x'); }\n",
    "README.md": "# Tool\n\nHow the network client sends requests.\n",
    "skip.min.js": "function skipped() {}\n", "node_modules/x.js": "function hidden() {}\n", ".gitignore": "ignored/\n*.log\n!keep.log\n", "ignored/a.py": "def gone(): pass\n", "a.log": "x", "keep.log": "kept line",
}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root, place = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("store")
    write(root, FILES)
    store = Store(spark, str(place))
    indexer = Indexer(store, str(root), HashEmbedder())
    first = indexer.index()
    return root, store, indexer, first, Engine(store, HashEmbedder(), str(root))


def names(hits):
    return [h["title"] for h in hits]


def test_index_and_search(built):
    root, store, _, first, engine = built
    paths = {r[0] for r in store.read("files").select("file_path").collect()}
    assert paths == {"math_tools.py", "http_client.py", "src/api/use.ts", "src/auth.ts", "src/__tests__/auth.test.ts", "README.md", ".gitignore", "keep.log"}
    assert first["files_new"] == 8 and first["embeddings_computed"] > 0 and first["symbols"] == 7
    got = engine.search("add_numbers", "definition", 5)
    assert names(got["groups"]["definitions"])[0] == "add_numbers" and got["groups"]["definitions"][0]["why"]["channels"]
    assert [a["tool"] for a in got["next_actions"]][:3] == ["get_symbol_details", "find_references", "read_file_lines"]
    assert names(engine.search("HtppClient", "definition", 5)["groups"]["definitions"])[0] == "HttpClient"
    assert engine.search("where is `login` used")["intent"] == "usage"
    usages = engine.search("where is `login` used")["groups"]["usages"]
    assert {u["file_path"] for u in usages} == {"src/api/use.ts", "src/__tests__/auth.test.ts"} and "__tests__" not in usages[0]["file_path"]
    blocks = engine.search('"no such status code"')
    assert blocks["intent"] == "exact_text" and blocks["groups"]["blocks"][0]["file_path"] == "http_client.py"
    concept = engine.search("sends requests over the network", k=9)
    assert concept["intent"] == "concept" and concept["groups"]["files"] and concept["groups"]["definitions"] and concept["groups"]["blocks"]
    assert engine.search("def add_numbers(a, b): return a + b")["intent"] == "similar_code"
    only = engine.search("login", "definition", scope=Scope(path_prefix=("src/",), path_not_contains=("__tests__",)))
    assert only["groups"]["definitions"] and all(h["file_path"].startswith("src/") and "__tests__" not in h["file_path"] for h in only["groups"]["definitions"])
    lone = Engine(store).search("login", "definition")
    assert lone["warnings"] == ["embeddings_unavailable"] and names(lone["groups"]["definitions"])[0] == "login"


def test_routed_batch(built, spark):
    store = built[1]
    single = Engine(store)
    asks = ["add_numbers(", "where is `login` used", '"no such status code"']
    rows = plans.search(single.tables(), spark.createDataFrame([(i, q) for i, q in enumerate(asks)], "query_id int, query string"), 5).collect()
    for n, q in enumerate(asks):
        alone = single.search(q, k=5)
        want = [(h["id"], g) for g, hits in alone["groups"].items() for h in hits]
        got = [(r["id"], r["grp"]) for r in sorted((r for r in rows if r["query_id"] == n), key=lambda r: (r["grp"], r["pos"]))]
        assert got == want and want and {r["intent"] for r in rows if r["query_id"] == n} == {alone["intent"]}


def test_lookups(built):
    root, store, _, _, engine = built
    symbol = engine.search("fetch_data", "definition", 1)["groups"]["definitions"][0]["id"]
    row = engine.get_symbol(symbol)
    assert row["qualname"] == "HttpClient.fetch_data" and not row["code_truncated"] and engine.get_symbol("none") is None
    assert engine.get_symbol(symbol, most=5)["code_truncated"] and "code_text" not in engine.get_symbol(symbol, with_code=False)
    around = engine.expand_context("symbols", symbol)
    assert around["found"] and around["file"]["file_path"] == "http_client.py" and [n["symbol_name"] for n in around["neighbors"]] == ["HttpClient", "fetch_data"]
    assert not engine.expand_context("chunks", "none")["found"] and not engine.expand_context("tables", "x")["found"]
    chunk = store.read("chunks").first()["chunk_id"]
    assert engine.expand_context("chunks", chunk)["chunk"]["chunk_id"] == chunk
    file = store.read("files").where("file_path = 'src/auth.ts'").first()["file_id"]
    assert engine.expand_context("files", file)["neighbors"][0]["symbol_name"] == "login"
    used = engine.find_usages(symbol_name="add_numbers")
    assert used["total"] == 1 and used["by_file"][0]["file_path"] == "math_tools.py" and used["by_file"][0]["refs"][0]["ref_kind"] == "call"
    assert engine.find_usages(symbol_id=symbol)["symbol_name"] == "fetch_data"
    lines = engine.read_file_lines("math_tools.py", 5, 400, 3)
    assert lines["lines"][0] == "def add_numbers(a, b):" and lines["end_line"] == 7 and lines["truncated"]
    for bad in ("../x", "", "/"):
        with pytest.raises(ValueError):
            safe_path(str(root), bad)


def test_bounds(built):
    engine = built[4]
    for call in (lambda: engine.search(" "), lambda: engine.search("x", k=101), lambda: engine.search("x", "other"), lambda: engine.find_usages(), lambda: engine.find_usages(symbol_name="x", k=2001), lambda: engine.expand_context("files", "x", 201), lambda: bounded("samples", 0)):
        with pytest.raises(ValueError):
            call()
    seen = []

    def make(k, explain):
        seen.append((k, explain))
        return {"x": "y" * (100 * k)}

    assert len(json.dumps(fit(make, 64, True, 2048))) <= 2048 and seen[:3] == [(64, True), (64, False), (32, False)]


def test_evaluation(built):
    engine = built[4]
    result = engine.evaluate()
    assert result["definition"]["metrics"]["mrr_at_10"] > 0.7 and result["definition"]["queries"] >= 8
    assert result["usage"]["metrics"]["hit_at_20"] > 0.5 and 0 <= result["concept"]["metrics"]["recall_at_50"] <= 1
    assert len(report(result).split("\n")) == 5
    assert evaluation_queries(engine.tables(), "similar_code", 3, 1).count() <= 3


def test_reindex(built, spark):
    root, store, indexer, first, engine = built
    again = indexer.index()
    assert (again["files_new"], again["files_modified"], again["files_deleted"]) == (0, 0, 0)
    write(root, {"new.py": "def fresh_name():\n    return 1\n", "math_tools.py": FILES["math_tools.py"].replace("add_numbers", "sum_numbers")})
    (root / "src/auth.ts").unlink()
    changed = indexer.index()
    assert (changed["files_new"], changed["files_modified"], changed["files_deleted"]) == (1, 1, 1)
    assert names(engine.search("fresh_name", "definition")["groups"]["definitions"])[0] == "fresh_name"
    assert not any(h["file_path"] == "src/auth.ts" for h in engine.search("login", "definition")["groups"]["definitions"])
    assert store.read("symbols").where("symbol_name = 'add_numbers'").count() == 0
    forced = indexer.index(force=True)
    assert forced["embeddings_computed"] == 0 and forced["embeddings_cached"] > 0 and forced["files"] == 8
    assert engine.status()["stats"]["files"] == 8


def test_compatibility(spark, tmp_path, built):
    store = Store(spark, str(tmp_path))
    assert store.compatibility()["status"] == "not_indexed"
    with pytest.raises(RuntimeError):
        Engine(store).search("x")
    for text, status in (("{", "corrupt_manifest"), ("{}", "corrupt_manifest"), ('{"schema_version": 5}', "needs_reindex"), ('{"schema_version": 6}', "compatible")):
        (tmp_path / "manifest.json").unlink(missing_ok=True)
        (tmp_path / ".manifest.json.crc").unlink(missing_ok=True)
        (tmp_path / "manifest.json").write_text(text)
        assert store.compatibility()["status"] == status
        if status == "needs_reindex":
            with pytest.raises(Incompatible):
                Indexer(store, str(built[0]), HashEmbedder()).index()
