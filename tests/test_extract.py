"""Extraction from small files of each language."""

import pytest

from querrick.extract import lexer, pieces
from querrick.extract.parse import dedupe, parse
from querrick.extract.rows import analyse, extracted, tables

TS = '''/** Users of the shop. */
import {Repo as Store, find} from "../repo";
import * as Net from '../net';
// Hidden
export class Basket extends Base {
  @memo
  total(items: Item[]): number {
    return items.map(i => i.price).reduce((a, b) => a + b, 0);
  }
}
function local(x: string) { return find(`id ${normalise(x)} "q" Hidden`); }
export const arrow = async (a: number) => { Net.send(a); outer.inner.run(); };
'''


def rows(path, text):
    out = list(analyse(path, text))
    return {e: [r for r in out if r["entity"] == e] for e in ("file", "symbol", "chunk", "ref")}


def test_typescript():
    got = rows("src/basket.ts", TS)
    assert [(s["kind"], s["class_name"], s["name"], s["is_exported"]) for s in got["symbol"]] == [("class", None, "Basket", True), ("method", "Basket", "total", False), ("function", None, "local", False), ("function", None, "arrow", True)]
    assert got["symbol"][1]["decorator_names"] == ["memo"]
    assert got["file"][0]["imports"] == ["../repo", "../net"] and got["file"][0]["docstring"] == " Users of the shop.".strip()
    refs = {(r["kind"], tuple(r["token_texts"])) for r in got["ref"]}
    assert {("import", ("Store", "Repo")), ("import", ("find",)), ("call", ("find",)), ("call", ("normalise",)), ("call", ("send", "Net.send")), ("call", ("run", "inner.run"))} <= refs
    assert not any("Hidden" in r["token_texts"] for r in got["ref"])
    local = got["symbol"][2]
    assert "normalise" in local["called_names"] and local["string_literals"]


def test_python():
    text = '"""Top."""\nfrom .a import (b as c,\n    D)\nimport os.path\n\n\n@wraps(1)\n@D.e\ndef f(x: int) -> int:\n    """Doc é."""\n    return c(x) + os.path.join(x)\n\n\nclass K:\n    def _m(self):\n        return self.f(LIMIT)\n'
    got = rows("m.py", text)
    assert [(s["kind"], s["name"], s["is_exported"], s["start_line"], s["end_line"]) for s in got["symbol"]] == [("function", "f", True, 9, 11), ("class", "K", True, 14, 16), ("method", "_m", False, 15, 16)]
    assert got["symbol"][0]["decorator_names"] == ["wraps", "D.e"] and got["symbol"][0]["docstring"] == "Doc é." and got["symbol"][0]["signature"] == "def f(x: int) -> int:"
    refs = [(r["kind"], r["token_texts"], r["module_name"], r["imported_name"]) for r in got["ref"]]
    assert ("import", ["c", "b"], ".a", "b") in refs and ("import", ["D"], ".a", "D") in refs and ("import", ["os", "path"], "os.path", None) in refs
    assert ("call", ["join", "path.join"], None, None) in refs and ("call", ["f"], None, None) in refs and ("identifier", ["LIMIT"], None, None) in refs
    data = text.encode()
    assert all(data[s["start_byte"] : s["end_byte"]].decode().startswith(("def", "class")) for s in got["symbol"])


OTHERS = [
    ("a.go", 'package a\nimport "fmt"\n// Make makes.\nfunc Make(m map[string]interface{}) map[string]interface{} {\n\treturn fmt.Sprint(m)\n}\ntype box struct {\n\tn int\n}\nfunc (b *box) Get() int { return b.n }\n', [("function", "Make", True), ("class", "box", False)]),
    ("a.rs", "use a::{b, c as d};\n/// Doc.\n#[inline]\npub fn add<T>(x: T) -> T { f!(\"}\"); x }\nstruct S { v: i32 }\nimpl S {\n    pub fn new() -> S { S { v: '{' as i32 } }\n}\n", [("function", "add", True), ("class", "S", False), ("class", "S", False), ("method", "new", True)]),
    ("A.java", "import a.b.C;\n/** Doc. */\npublic class A {\n  private int n;\n  public A(int n) { this.n = n; }\n  @Override\n  public String toString() { return \"{\"; }\n  private static void go() {}\n}\n", [("class", "A", True), ("method", "toString", True), ("method", "go", False)]),
    ("A.cs", "using System;\npublic class A\n{\n    public A() { }\n    [Obsolete]\n    public int Twice(int x) => x * 2;\n    internal void Go() { Console.WriteLine($\"a {Name(1)} }}\"); }\n}\n", [("class", "A", True), ("method", "Twice", True), ("method", "Go", False)]),
    ("a.kt", "import a.B as C\ninternal class K {\n    fun f(): String = \"${g(1)}\"\n    private fun h() { }\n}\nobject O\n", [("class", "K", False), ("method", "f", True), ("method", "h", False), ("class", "O", True)]),
    ("a.swift", "import Foundation\n@objc\npublic struct S {\n    public func f() -> String { return \"\\(g(1))\" }\n    func h() { }\n}\n", [("class", "S", True), ("method", "f", True), ("method", "h", False)]),
    ("a.php", "<?php\nuse A\\B as C;\n#[Pure]\nfunction f(int $x): int { return $x; } // }\nclass K {\n    private function h() { return strtoupper('{'); }\n}\n", [("function", "f", True), ("class", "K", True), ("method", "h", False)]),
]


@pytest.mark.parametrize(("path", "text", "want"), OTHERS, ids=[o[0] for o in OTHERS])
def test_other_languages(path, text, want):
    got = rows(path, text)
    assert [(s["kind"], s["name"], s["is_exported"]) for s in got["symbol"]] == want
    assert got["file"][0]["status"] == "parsed"
    if path in ("A.cs", "a.kt", "a.swift"):
        assert any({"Name", "g"} & set(r["token_texts"]) for r in got["ref"] if r["kind"] == "call")


def test_files_without_parser():
    assert rows("a.dart", "class A {}\n")["file"][0]["status"] == "unsupported" and rows("a.dart", "class A {}\n")["chunk"]
    broken = rows("b.py", "const x = {{{")
    assert broken["file"][0]["status"] == "parse_failed" and broken["chunk"] and not broken["symbol"]
    empty = rows("c.py", "")
    assert empty["file"][0]["status"] == "parsed" and not empty["chunk"]
    assert rows("d.md", "# T\n\ntext")["chunk"][0]["kind"] == "module"


def test_masks_keep_length():
    for name, text in [("typescript", "a `x ${b + `${c}`} y` /* d */ 'e' // f"), ("rust", "r#\"a\"b\"# 'c' \"d\\\"\" e"), ("csharp", '@"a""b" $"{c}" d'), ("python", '"""a\nb""" c # d'), ("kotlin", '"$a ${b("c")}" d')]:
        m = lexer.mask(text, name)
        assert len(m.code) == len(text) and m.code.count("\n") == text.count("\n") and m.code.rstrip()[-1] in "debcf'}"[:5]
    assert "b" in lexer.mask("`x ${b}`", "typescript").code and "x" not in lexer.mask("`x ${b}`", "typescript").code


def test_pieces():
    lines = ["a" * 30] * 100 + ["b" * 5000] + ["c"] * 3
    cut = pieces.by_lines(lines, 1, 2000, 0)
    assert "".join(p.text.replace("\n", "") for p in cut) == "".join(lines) and all(len(p.text) <= 2000 for p in cut)
    over = pieces.by_lines(lines[:100], 1, 500, 5)
    assert all(q.start == p.end - 4 for p, q in zip(over, over[1:], strict=False)) and over[-1].end == 100
    small = pieces.merge_small([pieces.Piece(1, 1, "a"), pieces.Piece(2, 3, "b"), pieces.Piece(5, 5, "c")])
    assert [(p.start, p.end) for p in small] == [(1, 3), (5, 5)]
    text = "\n".join(("# head " if i % 50 == 0 else "line ") + "w" * 40 + str(i) for i in range(300))
    got = pieces.markdown(text)
    assert got[0].start == 1 and got[-1].end == 300 and got[1].text.startswith(tuple(text.split("\n")[got[0].end - 7]))
    assert all(q.start <= p.end + 1 for p, q in zip(got, got[1:], strict=False))
    assert pieces.markdown("short") == [pieces.Piece(1, 1, "short")]
    body = ["def f():"] + ["    x = " + "1" * 90] * 60
    groups = pieces.by_statements(body, 1, 61, [(i, i) for i in range(2, 62)], 2000)
    assert [g.start for g in groups][0] == 1 and groups[-1].end == 61 and all(len(g.text) <= 2000 for g in groups)
    assert "\n".join(g.text for g in groups) == "\n".join(body)


def test_dedupe():
    refs = dedupe(parse("import {A} from 'm';\nA(1);\n", "typescript").refs)
    assert [(r.kind, r.texts) for r in refs] == [("import", ["A"]), ("call", ["A"])]


def test_tables(spark):
    long = "def long():\n" + "".join(f"    value_{i} = helper_{i}({i})\n" for i in range(120))
    files = spark.createDataFrame([("a.py", long + "\n\nclass K:\n    def m(self):\n        pass\n"), ("b.ts", TS), ("c.py", "x = {{{"), ("d.md", None)], "file_path string, content string")
    got = tables(extracted(files), files.selectExpr("file_path", "sha2(coalesce(content, ''), 256) as file_hash"), "root")
    symbols = {r["qualname"]: r for r in got["symbols"].collect()}
    assert set(symbols) == {"long", "K", "K.m", "Basket", "Basket.total", "local", "arrow"}
    assert symbols["K.m"]["parent_symbol_id"] == symbols["K"]["symbol_id"] and symbols["long"]["parent_symbol_id"] is None
    chunks = got["chunks"].collect()
    owned = [c for c in chunks if c["owner_symbol_id"]]
    assert len(owned) > 1 and {c["owner_symbol_id"] for c in owned} == {symbols["long"]["symbol_id"]} and all(len(c["code_text"]) <= 2000 for c in owned)
    assert {c["chunk_kind"] for c in chunks} == {"statement_group", "block", "markdown_section"}
    assert got["files"].count() == 4 and got["refs"].where("file_path = 'b.ts'").count() > 5
    assert got["files"].where("file_path = 'b.ts'").first()["file_summary_text"].startswith("File: b.ts\nExports: Basket, arrow\nImports: ../repo, ../net")


def test_declared_names_are_no_calls_and_keywords_no_identifiers():
    got = rows("a.go", "package a\nfunc (b *box) get(n int) int { return put(n) }\nfunc make2(x int) int { return b.get(x) }\n")
    assert [r["token_texts"] for r in got["ref"] if r["kind"] == "call"] == [["put"], ["get"]]
    assert got["symbol"][0]["called_names"] == ["b.get", "get"] and got["symbol"][0]["identifiers"] == ["make2", "x", "int", "b", "get"]
    java = rows("A.java", "public class A {\n  public A(int n) { go(n); }\n  void go(\n    int n) { }\n}\n")
    assert [r["token_texts"] for r in java["ref"] if r["kind"] == "call"] == [["go"]]
    assert java["symbol"][1]["signature"] == "void go(\nint n)"
    assert rows("a.ts", "export const f = (\n  a: number) => a;\n")["symbol"][0]["signature"] == "export const f = ("
    long = "x" * 600
    assert rows("a.py", f'def f():\n    return g("{long}")\n')["symbol"][0]["string_literals"] == [long[:512]]


def test_ignored_as_an_expression(spark):
    from pyspark.sql import functions as F

    from querrick.sources.ignore import IgnoreRules, ignored

    lines = ("*.log", "!keep.log", "/build/", "a/**/b.txt", "x[0-9].py", "\\#odd")
    paths = ["a.log", "s/keep.log", "build/x", "s/build/x", "a/b.txt", "a/c/d/b.txt", "x1.py", "xa.py", "#odd", "node_modules/a.js", "a/go.sum", "b\n.log", ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignored(F.col("p"), lines).alias("i")).collect()
    assert {r.p: r.i for r in got} == {p: IgnoreRules(lines).ignores(p) for p in paths}


def test_extract_symbols_extracts_twice_at_most(spark):
    """Once for the symbols, once for the classes that they belong to."""
    from querrick.plans.registry import QUERIES

    plan = QUERIES["extract_symbols"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 2
