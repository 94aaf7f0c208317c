"""Every registered query against its SQL on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from querrick.functions import intent, text
from querrick.plans import registry

SF = "/root/testdata/sf0.001"


def shown(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return value.isoformat() if hasattr(value, "isoformat") else str(value).lower() if isinstance(value, bool) else "null" if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(shown(r[i]) for i in places) for r in want.fetchall())


def test_queries_without_sql(spark):
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"identifier_split_index", "search_routed"}
    import re

    got = {r.doc_id: r.parts for r in registry.QUERIES["identifier_split_index"](spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {i: " ".join(p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", t)) for i, t in docs.items()}


ROUTES = {
    "where used Foo": "usage", "Find usages of x": "usage", "where is 'x' used": "usage", 'say "hi"': "exact_text", "what's it": "exact_text", "TypeError: x": "exact_text", "a\nb": "similar_code",
    "x => y": "similar_code", "my class here": "similar_code", "classes here": "concept", "foo(": "definition", "a.b": "definition", "a::b": "definition", "getUser": "concept", "getUserName": "definition",
    "where is it defined": "definition", "how tokens flow": "concept", "": "concept", "éclass": "similar_code",
}


def test_routes(spark):
    rows = spark.createDataFrame([(q,) for q in ROUTES], "q string").select("q", intent.route(F.col("q")).alias("i")).collect()
    assert {r.q: r.i for r in rows} == ROUTES


def test_plans_and_tokens(spark):
    rows = {r.q: r for r in spark.createDataFrame([(q,) for q in ("'Foo.barBaz()'", "abc", "two words", "@Loader;", "a::bcdef", "x#" + "y" * 10, "9abcd")], "q string").select("q", intent.fuzzy_plan(F.col("q")).alias("p"), intent.usage_tokens(F.col("q")).alias("u")).collect()}
    assert rows["'Foo.barBaz()'"].p[:4] == ("barbaz", "foo.barbaz", 2, 1) and rows["abc"].p is None and rows["two words"].p is None and rows["9abcd"].p is None
    assert rows["@Loader;"].p[:4] == ("loader", None, 2, 1) and rows["a::bcdef"].p[:3] == ("bcdef", "a::bcdef", 1) and rows["x#" + "y" * 10].p[3] == 2
    assert tuple(rows["'Foo.barBaz()'"].u) == ("barBaz", "Foo.barBaz") and tuple(rows["two words"].u) == ("words", None)
    asks = {r.q: r.u for r in spark.createDataFrame([(q,) for q in ("where is `a.b.c` used", "find usages of self.run()", "is the used", 'calls of "x y"')], "q string").select("q", intent.usage_tokens(F.col("q")).alias("u")).collect()}
    assert tuple(asks["where is `a.b.c` used"]) == ("c", "b.c") and tuple(asks["find usages of self.run()"]) == ("run", None) and asks["is the used"] is None and tuple(asks['calls of "x y"']) == ("y", None)


def test_text_functions(spark):
    one = lambda *columns: tuple(spark.range(1).select(*columns).first())
    v = lambda a, b: text.compare_versions(F.lit(a), F.lit(b))
    assert one(v("1.2.3", "1.10.0"), v("v2.0.0", "1.9.9"), v("x", "1.0.0"), v("1.0.0-a", "1.0.0")) == (-1, 1, 0, 0)
    clamp = lambda a, b, n: text.clamp_lines(F.lit(a), F.lit(b), n)
    got = one(clamp(0, 5, 200), clamp(10, 3, 200), clamp(1, 500, 200))
    assert [tuple(x) for x in got] == [(1, 5, False), (10, 10, False), (1, 200, True)]
    assert one(text.scrub(F.lit("a B.c@d.Org sk-" + "a" * 20 + " " + "f" * 64 + " ghp_" + "1" * 20))) == ("a [REDACTED_EMAIL] [REDACTED_SECRET] [REDACTED_SECRET] [REDACTED_SECRET]",)
    assert one(text.identifier_parts(F.lit("getHTTPServer-name_x2Y")), text.indexed_parts(F.lit("getHTTPServer2_x")), text.middle_deleted(F.lit("abcdef")), text.middle_deleted(F.lit("abc"))) == (["get", "http", "server", "name", "x2", "y"], ["get", "http", "server", "2", "x"], "abcef", None)
    assert one(text.is_symbolish(F.lit("Ab")), text.is_symbolish(F.lit("A")), text.is_symbolish(F.lit("aB")), text.extension(F.lit("a.b/c")), text.extension(F.lit("x.test.ts")), text.is_test_path(F.lit("a/__Tests__/b"))) == (True, False, False, "", ".ts", True)
    assert one(text.normal_doc(F.lit("/** Hello\n  * there  you\n */")), text.prefix_tokens(F.lit("AbC"), 2, 8), text.prefix_tokens(F.lit("a"), 2, 8), text.code_to_query(F.lit("the of"))) == ("Hello there you", ["ab", "abc"], [], None)


def test_tokens_of_over_256_characters_are_not_searched(spark):
    from querrick.plans import search

    rows = [("c1", "a.py", ["lit " + "l" * 300], "word " + "w" * 300 + " " + "v" * 256)]
    chunks = spark.createDataFrame([(i, p, 1, 1, "block", li, code) for i, p, li, code in rows], "chunk_id string, file_path string, start_line int, end_line int, chunk_kind string, string_literals array<string>, code_text string")
    symbols = spark.createDataFrame([], "symbol_id string, file_path string, start_line int, end_line int, qualname string, string_literals array<string>, code_text string, is_exported boolean")
    asks = spark.createDataFrame([("long", "w" * 300), ("literal", "l" * 300), ("just", "v" * 256), ("short", "word")], "query_id string, query string")
    found = {r.query_id for r in search.exact_text({"chunks": chunks, "symbols": symbols}, asks).collect()}
    assert found == {"just", "short"}
