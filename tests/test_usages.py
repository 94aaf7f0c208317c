"""References meet queries and files in place: nothing joins their whole table again."""

from pyspark.sql import functions as F

from querrick.operators import fusion, refs
from querrick.plans import search
from querrick.sources.corpus import Corpus

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """What the plan shuffles, by its output columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_refs_by_file_are_not_shuffled(spark):
    c = Corpus(spark, SF)
    for rows in (refs.limit_refs(c.refs_by_file.withColumn("ord", F.struct("start_line", "start_byte")), 2).select("ref_id"), refs.without_definition_names(c.refs_by_file, c.refs.select("file_path", "start_byte", "end_byte").limit(5)).select("ref_id")):
        assert not [e for e in exchanges(rows) if "token" in e or "start_byte" in e]
    one = lambda df: sorted(map(str, df.select("ref_id", "file_path", "token", "token_texts", "start_line", "start_byte").collect()))
    assert one(c.refs_by_file.where("start_line < 3")) == one(c.refs.where("start_line < 3"))


def test_names_of_definitions_with_odd_places(spark):
    rows = spark.createDataFrame([("a", 1, 2, "identifier"), ("a", 1, 2, "call"), ("a", 1, 3, "identifier"), ("b", 1, 2, "identifier"), (None, 1, 2, "identifier"), ("a", None, 2, "identifier"), ("a", 1, 2, None)], "file_path string, start_byte int, end_byte int, ref_kind string")
    names = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", None, 2), (None, 1, 2)], "file_path string, start_byte long, end_byte long")
    left = sorted(map(str, (tuple(r) for r in refs.without_definition_names(rows, names).collect())))
    assert left == sorted(map(str, [("a", 1, 2, "call"), ("a", 1, 3, "identifier"), ("b", 1, 2, "identifier"), (None, 1, 2, "identifier"), ("a", None, 2, "identifier"), ("a", 1, 2, None)]))


def test_equal_names_are_searched_once(spark):
    """Queries of one name get the same rows, and references are scanned once."""
    c = Corpus(spark, SF)
    word = c.refs.groupBy("token").count().where("token rlike '^[a-z]{4,}$'").orderBy(F.desc("count"), "token").first()[0]
    asks = spark.createDataFrame([(q, f"where is `{w}` used") for q, w in enumerate([word, word.upper(), word, "nowhere"])], "query_id long, query string")
    found = search.usages({"refs": c.refs}, asks, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(line") == 1
    hits = {}
    for r in found.collect():
        hits.setdefault(r.query_id, []).append((r.pos, r.id, r.file_path, r.score))
    assert set(hits) == {0, 1, 2} and len(hits[0]) == 5
    assert sorted(hits[0]) == sorted(hits[1]) == sorted(hits[2])


def test_exact_rows_are_not_shuffled(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False), ("b", 4, False), ("c", 5, True)], "query_id string, id int, is_exact boolean")
    got = fusion.prefer_exact(rows, apart=True)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fusion.prefer_exact(rows).collect())) == [("a", 1, True), ("b", 3, False), ("b", 4, False), ("c", 5, True)]
