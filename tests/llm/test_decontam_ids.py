"""Benchmark items without an id are looked for by their texts."""

from querrick.llm import decontam


def test_items_without_id(spark):
    said = "what is the tallest tree of the northern woods"
    docs = spark.createDataFrame([(1, f"they asked {said} again"), (2, "nothing of the kind"), (3, "the second item stands here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, said), (None, "second item stands"), (7, said), (8, None)], "item_id long, text string")
    found = {r.doc_id: [m.item_id for m in r.found] for r in decontam.matches(docs, items).collect()}
    assert found == {1: [None, 7], 2: [], 3: [None]}
    assert [r.doc_id for r in decontam.decontaminate(docs, items.where("item_id is null")).collect()] == [2]
