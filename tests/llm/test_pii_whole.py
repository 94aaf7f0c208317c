"""Terms that disclose an entity are found and marked in the whole document."""

from querrick.llm import pii


def test_terms_far_from_their_entity(spark):
    far = "filler words are in this one and some more of them"
    texts = [far] * 60 + [f"Zaphodine {far} {i} z@example.org {far} Zaphodine" for i in range(2)] + [f"Lonely {far} q@example.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.found_terms] for r in pii.sanitise(docs).collect()}
    assert got[60] == got[61] == ["Zaphodine", "Zaphodine"]
    # of one document only, and outside the window
    assert got[62] == [] and got[0] == []
