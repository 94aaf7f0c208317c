"""Near-duplicate groups of the pipeline's stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from querrick.llm import neardup, simhash

SF = "/root/testdata/sf0.001"


def shingle_set(text, words=5):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def brute_groups(rows):
    sets, fps = [shingle_set(t) for _, t in rows], [simhash.fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or (union and len(sets[i] & sets[j]) * 10 >= 8 * union):
                own[top(i)] = top(j)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[top(n)] = min(i, least.get(top(n), i))
    return {i: least[top(n)] for n, (i, _) in enumerate(rows)}


def test_stage_finds_all_pairs_of_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [f"w{i}" for i in range(60)]
    made = []
    # copies of one text with words changed at the end, around the bound, of texts long and short; a chain of them
    for n, size in enumerate((9, 14, 30, 60)):
        for cut in range(size // 2):
            made.append((100_000 + 100 * n + cut, " ".join([*(f"{n}{w}" for w in base[: size - cut]), *(f"x{n}.{cut}.{i}" for i in range(cut))])))
    more = spark.createDataFrame(made, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more).cache()
    rows = [tuple(r) for r in both.collect()]
    want = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in neardup.near_groups(both).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, both, SF).collect()}
    assert kept == set(want.values())
    # SimHash alone leaves some of these pairs apart
    assert {r.doc_id for r in simhash.simhash_dedup(both).collect()} > kept


def test_shared_lists_in_small_batches(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join([*(rng.choice(["x", "y", "z", "u"]) for _ in range(rng.randrange(9))), *(common if i % 2 else [])]) for i in range(300)]
    slim = spark.createDataFrame([(i % 40, i, t) for i, t in enumerate(texts)], "doc_id long, node long, text string")
    counts = neardup.bucket_counts(neardup.described(slim, 3, 3, "doc_id", "text")[1])
    assert counts.sum() == sum(len(neardup.shingles(t, 3)) for t in texts)
    places = {(r.shingle, r.node, r.n, r.pos) for r in neardup.prefixes(slim, counts, 3, 0.6).collect()}
    nodes = {}
    for s, n, _, _ in places:
        nodes.setdefault(s, set()).add(n)
    want = sorted(p for p in places if len(nodes[p[0]]) > 1)
    for rows in (1, 2, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        assert sorted(tuple(r) for r in neardup.shared_lists(slim.repartition(3), counts, 3, 0.6).collect()) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_large_group_with_outsiders(spark):
    """Copies that differ by a word each, texts that only share passages with them, and a chain: all against brute force."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(150):
        words = list(base)
        if i % 3:
            words[rng.randrange(50)] = f"own{i}"
        if i % 5 == 0:
            words = words[:25] + [f"far{i}.{j}" for j in range(25)]
        rows.append((1000 + i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_groups(table).collect()} == brute_groups(rows)
