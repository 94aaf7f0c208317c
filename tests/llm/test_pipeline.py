"""The pipeline's stages, each against what it should keep of its input."""

import corpus_pipeline
from querrick.llm import decontam, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        rows[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "SimHash near-dedup":
            fps = [simhash.fingerprint(r.text) for r in rows[name]]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
        if name == "benchmark decontamination":
            finder = decontam.Finder([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()], 0.08)
            assert not any(finder.find(r.text) for r in rows[name])
            assert {r.doc_id for r in rows[name]} == {r.doc_id for r in before.collect() if not finder.find(r.text)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {r.doc_id for r in rows["quality classifier"]}
    good = [i for i, q in labels.items() if q]
    assert sum(i in first for i in good) > 0.9 * len(good)
    assert len(rows["sharding"]) == len(rows["mixing sources to target weights"])
    assert corpus_pipeline.run(spark, SF).count() == len(rows["sharding"])
