"""Each stage of the pipeline against brute force on what its predecessor kept."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_contamination, brute_fingerprint

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    draw = random.Random(9)
    make = lambda n: " ".join(f"w{draw.randrange(300)}" for _ in range(n))
    texts = [make(draw.randrange(20, 90)) for _ in range(160)]
    for i in range(0, 160, 4):
        texts[i] += " vile nasty vile rotten"
    texts += texts[1:40] + [None, ""]
    items = [make(20) for _ in range(4)]
    texts += [f"{make(15)} {b}" for b in items]
    rows = [(i, t, "en", ["a", "b", "c"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    after = [r.doc_id for r in kept["toxicity"]]
    toxic = {i for i, t in enumerate(texts) if t and "vile" in t}
    assert len(set(after) & toxic) <= len(toxic) // 10
    assert len(after) >= len(texts) - len(toxic)
    ids = sorted(after)
    expected = brute_components([brute_fingerprint(texts[i]) for i in ids], ids)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(set(expected.values()))
    left = [r.doc_id for r in kept["near_duplicates"]]
    judged = brute_contamination([texts[i] for i in left], list(enumerate(items)), 13)
    assert sorted(r.doc_id for r in kept["decontamination"]) == sorted(i for k, i in enumerate(left) if not judged[k][3])
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert set(copies) <= {r.doc_id for r in kept["decontamination"]} and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in kept["sharding"]) == copies
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == sum(copies.values())
