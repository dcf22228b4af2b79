"""The pipeline's stages on a small fixture."""

import corpus_pipeline
from zoomgraph.llm import mixing


def test_stages_and_columns(spark, tmp_path):
    good = " ".join(f"word{i} thing{i * 7 % 31}" for i in range(60))
    item = "Who built the tall tower of the northern gate? The masons of the third guild built it."
    rows = [(i, f"intro{i} " + " ".join(f"a{i * 37 + k}" for k in range(80)), "en", f"s{i % 2}", 0) for i in range(40)]
    rows += [(100, good, "en", "s0", 0), (101, good, "en", "s1", 0), (102, good + " end", "en", "s1", 0), (103, "12 ?!", None, "s1", 0), (104, rows[0][1] + " " + item + " " + good[::-1], "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, columns = {}, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        ids[name] = sorted(r["doc_id"] for r in docs.collect())
        assert docs.columns[: len(columns)] == columns
    clean = list(range(40))
    assert ids["language_id"] == [*clean, 100, 101, 102, 104]
    assert ids["ngram_join"] == [*clean, 100, 104]
    assert ids["decontaminate"] == [*clean, 100]
    before = spark.read.parquet(f"{tmp_path}/2")
    want = sorted(r["doc_id"] for r in mixing.pareto_mix(before).collect() for _ in range(r["copies"]))
    assert ids["mixing"] == want and ids["sharding"] == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(r) for r in docs.collect())
