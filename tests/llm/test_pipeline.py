"""The corpus pipeline on a small fixture, each stage's decision by hand."""

import corpus_pipeline

from .test_dedup import DOC


def test_stages(spark, tmp_path):
    body = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    item = "What is the name of the quiet river near town? It is the silver brook."
    rows = [(1, body(1)), (2, body(1)), (3, body(1).replace("word1x39", "other")), (4, "12 !"), (5, f"{body(5)} {item}"), (6, body(6)), (7, None), (8, "short text")]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], DOC)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialise(stage(spark, now, str(tmp_path)))
        assert now.schema == d.schema
        kept.append(sorted(r.doc_id for r in now.collect()))
    assert kept == [[1, 2, 3, 5, 6, 8], [2, 3, 5, 6, 8], [2, 5, 6, 8], [2, 6, 8]]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {2, 6, 8} and {r.sequence_id for r in packed} == {0}


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows and ids, a long text, no labels; and no rows at all."""
    long_ = " ".join(f"l{i}" for i in range(30_000))
    rows = [(None, "a lone text", None, None, None), (None, None, None, None, None), (2**60 + 1, "twice the same row", None, "s", 1), (2**60 + 1, "twice the same row", None, "s", 1), (2**60 + 1, "another and much longer text of that same id, with more words than the other one has", None, "s", 1), (5, long_, None, None, None), (6, "", None, None, None)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, block int")
    bench = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    for name, docs, want in (("odd", d, [None, 5, 2**60 + 1, 2**60 + 1]), ("none", d.limit(0), [])):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        bench.write.parquet(str(folder / "benchmark.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        whole = {(r.doc_id, r.doc_tokens): 0 for r in packed}
        for r in packed:
            whole[r.doc_id, r.doc_tokens] += r.length
        assert sorted((i for i, _ in whole), key=lambda i: i or 0) == want and all(n == size for (_, n), size in whole.items())
