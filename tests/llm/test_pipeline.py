"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import brute_components, brute_hits, brute_removed
from tideline.llm.catalog import WORD_BPE


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema) if name != "token_ids" else stage(spark, docs, sf)
        after = {r.doc_id: r for r in docs.collect()}
        if name != "token_ids":
            assert docs.columns == columns and 0 < len(after) < len(before) + (name == "repeated_passages")
        order = sorted(before)
        if name == "quality":
            judged = [(labels[i] == 1) == (i in after) for i in before if i in labels]
            assert np.mean(judged) > 0.95
        elif name == "near_duplicates":
            want = {c for _, _, c in brute_components([(i, before[i].text) for i in order])}
            assert set(after) == want and all(after[i] == before[i] for i in after)
        elif name == "repeated_passages":
            for i, (n, gone, _) in zip(order, brute_removed([before[i].text for i in order]), strict=True):
                assert (i not in after) == (gone == n > 0) and (gone or after[i] == before[i])
                assert i not in after or len(after[i].text.split()) == n - gone or not gone
        elif name == "decontamination":
            assert set(after) == {i for i in before if not brute_hits(before[i].text, items)[1]}
        else:
            tk = Tokenizer.from_file(WORD_BPE)
            for i, r in after.items():
                assert list(r.ids) == tk.encode(before[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_run_of_odd_rows(spark, odd, empty, sf, tmp_path):
    """Nulls, empties, repetitions, a long text and clashing column names through all stages, and an empty table."""
    for name, docs in (("odd", odd), ("empty", empty)):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
    kept = odd
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, sf)
        assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({(r.doc_id, r.text) for r in kept.collect()}) and None in texts and "" in texts
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in out} <= {r.doc_id for r in odd.collect()} and all(r.n_tokens == len(r.ids) for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_texts_go_to_workers_in_small_batches(spark, sf, tmp_path):
    """A batch of Spark's default size would hold all of these 25 MB at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(2500, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 3300).alias("text")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "nbytes"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        found = stage(spark, docs, sf)
        got = docs.mapInArrow(sizes, "n long, nbytes long").collect()
        assert sum(r.n for r in got) == 2500 and max(r.nbytes for r in got) < 6_000_000
    assert found.count() == 2500
