"""The corpus pipeline: five stages, each a corpus operator, from raw documents to token ids.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows its predecessor kept. All but the last
return the columns of documents, whatever they are called: only doc_id and text are read (and n_chars rewritten where a
text changes). Null texts count as empty and stay null; an empty table goes through as one; a text of any length is
handled whole, at the cost of its own size in memory. Where each stage differs is said there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import attention_mil, catalog, debruijn, partenum, string_kernel, trie_bpe, wu_manber
from tideline.llm.common import new_path

#: Bytes of a batch of rows on its way to a Python worker, of at most 10,000 rows. By Spark's default, 64 MB, a task's texts went
#: as one batch, which executor and worker each held whole, beside what the worker made of it.
BATCH_BYTES = "4m"


def _in_batches(spark: SparkSession) -> None:
    """Stays set: what a stage returns is computed after it has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels as query op7 does. Repeated rows get equal scores;
    without labels of both kinds all documents get the same one. Null and empty texts are scored as one empty passage."""
    _in_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.filter(F.coalesce(string_kernel.remainder("doc_id", 5) != 0, F.lit(False)))
    return attention_mil.accepted(docs, learned, catalog.ACCEPT_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; rows without doc_id, or that share one but
    not the text, come after all others. Documents without words have no partners and stay; wholly equal rows are one."""
    _in_batches(spark)
    return partenum.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier in the corpus; documents that lose all their words go, those without words
    stay. Of equal texts the first one, by doc_id and then a hash, keeps its words."""
    _in_batches(spark)
    return debruijn.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; those without words have none. Each row is judged for itself."""
    _in_batches(spark)
    return wu_manber.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and a digest of the decoded text, a row each; texts without tokens have an empty list of ids."""
    _in_batches(spark)
    return trie_bpe.encoded_rows(docs, catalog.WORD_BPE)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A learned classifier and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
