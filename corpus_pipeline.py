"""A training corpus from ``documents``: toxicity, near duplicates, repeated passages, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; every stage but the
last returns the columns of ``documents``, more columns included. Null texts count as empty texts and stay null; null
ids and repeated ids are rows like any other, but of exact copies one row stays; of equal texts the smallest id stays;
empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, near_duplicates, packing, repeats, toxicity
from rasterloom.llm.common import bounded_batches, ensure_checkpoint_dir, side_table, table
from rasterloom.llm.queries import PACKING_TOKENIZER


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted on these documents' labels, don't reject."""
    model = toxicity.fit(docs.select("doc_id", "text"), side_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, out=("_score", "_toxic")).where("_toxic = 0").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id."""
    bounded_batches(spark)
    return near_duplicates.keep_one(docs)


#: Words of a repeated string from which on it goes: over fifty.
REPEATED_WORDS = 51


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the bytes of strings of ``REPEATED_WORDS`` words that are anywhere else too."""
    bounded_batches(spark)
    cut = repeats.remove_repeats(docs, length=REPEATED_WORDS, v=21, words=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate."""
    marked = decontaminate.find_contamination(docs, side_table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns), prefix="_")
    return marked.where("not _contaminated").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces with their place in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.pack_documents(docs, PACKING_TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_substrings", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the models, sketches and the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote goes when the next has written, and only the result stays."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
