"""From raw documents to token ids, in five stages; counted as part of the llm subpackage.

Every stage works on all rows that the one before it kept, its result is written as Parquet and read again, and all but
the last return the columns of ``documents``:

1. quality: documents that the classifier rejects go (fitted on the labelled rows outside its held-out fold);
2. exact_dedup: of equal texts the smallest doc_id stays;
3. near_dedup: of documents linked by word 5-shingles with a Jaccard similarity of 0.8 or more one stays;
4. decontaminate: passages of the benchmark are cut out; a document without another word goes;
5. tokenize: texts become SentencePiece ids, checked by decoding.

Null and empty texts, repeated rows, empty tables and further columns have the results that the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import decontamination, exact_dedup, jaccard, quality, sentencepiece_codec
from keyweave.llm.common import prepared, shared_folder, table
from keyweave.llm.queries import PIECES

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return exact_dedup.drop_duplicates(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return jaccard.first_of_each(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"), size=10)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return sentencepiece_codec.round_trip(docs, PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_contents),
    ("decontaminate", without_benchmark),
    ("tokenize", token_ids),
]

#: The classifier, the shingle join and the tokenizer have no counterpart in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder; what each leaves is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
