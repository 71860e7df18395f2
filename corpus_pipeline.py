"""From raw documents to packed training sequences.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. mixing sources to target weights: documents are left out or repeated as drawn;
4. best-fit packing: pieces placed in sequences, the pipeline's result.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written and read again
before the next.

Rows with nulls in any column, empty and very long texts, ties, repeated rows and extra columns, also of clashing names, go through: null and empty
texts are judged by the classifier as empty texts; what it keeps of them stays in the second stage, as texts without words are nobody's
copies; they are drawn like others in the third (of size 0), and take one token in the last. Repeated rows are copies of each
other. doc_id is read as a long. Columns that a stage does not know are kept up to the last, whose columns are its own. Empty documents give an
empty result; without any label the classifier keeps every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import cut, table
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.neardup import deduplicated_documents
from tidemark.llm.packing import packed_documents
from tidemark.llm.quality import accepted_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: a classifier, MinHash and a tokenizer are beyond SQL; tests/llm compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{k}")
    return docs
