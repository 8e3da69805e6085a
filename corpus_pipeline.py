"""A cleaning pipeline over ``documents`` made of five operators, each stage on what the last one kept.

toxicity scoring -> n-gram Jaccard near-duplicates -> benchmark decontamination -> personal data
-> SentencePiece encoding. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confora.llm import stages
from confora.llm.common import table, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("personal_data", stages.mask_personal_data),
    ("sentencepiece", stages.encode_pieces),
]

#: Viterbi decoding, MinHash classes and WAND retrieval have no SQL form; tests/llm/test_pipeline.py holds each stage against loops over all rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
