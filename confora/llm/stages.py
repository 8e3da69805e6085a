"""The stages of corpus_pipeline.py: each applies one operator and lets its decision take effect.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``. Stages that drop
rows give each an internal key first, written with their input, so null and repeated ids are no exemption.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bm25_wand import contaminated
from .common import free_name, table, written
from .minhash_join import near_duplicate_classes
from .personal_data import masked, personal_spans
from .toxicity import free_prefix, toxicity
from .unigram import encoded

#: Dropped ids are broadcast only when they were counted to be at most so many (8 bytes each).
BROADCAST_IDS = 200_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for every row, written, so that every reader sees the same keys; and the key's name."""
    key = free_name("__row", *docs.columns)
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` less those with these keys, and without the key: by broadcast below the checked bound, else by a shuffled anti join."""
    keys = written(keys.select(key).distinct(), "dropped")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, key, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), keep_columns=True)
    return scored.where(F.col(f"{free_prefix(docs.columns)}predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; null ids come last."""
    rows, key = keyed(docs)
    classes = written(near_duplicate_classes(rows, id_col=key).where("n_links > 0").select(F.col("doc_id").alias(key), F.col("class_id").alias("class")), "classes")
    members = written(rows.select(key, F.col("doc_id").alias("id")).join(classes, key), "members")
    first = members.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", key))[key].alias("stays"))
    return without(rows, members.join(first, "class").where(F.col(key) != F.col("stays")), key).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark item go."""
    rows, key = keyed(docs)
    hits = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return without(rows, hits.select(F.col("doc_id").alias(key)), key).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; ``n_chars`` follows the text."""
    clean = masked(docs, personal_spans(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every remaining text."""
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
