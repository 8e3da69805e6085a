"""Importance resampling towards a target collection: hashed n-gram weights, Gumbel noise, exact top scores.

Features of a text are its runs of 1 to ``ngrams`` consecutive words (``WORD`` after lower-casing A-Z only), each hashed into one
of ``buckets`` by crc32. A bucket's gain is the floored, scaled logarithm of its smoothed share in the target over that in the
corpus; a document's weight is the sum of gains over its features, read from an array of gains, and its score adds noise drawn
from its id. Of the N documents with at least ``min_words`` words, the floor(percent * N / 100) best scores are drawn.

Ranks come from an exact histogram of the integer scores. Sums of counts over higher scores give the rank at which each score
begins, in two levels: ``COARSE`` equal ranges of scores, whose sums the driver takes, and the scores within each range. The score
at which the quota runs out is the cutoff; only documents at or above it are numbered, within their score, by id.
No sort goes over all documents, and what reaches the driver is ``buckets`` counts twice and ``COARSE`` counts.

Nulls are empty texts. Ids of any type; a null id has the empty text as its digits and comes after all others of its score. Ties in score and id
go by the number of features; equal rows are counted together and numbered in blocks, so that one id may hold any share of the
rows. Empty tables give an empty result; without a target all gains follow the smoothing. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ranges of scores whose counts the driver sums.
COARSE = 4096
#: Score offsets are broadcast when they were counted to be at most so many (16 bytes each); beyond, the join shuffles.
BROADCAST_SCORES = 200_000
#: Equal rows numbered by one step.
BLOCK = 65_536


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def features(words: Column, ngrams: int) -> Column:
    """All runs of 1 to ``ngrams`` words, joined by one space, repeats included."""
    if ngrams == 1:
        return words

    def runs(k):
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    return F.concat(words, *[runs(k) for k in range(2, ngrams + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> list[int]:
    """Features in each bucket over all rows: at most ``buckets`` counts come to the driver."""
    each = texts.select(F.explode(features(words_of(F.col("text")), ngrams)).alias("feature"))
    counts = [0] * buckets
    for b, n in each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).count().collect():
        counts[b] = n
    return counts


def gains(corpus: list[int], target: list[int], buckets: int) -> list[int]:
    all_s, all_t = sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in zip(corpus, target)]


def noise(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: list[int], ngrams: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    per_bucket = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")  # folded to one constant by the optimiser
    found = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    found = found.select("doc_id", F.size("words").alias("n_words"), features(F.col("words"), ngrams).alias("features"))
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, f: total + F.get(per_bucket, bucket(f, len(gain)).cast("int")))
    found = found.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), weight.alias("weight"))
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def offsets(eligible: DataFrame, quota: int, low: int, high: int) -> DataFrame:
    """(score, above) for each score that is drawn from: how many documents score higher."""
    width = -(-(high - low + 1) // COARSE)
    histogram = written(eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor((F.col("score") - low) / width).cast("int")), "scores")
    above, higher = 0, {}
    for part, n in sorted(histogram.groupBy("part").agg(F.sum("n")).collect(), reverse=True):
        if above < quota:
            higher[part] = above
        above += n
    start = F.from_json(F.lit(json.dumps([higher.get(p) for p in range(COARSE)])), "array<bigint>")
    within = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = histogram.where(F.get(start, F.col("part")).isNotNull())
    found = found.select("score", (F.get(start, F.col("part")) + F.sum("n").over(within) - F.col("n")).alias("above"))
    return written(found.where(F.col("above") < quota), "offsets")


def numbered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of the drawn scores with their rank: that of the score, then by id."""
    key = ["score", "doc_id", "n_features", "weight"]
    small = starts.count() <= BROADCAST_SCORES
    each = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).join(F.broadcast(starts) if small else starts, "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("before", F.col("above") + before)
    blocks = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))))
    first = F.col("block") * BLOCK
    return blocks.select(*key, F.explode(F.sequence(F.col("before") + first + 1, F.col("before") + F.least(first + BLOCK, F.col("copies")))).alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, *, percent: int = 10, min_words: int = 20, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document; those that are drawn have a rank."""
    docs, target = renamed(docs, doc_id=id_col, text=text_col), renamed(target, text=target_col)
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets), buckets)
    every = written(scored(docs, gain, ngrams, seed), "weights")
    long_enough = every.where(F.col("n_words") >= min_words)
    n, low, high = long_enough.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    columns = ["doc_id", "n_features", "weight", "score"]
    quota = percent * n // 100
    if not quota:
        return every.select(*columns, F.lit(None).cast("long").alias("rank"))
    starts = offsets(long_enough, quota, low, high)
    cutoff = starts.agg(F.min("score")).first()[0]
    drawn = numbered(long_enough.where(F.col("score") >= cutoff), starts).select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    others = every.where((F.col("n_words") < min_words) | (F.col("score") < cutoff))
    return drawn.unionByName(others.select(*columns, F.lit(None).cast("long").alias("rank")))
