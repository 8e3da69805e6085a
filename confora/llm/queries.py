"""The registered queries of this package and their SQL, where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_count import token_counts

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_runs, globally_numbered, merged_index, write_archives

    pages = table(spark, sf_dir, "pages")
    at = F.timestamp_seconds(F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)) + 1_577_836_800)  # the table has no capture times
    merged = globally_numbered(merged_index(capture_runs(spark, write_archives(pages, at))))
    return merged.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
        "url_key", "capture_time", "index_position",
    )


def op10_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_cells import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_join import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25_wand import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def removed_length(removed):
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, x: n + x["length"])


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree_dedup import remove_repeated_words

    found = remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_symbols").alias("n_words"), removed_length("removed").alias("n_removed"), "kept_sha256")


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array_dedup import remove_repeated_bytes

    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_symbols").alias("n_bytes"), removed_length("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import KINDS, N_BASE, listed, personal_spans

    found = personal_spans(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:N_BASE])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_detections

    found = license_detections(table(spark, sf_dir, "documents"))
    places, listed = F.col("base.word"), lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.coalesce(F.array_max("detections.confidence"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"), listed(F.concat("base.label", "detections.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(own).alias("score"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import audited, damage, digests, repaired

    conversations = table(spark, sf_dir, "conversations")
    rows = damage(conversations)
    audits = audited(rows)
    kept = digests(repaired(rows, audits)).withColumnRenamed("conv_id", "repaired_id")
    every = conversations.select(F.col("conv_id").alias("original_id")).distinct()
    found = every.join(audits.drop("pieces"), F.col("original_id").eqNullSafe(F.col("conv_id")), "left").join(kept, F.col("original_id").eqNullSafe(F.col("repaired_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        F.col("original_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_decontamination": op2_decontamination,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_warc_index": op4_warc_index,
        "op10_embedding_cells": op10_embedding_cells,
        "op9_toxicity": op9_toxicity,
        "op5_suffix_trees": op5_suffix_trees,
        "op8_suffix_arrays": op8_suffix_arrays,
        "op7_personal_data": op7_personal_data,
        "op6_token_counts": op6_token_counts,
        "op11_license_scan": op11_license_scan,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1, "op4_warc_index": OP4, "op5_suffix_trees": OP5, "op10_embedding_cells": OP10, "op12_importance_resampling": OP12}


#: Connected components of ``links`` (a, b), both ways round, by spreading smaller ids.
_COMPONENTS = """reach(node, label) AS (SELECT a, a FROM links UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node WHERE r.label < l.b),
component AS (SELECT node, min(label) AS label FROM reach GROUP BY 1)"""

OP1 = (
    r"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, md5(array_to_string(ws[i : i + 4], ' ')) AS gram FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n, md5(string_agg(gram, '' ORDER BY gram)) AS key FROM g GROUP BY 1),
shared AS (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.rid <> y.rid GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT a, b FROM shared JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE k::DOUBLE / (p.n + q.n - k) >= 0.8),
links AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM pairs JOIN w x ON x.rid = a JOIN w y ON y.rid = b),
"""
    + _COMPONENTS
    + """, same AS (SELECT key, min(doc_id) AS first FROM n JOIN w USING (rid) GROUP BY 1)
SELECT w.doc_id, coalesce(c.label, w.doc_id) AS class_id, coalesce(d.k, 0) AS n_links, coalesce(same.first, w.doc_id) AS same_set_id FROM w LEFT JOIN n USING (rid) LEFT JOIN same USING (key)
LEFT JOIN component c ON c.node = w.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM pairs GROUP BY 1) d ON d.a = w.rid"""
)

#: Base32 digits from five bits at a time of the hexadecimal digest.
_BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * i::INT, 5))::INT >> s) & 31) + 1, 1)), '')), '')"

OP4 = (
    """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n, regexp_replace(coalesce(url, ''), '#.*$', '') AS u FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
q AS (SELECT p.*, first, regexp_extract(u, '^[a-z]+://(?:www[.])?([^/?:]*)', 1) AS host, regexp_extract(u, '^[a-z]+://[^/?]*(.*)$', 1) AS rest FROM p JOIN f USING (h)),
r AS (SELECT *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END AS url_key,
    strftime(to_timestamp(page_id % 1000000000 + 1577836800) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS capture_time FROM q)
SELECT page_id, n AS payload_bytes, """
    + _BASE32
    + """ AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, url_key, capture_time, row_number() OVER (ORDER BY encode(url_key), capture_time, page_id) - 1 AS index_position FROM r"""
)

OP5 = r"""WITH d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
twice AS (SELECT key FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (key)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
marked AS (SELECT w.doc_id, w.i, word, max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM words w LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.i = w.i),
kept AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS text FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP10 = (
    """WITH RECURSIVE every AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings),
v AS MATERIALIZED (SELECT rid, embedding::DOUBLE[] AS e FROM every WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.rid AS a, y.rid AS b FROM v x JOIN v y ON x.rid <> y.rid AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95), """
    + _COMPONENTS
    + """, least AS (SELECT label, min(vec_id) AS first FROM component JOIN every ON rid = node GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(first, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(first, vec_id) AS kept FROM every
LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY 1) ON a = rid LEFT JOIN component ON node = rid LEFT JOIN least USING (label)"""
)

#: crc32 of each distinct word from a table of its 256 steps; gains and noise in doubles.
OP12 = r"""WITH steps AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY 1, 2),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY 1),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), steps),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN crc USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN crc USING (w) GROUP BY 1),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY 1),
score AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight USING (rid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked"""
