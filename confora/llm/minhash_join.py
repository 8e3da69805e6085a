"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of word n-grams (64-bit hashes of five lower-cased ``\\w+`` words; a
   text of fewer words has one n-gram of all of them) and a MinHash signature in bands; band and
   row counts follow from the threshold and the target recall.
2. Documents with equal n-gram sets collapse to one weighted representative.
3. Representatives are shuffled on their band hashes. Of buckets with the same members only the
   first is kept, so a pair of copies is verified once and not in every band.
4. Buckets are cut into tiles of bounded size. A tile verifies its pairs by set-matrix products
   and counts a pair only in the first band that both share. Only link counts and component edges
   leave a tile; no pair is ever a row, and none is dropped.
5. Components of the links give the class of near-duplicates.

Nulls and texts without words link with nothing and are their own class; repeated rows are documents of
their own, also under one id; an id with several texts is one document of each of their sets; rows with a
null id link like any other and count, and a class's id is the smallest that is not null; very long texts
are one set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, n_partitions, renamed, written
from .hashing import hashes_of_words, mix

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 80
#: Members and n-grams of a tile's side, on average: members are dealt to sides by a hash, so that the largest of many sides of 512 holds some 600.
TILE_ROWS = 512
TILE_NGRAMS = 400_000
#: Bytes of n-grams that a task puts into one batch.
BATCH_BYTES = 4 << 20


def bands_for(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs at the threshold with ``recall``."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def ngram_set(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    w = hashes_of_words(text)
    if not len(w):
        return w
    n = min(n, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        total = mix(total + w[i : len(w) - n + 1 + i])
    return np.unique(total)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 256):
            h = grams[i : i + 256, None] * self.a
            h += self.b
            np.minimum(low, h.min(axis=0), out=low)
        key = np.arange(self.bands, dtype=np.uint64)
        low = low.reshape(self.bands, self.rows)
        for r in range(self.rows):
            key = mix(key + low[:, r])
        return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, ngram: int) -> DataFrame:
    """(id, tk, k1, k2, n_grams, bands): the set's 128-bit key, its size and band keys; nulls without words."""

    def run(batches):
        sign = Signer(bands, rows)
        for b in batches:
            k1, k2, n, keys = [], [], [], []
            for t in b.column(1):
                t = t.as_py()
                g = ngram_set(t, ngram) if t else ()
                n.append(len(g))
                if len(g):
                    k1.append(int(mix(g + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(mix(g ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(sign(g))
                else:
                    k1.append(None), k2.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "tk", "k1", "k2", "n_grams", "bands"],
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tk long, k1 long, k2 long, n_grams int, bands array<long>")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, ngram: int = NGRAM, recall: float = RECALL
) -> DataFrame:
    """(doc_id, class_id, n_links, same_set_id): class_id is the smallest id that links reach, n_links the
    number of other documents with Jaccard >= threshold, same_set_id the smallest id with an equal set."""
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall)
    d = renamed(docs, id=id_col, text=text_col)
    sigs = written(signatures(d.withColumn("tk", F.xxhash64("text", F.isnull("id"))), bands, rows, ngram), "signatures")
    # a set is a node: its smallest id and one of that id's texts stand for it
    named = F.col("id").isNotNull()
    one = F.min(F.struct((~named).alias("unnamed"), "id", "tk")).alias("one")
    good = sigs.where("k1 is not null").groupBy("k1", "k2").agg(one, F.count("*").alias("n"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    reps = written(good.select("k1", "k2", F.monotonically_increasing_id().alias("rep"), F.col("one.id").alias("id"), F.col("one.tk").alias("tk"), "n", "n_grams", "bands"), "reps")
    entries = reps.select("rep", "n_grams", F.posexplode("bands").alias("band", "key"))
    h = F.xxhash64("rep")
    buckets = entries.groupBy("band", "key").agg(
        F.count("*").alias("size"),
        F.sum("n_grams").alias("grams"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s1"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("s2"),
    ).where("size > 1")
    kept = buckets.groupBy("size", "grams", "s1", "s2").agg(F.min(F.struct("band", "key")).alias("first"))
    tiles = F.greatest(F.ceil(F.col("size") / TILE_ROWS), F.ceil(F.col("grams") / TILE_NGRAMS)).cast("int")
    kept = kept.select("first.band", "first.key", tiles.alias("tiles"))
    wanted = entries.join(kept, ["band", "key"]).groupBy("rep").agg(F.collect_list(F.struct("band", "key", "tiles")).alias("spots"))
    wanted = written(wanted.join(reps.select("rep", "id", "tk", "n", "bands"), "rep"), "wanted")
    # one text for each wanted set: rows that repeat an id and its text are collapsed before they meet
    place = lambda tk: (F.xxhash64("id").alias("a"), tk.alias("b"))
    texts = d.select(*place(F.xxhash64("text", F.isnull("id"))), "text").groupBy("a", "b").agg(F.first("text").alias("text"))
    texts = texts.join(wanted.select(*place(F.col("tk")), "rep", "n", "bands", "spots"), ["a", "b"]).select("rep", "n", "bands", "spots", "text")

    def deal(batches):
        sign = Signer(bands, rows)
        for b in batches:
            out, held = [], 0
            for rep, n, keys, spots, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                g = ngram_set(text.as_py(), ngram)
                if sign(g).tolist() != keys:  # another text with this id and text key
                    continue
                packed = g.tobytes()
                for s in spots:
                    t = s["tiles"]
                    c = int(mix(np.array([rep], np.int64).view(np.uint64))[0]) % t
                    for j in range(t):
                        out.append((s["band"], s["key"], min(c, j), max(c, j), c, rep, n, keys, packed))
                        held += len(packed) + 200
                        if held >= BATCH_BYTES:
                            yield record(out)
                            out, held = [], 0
            if out:
                yield record(out)

    def record(out):
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["band", "key", "ta", "tb", "side", "rep", "n", "bands", "grams"])

    dealt = texts.mapInArrow(deal, "band int, key long, ta int, tb int, side int, rep long, n long, bands array<long>, grams binary")
    dealt = dealt.repartition(n_partitions(spark), "band", "key", "ta", "tb").sortWithinPartitions("band", "key", "ta", "tb", "side", "rep")

    def verify(batches):
        yield from verified(batches, threshold)

    found = written(dealt.mapInArrow(verify, "rep long, links long, other long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    comp = written(reps.select("rep", "id").join(comp, F.col("rep") == comp.node), "components")
    named = comp.groupBy("component").agg(F.min("id").alias("class"))
    comp = comp.join(named, "component").select("rep", "class")
    known = reps.select("k1", "k2", "rep", "n", F.col("id").alias("same")).join(links, "rep", "left").join(comp, "rep", "left")
    known = known.select("k1", "k2", "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("class", "same").alias("class"))
    all_docs = sigs.select("id", "k1", "k2").join(known, ["k1", "k2"], "left")
    return all_docs.select(
        F.col("id").alias("doc_id"),
        F.coalesce("class", "id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("same", "id").alias("same_set_id"),
    )


def verified(batches, threshold: float):
    """Rows come tile by tile; a tile at a time is held."""
    now, rows = None, []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(7)]
        keys = np.asarray(b.column(7).flatten()).reshape(b.num_rows, -1)
        for i, grams in enumerate(b.column(8)):
            tile = tuple(cols[c][i] for c in range(4))
            if tile != now:
                if len(rows) > 1:
                    yield tile_links(now, rows, threshold)
                now, rows = tile, []
            rows.append((cols[4][i], cols[5][i], cols[6][i], keys[i].copy(), np.frombuffer(grams.as_py(), np.uint64)))
    if len(rows) > 1:
        yield tile_links(now, rows, threshold)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of the sets' incidence matrix in blocks of n-grams."""
    n = len(sets)
    if n == 2:
        at = np.searchsorted(sets[0], sets[1])
        same = sets[0][np.minimum(at, len(sets[0]) - 1)] == sets[1]
        return np.array([[0, same.sum()], [same.sum(), 0]], np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, gram, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(df > 1) - 1
    keep = df[gram] > 1
    owner, gram = owner[keep], new[gram[keep]]
    by = np.argsort(gram, kind="stable")
    owner, gram = owner[by], gram[by]
    total, width = np.zeros((n, n), np.float32), 1024
    for lo in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        s, e = np.searchsorted(gram, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[owner[s:e], gram[s:e] - lo] = 1
        total += m @ m.T
    return total


def tile_links(tile, rows, threshold: float) -> pa.RecordBatch:
    band, _, ta, tb = tile
    side = np.array([r[0] for r in rows])
    ids, weight = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    keys, sets = np.array([r[3] for r in rows], np.int64), [r[4] for r in rows]
    size = np.array([len(s) for s in sets], np.float64)
    same = overlaps(sets)
    near = np.empty(same.shape, bool)
    for i in range(0, len(sets), 256):
        part = same[i : i + 256].astype(np.float64)
        near[i : i + 256] = part / (size[i : i + 256, None] + size - part) >= threshold
    np.fill_diagonal(near, False)
    if ta != tb:
        near &= side[:, None] != side
    for i in np.nonzero(near.any(axis=1))[0]:  # a pair counts in the first band that both share
        at = np.nonzero(near[i])[0]
        near[i, at] = (keys[at] == keys[i]).argmax(axis=1) == band
    links, lab, top = near @ weight, ids.copy(), np.iinfo(np.int64).max
    some = near.any(axis=1)
    if some.any():
        a, l = near[np.ix_(some, some)], lab[some]
        while True:
            l2 = np.minimum(l, np.where(a, l, top).min(axis=1))
            if (l2 == l).all():
                break
            l = l2
        lab[some] = l
    moved = lab != ids
    rep = np.concatenate([ids[some], ids[moved]])
    return pa.RecordBatch.from_arrays(
        [pa.array(rep), pa.array(np.concatenate([links[some], np.zeros(moved.sum(), np.int64)])), pa.array([None] * int(some.sum()) + lab[moved].tolist(), pa.int64())], ["rep", "links", "other"]
    )
