"""Repeated windows of a corpus: what substring removal by suffix trees and by suffix arrays share.

A window is ``width`` consecutive symbols (words, or bytes) of one text; it is removable when its
content also starts anywhere else. Removal is judged on the input.

1. Texts are collapsed to distinct ones (partial aggregation first, so copies never meet in one
   task). All windows of a text that has copies are repeated.
2. Every window has an anchor, the k-gram of least hash in it; equal windows have equal anchors.
   Anchors are counted over the corpus, and only windows whose anchor occurs twice go on. This
   prunes suffixes that cannot share ``width`` symbols with any other; it loses none.
3. Stretches of such windows with one anchor value are shipped, as text, to the shard of that value.
   Equal stretches of one task are sent once. Anchor values that are too frequent for a shard in
   memory are extended to the full depth: single windows, by digests of their content, again sent once
   per task, so that no key gathers more rows than there are tasks and distinct contents.
4. Spark's disk-backed sort hands a shard its stretches anchor by anchor; those of as many anchors as fit are compared
   at a time by the operator's own method (``separate``), symbol by symbol, and repeated windows are reported.
5. The reports meet their text again and the covered symbols are removed.

Fingerprints place and prune. What is removed was compared symbol by symbol, but for three cases where cryptographic digests stand for the content: whole copies
(120 bits of SHA-256 of the text), equal stretches of one task and windows of too frequent anchors (128 bits of BLAKE2b).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, renamed
from .hashing import P1, Fingerprints, mix

#: A fixed 64-bit number for each byte, from the mixing rule.
BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * P1)
LONGEST_RUN = 4096
#: Occurrences of an anchor value from which its windows are spread by digests of their whole content.
HOT = 20_000
#: Windows that a shard compares at once, besides those of a single anchor value.
AT_ONCE = 400_000
REMEMBERED = 100_000


def sliding(a: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


class Words:
    """Words between ASCII white space, unchanged; a word's symbol is the fingerprint of its bytes."""

    @staticmethod
    def split(data: bytes) -> tuple[tuple, np.ndarray]:
        b = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
        edges = np.diff(inside)
        starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        prints = Fingerprints(BYTE_CODE[b])
        return (data, starts, ends), prints.at(starts, ends - starts)

    @staticmethod
    def cut(parts: tuple, start: int, end: int) -> bytes:
        data, starts, ends = parts
        return data[starts[start] : ends[end - 1]]

    @staticmethod
    def content(data: bytes) -> bytes:
        """The same for stretches of the same words, whatever stands between them."""
        return b" ".join(data.split())

    @staticmethod
    def join(parts: tuple, keep: np.ndarray) -> bytes:
        words = parts[0].split()  # of bytes, this splits at the same six characters
        return b" ".join(words if keep.all() else [words[i] for i in np.nonzero(keep)[0]])


class Bytes:
    @staticmethod
    def split(data: bytes) -> tuple[bytes, np.ndarray]:
        return data, BYTE_CODE[np.frombuffer(data, np.uint8)]

    @staticmethod
    def cut(parts: bytes, start: int, end: int) -> bytes:
        return parts[start:end]

    @staticmethod
    def content(data: bytes) -> bytes:
        return data

    @staticmethod
    def join(parts: bytes, keep: np.ndarray) -> bytes:
        return np.frombuffer(parts, np.uint8)[keep].tobytes()


def window_anchors(symbols: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-grams, the anchor value of each window)."""
    grams = Fingerprints(symbols).all(k)
    return grams, sliding(grams, width - k + 1)


def anchor_counts(symbols: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor values of a text and the number of places of each."""
    grams, least = window_anchors(symbols, width, k)
    span = width - k
    edge = np.zeros(span, np.uint64)
    chosen = grams == sliding(np.concatenate([edge, least, edge]), span + 1, np.maximum)
    return np.unique(grams[chosen], return_counts=True)


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts = np.nonzero(edges == 1)[0]
    return list(zip(starts.tolist(), (np.nonzero(edges == -1)[0] - starts).tolist(), strict=True))


def repeated_windows(
    docs: DataFrame, alphabet, width: int, k: int, separate: Callable, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """(doc_id, n_symbols, removed, kept_sha256): ``removed`` lists (start, length) of removed stretches."""
    spark = docs.sparkSession
    d = renamed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    digits = lambda at: F.conv(F.substring(F.sha2("text", 256), at, 15), 16, 10).cast("long")
    d = d.withColumns({"k1": digits(1), "k2": digits(16)})
    texts = d.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("n"))

    def count(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = ([], [], [], [])
                for k1, k2, n, t in zip(*(part.column(i).to_pylist() for i in range(2)), part.column(3).to_pylist(), part.column(2), strict=True):
                    symbols = alphabet.split(t.as_py().encode())[1]
                    if len(symbols) >= width:
                        v, c = anchor_counts(symbols, width, k)
                        for o, x in zip(out, (v.view(np.int64), c * min(n, 2), np.full(len(v), k1), np.full(len(v), k2)), strict=True):
                            o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["anchor", "c", "k1", "k2"])

    anchors = texts.mapInArrow(count, "anchor long, c long, k1 long, k2 long")
    twice = anchors.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor", (F.col("c") > hot).alias("hot"))
    lists = anchors.select("anchor", "k1", "k2").join(twice, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "hot")).alias("anchors"))

    def ship(batches):
        """Rows to shards (n_windows > 0: text, 0: digest), and reports of repeats within the task (n_windows < 0)."""
        seen: dict = {}
        for b in batches:
            out: list = []
            for k1, k2, n, found, t in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), b.column(2), strict=True):
                parts, symbols = alphabet.split(t.as_py().encode())
                values = np.array([x["anchor"] for x in found], np.int64).view(np.uint64)
                frequent = np.array([x["anchor"] for x in found if x["hot"]], np.int64).view(np.uint64)
                least = window_anchors(symbols, width, k)[1]
                cuts = np.concatenate([[0], np.nonzero(np.diff(least))[0] + 1, [len(least)]])
                value = least[cuts[:-1]]
                is_hot = np.isin(value, frequent)
                for i in np.nonzero(np.isin(value, values))[0]:
                    anchor, lo, hi = int(value[i].view(np.int64)), int(cuts[i]), int(cuts[i + 1])
                    again = np.zeros(hi - lo, bool) if is_hot[i] else None
                    run = 1 if is_hot[i] else LONGEST_RUN
                    for s in range(lo, hi, run):
                        m = min(run, hi - s)
                        data = alphabet.cut(parts, s, s + m + width - 1)
                        key = hashlib.blake2b(alphabet.content(data) if is_hot[i] else data, digest_size=16).digest()
                        first = seen.get(key)
                        if first is None:
                            seen[key] = (k1, k2, s, m)
                            out.append((int.from_bytes(key[:8], "little", signed=True), 0, k1, k2, s, 0, key) if is_hot[i] else (anchor, anchor, k1, k2, s, m, data))
                            continue
                        if is_hot[i]:
                            again[s - lo] = True  # told run by run
                        else:
                            out.append((hash((k1, k2, s)), 0, k1, k2, s, -m, b""))
                        if first:
                            out.append((hash(first[:3]), 0, first[0], first[1], first[2], -first[3], b""))
                            seen[key] = ()
                    if is_hot[i]:
                        out += [(hash((k1, k2, lo + s)), 0, k1, k2, lo + s, -m, b"") for s, m in spans(again)]
                if len(out) > 2000:
                    yield rows(out)
                    out = []
                if len(seen) > REMEMBERED:
                    seen.clear()
            if out:
                yield rows(out)

    names = ["shard", "anchor", "k1", "k2", "start", "n_windows", "data"]

    def rows(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def compare(batches):
        """Groups of shard values, as many as fit, at a time."""
        held, total, shard = [], 0, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for row in zip(*cols, b.column(6), strict=True):
                if row[0] != shard:
                    if total > AT_ONCE:
                        yield from report(held)
                        held, total = [], 0
                    shard = row[0]
                held.append((*row[:6], row[6].as_py()))
                total += row[5] if row[5] > 0 else 1
        yield from report(held)

    def report(held):
        found = [(r[2], r[3], r[4], -r[5]) for r in held if r[5] < 0]
        digests: dict = {}
        for r in held:
            if r[5] == 0:
                digests.setdefault(r[6], []).append(r)
        found += [(r[2], r[3], r[4], 1) for same in digests.values() if len(same) > 1 for r in same]
        runs = [r for r in held if r[5] > 0]
        if runs:
            flags = separate([r[6] for r in runs], [r[5] for r in runs], np.array([r[1] for r in runs], np.int64).view(np.uint64), width, k)
            found += [(r[2], r[3], r[4] + s, m) for r, f in zip(runs, flags, strict=True) for s, m in spans(f)]
        if found:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], ["k1", "k2", "start", "n"])

    shipped = texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "n", "anchors").mapInArrow(ship, "shard long, anchor long, k1 long, k2 long, start int, n_windows int, data binary")
    shards = shipped.repartition(n_partitions(spark), "shard").sortWithinPartitions("shard")
    reports = shards.mapInArrow(compare, "k1 long, k2 long, start int, n int")
    reports = reports.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("windows"))

    def remove(batches):
        for b in batches:
            sizes, removed, shas = [], [], []
            for n, windows, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(2), strict=True):
                data = t.as_py().encode()
                parts, symbols = alphabet.split(data)
                gone = np.zeros(len(symbols) + 1, np.int64)
                if n > 1 and len(symbols) >= width:
                    gone[0] = 1
                elif windows:
                    np.add.at(gone, [w["start"] for w in windows], 1)
                    np.add.at(gone, [w["start"] + w["n"] + width - 1 for w in windows], -1)
                gone = np.cumsum(gone)[:-1] > 0
                sizes.append(len(symbols))
                removed.append([{"start": s, "length": m} for s, m in spans(gone)])
                shas.append(hashlib.sha256(alphabet.join(parts, ~gone)).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(shas, pa.string())], ["k1", "k2", "n_symbols", "removed", "kept_sha256"])

    kept = texts.join(reports, ["k1", "k2"], "left").select("k1", "k2", "text", "n", "windows")
    kept = kept.mapInArrow(remove, "k1 long, k2 long, n_symbols long, removed array<struct<start: int, length: int>>, kept_sha256 string")
    return d.select("id", "k1", "k2").join(kept, ["k1", "k2"]).select(F.col("id").alias("doc_id"), "n_symbols", "removed", "kept_sha256")
