"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND, overlap verification.

The index is over the benchmark items and is broadcast; a benchmark beyond a checked size is indexed in parts, each
below it and each with the statistics of the whole, and the union of the parts' hits is the result. Every passage
of every training document is a query. Scores are BM25 divided by the item's own score (1.0: all of
the item's terms are there), so one threshold fits short and long items. Retrieval is exact:

* texts are cut into chunks of as many words as the longest item has; a query passage is two
  adjacent chunks, so every occurrence of an item lies within one passage;
* block maxima give an upper bound for each (passage, item block) in one vectorised pass; passages
  whose bounds stay below the threshold in every block cannot hold a hit;
* the rest run document-at-a-time WAND: pivots by the terms' maxima, then block maxima, then scores.

A hit is verified on word n-grams of the item's question and of its answer: both must overlap. With
one text column the last sentence is the answer, the rest the question, and it is enough that the item
as a whole overlaps. Parts of so few n-grams that one edited word could fail them are also compared by
word edit distance to the nearest stretch of the passage.

Nulls and texts without words neither query nor match; repeated items are hits of their own; ids may be
null or repeated and are carried along, a row of hits for each document row; very long texts are read whole; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import renamed, written

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK = 4
#: Bytes of benchmark text that are indexed and broadcast at once.
PART_BYTES = 8 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, if there is more than one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if WORD.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class Index:
    """Postings in item order with normalised impacts, cut into blocks with their maxima."""

    def __init__(self, items: list[tuple], k1: float = K1, b: float = B, block: int = BLOCK, whole: tuple[int, float, dict] | None = None):
        """``whole``: number of items, their mean length and document frequencies, where ``items`` are a part of them."""
        self.ids = [i for i, _, _ in items]
        self.parts = [(words(q), words(a)) for _, q, a in items]
        full = self.full = [q + a for q, a in self.parts]
        n, mean = max(1, len(full)), sum(map(len, full)) / max(1, len(full)) or 1.0
        tf = [Counter(x) for x in full]
        df = Counter(t for c in tf for t in c)
        if whole:
            n, mean, df = whole
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.longest = max(map(len, full), default=0)
        postings: dict[str, list] = {}
        for i, c in enumerate(tf):
            norm = k1 * (1 - b + b * len(full[i]) / mean)
            w = {t: idf[t] * f * (k1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(w.values())
            for t, x in w.items():
                postings.setdefault(t, []).append((i, x / own))
        self.term = {t: k + 1 for k, t in enumerate(postings)}  # 0: not in the index
        self.items = [[], *([i for i, _ in p] for p in postings.values())]
        self.impact = [[], *([x for _, x in p] for p in postings.values())]
        self.top = [0.0, *(max(x for _, x in p) for p in postings.values())]
        self.block = block
        self.n_blocks = -(-len(items) // block) if items else 1
        self.blockmax: list[dict[int, float]] = []
        for its, xs in zip(self.items, self.impact, strict=True):
            m: dict[int, float] = {}
            for i, x in zip(its, xs, strict=True):
                m[i // block] = max(m.get(i // block, 0.0), x)
            self.blockmax.append(m)
        # the same maxima, rounded up, over at most 64 groups of blocks: the vectorised bound
        self.groups = min(64, self.n_blocks)
        self.bound = np.zeros((len(self.term) + 1, self.groups), np.float32)
        for t, m in enumerate(self.blockmax):
            for g, x in m.items():
                at = g * self.groups // self.n_blocks
                self.bound[t, at] = max(self.bound[t, at], np.nextafter(np.float32(x), np.float32(2)))

    def wand(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """All items scoring >= threshold, by block-max WAND."""
        slack = threshold - 1e-9
        lists = [[self.items[t][0], 0, t] for t in terms if t]
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            g = item // self.block
            if sum(self.blockmax[x[2]].get(g, 0.0) for x in lists[: pivot + 1]) < slack:
                # nothing in this block: on to its end, or to the next list's item
                to = (g + 1) * self.block
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0])
                to, move = max(to, item + 1), lists[: pivot + 1]
            elif lists[0][0] == item:
                score = sum(self.impact[t][p] for i, p, t in lists[: pivot + 1] if i == item)
                if score >= slack:
                    found.append((item, score))
                to, move = item + 1, lists[: pivot + 1]
            else:
                to, move = item, [x for x in lists[:pivot] if x[0] < item]
            for x in move:
                if x[0] < to:
                    its = self.items[x[2]]
                    x[1] = bisect.bisect_left(its, to, x[1] + 1)
                    x[0] = its[x[1]] if x[1] < len(its) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found


def overlap(part: list[str], passage: list[str], n: int) -> float:
    """The share of the part's n-grams that the passage has."""
    if not part:
        return 1.0
    n = min(n, len(part))
    grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(grams & there) / len(grams)


def edit_similarity(part: list[str], passage: list[str]) -> float:
    """1 - (word edits to the nearest stretch of the passage) / words of the part."""
    row = np.arange(len(part) + 1)
    steps, best, at = row.copy(), len(part), {}
    for x in set(passage):
        at[x] = np.array([w != x for w in part], np.int64)
    for x in passage:
        new = np.empty_like(row)
        new[0] = 0
        new[1:] = np.minimum(row[:-1] + at[x], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, int(row[-1]))
    return 1 - best / len(part)


def tolerant_overlap(part: list[str], passage: list[str], n: int, least: float) -> float:
    """``overlap``, or the edit similarity if that is larger and one edited word could bring the overlap below ``least``."""
    found = overlap(part, passage, n)
    grams = len(part) - n + 1
    if found >= least or grams - n >= least * grams > 0:
        return found
    there = set(passage)
    # words that are not in the passage are edits in any case
    return max(found, edit_similarity(part, passage)) if sum(x in there for x in part) >= least * len(part) else found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    question_col: str = "text", answer_col: str | None = None, threshold: float = 0.5, min_overlap: float = 0.8, ngram: int = 5,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each verified hit of a document, with its best passage's score.

    Without ``answer_col`` either overlap may be below ``min_overlap`` where that of the whole item is not.
    """
    spark = docs.sparkSession
    if answer_col:
        b = renamed(benchmark, i=item_col, q=question_col, a=answer_col)
    else:
        b = renamed(benchmark, i=item_col, q=question_col).withColumn("a", F.lit(None).cast("string"))
    d = renamed(docs, id=id_col, text=text_col)
    found = [hits_of(d, index, bool(answer_col), b.schema["i"].dataType.simpleString(), threshold, min_overlap, ngram) for index in indexes(b, bool(answer_col), part_bytes)]
    return functools.reduce(DataFrame.unionAll, found)


def item_parts(question: str | None, answer: str | None, answered: bool) -> tuple[str, str]:
    return (question or "", answer or "") if answered else split_answer(question or "")


def indexes(benchmark: DataFrame, answered: bool, part_bytes: int):
    """The index of ``benchmark`` (i, q, a), or those of its parts; at least one."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    n_parts = -(-2 * size // part_bytes) if size > part_bytes else 1
    if n_parts == 1:
        rows = [(r.i, *item_parts(r.q, r.a, answered)) for r in benchmark.collect()]
        yield spark.sparkContext.broadcast(Index([x for x in rows if words(x[1]) or words(x[2])]))
        return
    parts = written(benchmark.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(n_parts)).cast("int")), "benchmark")

    def terms(batches):
        for batch in batches:
            texts = [item_parts(q, a, answered) for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            own = [words(q) + words(a) for q, a in texts]
            of = [p for p, w in zip(batch.column(2).to_pylist(), own, strict=True) if w]
            own = [w for w in own if w]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([len(w) for w in own], pa.int64()), pa.array([sorted(set(w)) for w in own], pa.list_(pa.string()))], ["part", "n", "terms"])

    of = written(parts.select("q", "a", "part").mapInArrow(terms, "part int, n long, terms array<string>"), "terms")
    n, total = of.agg(F.count("*"), F.sum("n")).first()
    each = of.select("part", F.explode("terms").alias("term"))
    df = written(each.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    for part in range(n_parts):
        rows = [(r.i, *item_parts(r.q, r.a, answered)) for r in parts.where(F.col("part") == part).collect()]  # part_bytes of text, about
        rows = [x for x in rows if words(x[1]) or words(x[2])]
        known = dict(map(tuple, each.where(F.col("part") == part).select("term").distinct().join(df, "term").collect()))
        yield spark.sparkContext.broadcast(Index(rows, whole=(n, total / n, known) if rows else None))


def hits_of(d: DataFrame, shared, answered: bool, item_kind: str, threshold: float, min_overlap: float, ngram: int) -> DataFrame:
    """The verified hits of documents (id, text) on one index."""

    def run(batches):
        index = shared.value
        get, w, bound, n_terms = index.term.get, max(index.longest, 1), index.bound, len(index.bound)
        for batch in batches:
            out = []
            for at, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                ws = words(text)
                if not ws or not index.ids:
                    continue
                terms = np.fromiter((get(x, 0) for x in ws), np.int64, len(ws))
                once = np.unique(np.arange(len(ws)) // w * n_terms + terms)
                chunk_of = once // n_terms
                chunk = np.add.reduceat(bound[once % n_terms], np.searchsorted(chunk_of, np.arange(chunk_of[-1] + 1)), axis=0)
                pair = chunk.copy()
                pair[:-1] += chunk[1:]
                best: dict[int, tuple] = {}
                for k in np.nonzero(pair.max(axis=1) >= threshold * 0.9999)[0]:
                    lo, hi = k * w, (k + 2) * w
                    query = np.unique(terms[lo:hi])  # a term of both chunks counts once
                    if bound[query].sum(axis=0).max() < threshold * 0.9999:
                        continue
                    for item, score in index.wand(set(query.tolist()), threshold):
                        if item in best and best[item][0] >= score:
                            continue
                        found = tuple(tolerant_overlap(x, ws[lo:hi], ngram, min_overlap) for x in index.parts[item])
                        if min(found) >= min_overlap or (not answered and tolerant_overlap(index.full[item], ws[lo:hi], ngram, min_overlap) >= min_overlap):
                            best[item] = (score, *found)
                out += [(at.as_py(), index.ids[i], *x) for i, x in sorted(best.items())]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [batch.schema.field(0).type, items, pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    items = to_arrow_type(_parse_datatype_string(item_kind))
    return d.mapInArrow(run, f"doc_id {d.schema['id'].dataType.simpleString()}, item_id {item_kind}, score double, question_overlap double, answer_overlap double")
