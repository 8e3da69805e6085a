"""Substring dedup over bytes by induced sorting of suffixes with their common prefixes.

As in induced suffix sorting, a sample of the suffixes is sorted and the others are induced from it. The sample are the anchors of windows
(locally least, as LMS positions are, but by a hash of ``gram`` bytes; see ``repeats``): Spark's disk-backed sort, an external
priority queue, brings the stretches around equal anchors together from all tasks, and hands them over anchor by anchor, so that a shard
may be far larger than memory. There

1. the sample suffixes of an anchor are sorted by their bytes, with the common-prefix value of each and the one before;
2. the suffixes one byte further to the left are induced: the queue holds a tuple (byte to the left, rank of the suffix to its right) for
   each, in that order they are ranked, and the common-prefix value of two neighbours is one more than the least value
   between the ranks that they were induced from, or none if their bytes differ;
3. so on, recursively, as far left as windows of this anchor begin. A suffix whose common prefix can no longer reach a window's width
   with any other leaves the queue.

A suffix that starts a window and has a common prefix of at least a window with a neighbour that starts one too is repeated.
Bytes are compared literally.

Nulls are empty; texts shorter than a window keep all; matches never cross texts; repeated rows are
copies of each other; null ids are carried along; very long texts are cut nowhere; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .hashing import Fingerprints
from .repeats import BYTE_CODE, HOT, Bytes, repeated_windows

WINDOW = 400
GRAM = 32


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo + 1 : hi + 1]) for each pair lo < hi."""
    if not len(lo):
        return np.zeros(0, np.int64)
    return np.minimum.reduceat(np.append(values, 0), np.stack([lo + 1, hi + 1], axis=1).ravel())[::2]


class Queue:
    """Suffixes of equal offset to their anchors, in order, each with the common prefix of itself and the one before."""

    def __init__(self, group: np.ndarray, item: np.ndarray, shared: np.ndarray):
        self.group, self.item, self.shared = group, item, shared

    def kept(self, keep: np.ndarray) -> Queue:
        at = np.nonzero(keep)[0]
        shared = np.zeros(len(at), np.int64)
        shared[1:] = least_between(self.shared, at[:-1], at[1:])
        return Queue(self.group[at], self.item[at], shared)

    def longest(self) -> np.ndarray:
        """The longest common prefix of each with any other: that with a neighbour."""
        return np.maximum(self.shared, np.append(self.shared[1:], 0)) if len(self.shared) else self.shared

    def induced(self, left: np.ndarray) -> Queue:
        """The suffixes one symbol further to the left, which is ``left``."""
        key = self.group * 512 + left
        by = np.argsort(key, kind="stable")  # tuples (group, symbol, rank)
        key, shared = key[by], np.zeros(len(by), np.int64)
        same = np.nonzero(key[1:] == key[:-1])[0]
        shared[same + 1] = 1 + least_between(self.shared, by[same], by[same + 1])
        return Queue(self.group[by], self.item[by], shared)


def sample_suffixes(text: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, width: int) -> Queue:
    """The sample sorted within its groups by ``width`` bytes at most, ``size`` of which belong to it."""
    columns = -(-width // 4) * 4
    rows = np.zeros((len(at), columns), ">u2")
    for j in range(0, columns, 64):
        upto = min(j + 64, columns)
        place = at[:, None] + np.arange(j, upto)
        rows[:, j:upto] = np.where(np.arange(j, upto) < size[:, None], text[np.minimum(place, len(text) - 1)].astype(np.uint16) + 1, 0)
    packed = rows.view(">u8").astype(np.uint64)
    by = np.lexsort((*packed.T[::-1], group))
    same = rows[by[1:]] == rows[by[:-1]]
    shared = np.zeros(len(by), np.int64)
    shared[1:] = np.where(same.all(axis=1), width, np.minimum(same.argmin(axis=1), width))
    group = group[by]
    shared[1:][group[1:] != group[:-1]] = 0
    return Queue(group, by, shared)


def induced_repeats(stretches: list[bytes], n_windows: list[int], anchors: np.ndarray, width: int, k: int) -> list[np.ndarray]:
    """Per stretch, which of its first ``n_windows`` suffixes share ``width`` bytes with another one. All windows of a stretch have its anchor."""
    data = b"".join(stretches)
    text = np.frombuffer(data, np.uint8)
    size, windows = np.array([len(x) for x in stretches]), np.array(n_windows)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    grams = Fingerprints(BYTE_CODE[text]).all(k)
    at = np.nonzero(grams == anchors[of[: len(grams)]])[0]
    at = at[at + k <= (first + size)[of[at]]]
    run = of[at]
    # an anchor's windows: those that start after the anchor before it, and whose first anchor it is
    before = np.concatenate([[-1], at[:-1]])
    before[np.concatenate([[True], run[1:] != run[:-1]])] = -1
    from_ = np.maximum.reduce([first[run], before + 1, at - (width - k)])
    to = np.minimum(at, first[run] + windows[run] - 1)
    has = from_ <= to
    at, run, least, most = at[has], run[has], (at - to)[has], (at - from_)[has]  # offsets of its windows
    _, group = np.unique(anchors[run], return_inverse=True)
    queue = sample_suffixes(text, at, np.minimum((first + size)[run] - at, width), group.astype(np.int64), width)
    flags = np.zeros(len(text), bool)
    offset = 0
    while len(queue.item):
        item = queue.item
        starts = (least[item] <= offset) & (offset <= most[item])
        here = queue if starts.all() else queue.kept(starts)
        flags[at[here.item[here.longest() >= width]] - offset] = True
        # one more symbol to the left adds one at most to a common prefix
        queue = queue.kept((most[item] > offset) & (queue.longest() + most[item] - offset >= width))
        offset += 1
        if len(queue.item):
            queue = queue.induced(text[at[queue.item] - offset].astype(np.int64))
    return [flags[f : f + n] for f, n in zip(first.tolist(), n_windows, strict=True)]


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_symbols, removed, kept_sha256), symbols being UTF-8 bytes."""
    return repeated_windows(docs, Bytes, window, min(gram, window), induced_repeats, id_col, text_col, hot)
