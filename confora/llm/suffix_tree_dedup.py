"""Substring dedup over words by prefix-partitioned suffix trees.

Stretches of text that may repeat meet by the anchors of their windows (see ``repeats``). There, the suffixes that start a window
are split by their literal first words: a group of suffixes with the same prefix that is larger than MEMORY is split by one more
word, so prefixes are as long as it takes; small groups side by side are taken together, up to MEMORY. A group's suffixes are sorted, the words that neighbours share are counted, and the tree is
built top-down from these counts, all nodes of a level at a time: an inner node is a range of suffixes with its depth (the words they all
share) and its parent, its edge is the words between the two depths, and suffixes left alone are leaves. Inner nodes of at
least a window's depth are the repeats; their suffixes start one, and runs of such suffixes are the maximal repeats that are removed.

Nulls have no words; texts shorter than a window keep all; matches never cross texts; repeated rows are copies of each other;
null ids are carried along; very long texts are cut nowhere; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .repeats import HOT, Words, repeated_windows

WINDOW = 35
GRAM = 6
#: Suffixes of a group whose tree is built at once.
MEMORY = 50_000


@dataclass
class Tree:
    """Inner nodes, parents before children: their suffixes are ``order[start:end]`` and share ``depth`` words; the root's parent is -1."""

    depth: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray


class Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and which range each is of."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def tree_of(shared: np.ndarray, deepest: int) -> Tree:
    """The tree over sorted suffixes, ``shared[i]`` words being common to the i-th and the one before; nodes of ``deepest`` words are not split."""
    start, end, parent, done, n = np.array([0]), np.array([len(shared)]), np.array([-1]), [], 0
    if len(shared) < 2:
        start, end, parent = start[:0], end[:0], parent[:0]
    while len(start):
        at, node = ranges(start + 1, end)
        depth = np.minimum.reduceat(shared[at], np.cumsum(end - start - 1) - (end - start - 1))
        done.append((depth, start, end, parent))
        cut = (shared[at] == depth[node]) & (depth[node] < deepest)
        child_start = np.concatenate([start, at[cut]])
        of = np.concatenate([np.arange(len(start)), node[cut]])
        by = np.lexsort((child_start, of))
        child_start, of = child_start[by], of[by]
        child_end = np.append(child_start[1:], 0)
        last = np.append(of[1:] != of[:-1], True)
        child_end[last] = end[of[last]]
        grow = (child_end - child_start > 1) & (depth[of] < deepest)
        start, end, parent, n = child_start[grow], child_end[grow], of[grow] + n, n + len(depth)
    return Tree(*(np.concatenate(x) if done else np.zeros(0, np.int64) for x in (zip(*done, strict=True) if done else [()] * 4)))


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, words shared with the one before) of suffixes given as rows of word numbers."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    per = max(1, 63 // bits)  # words of a sort key
    keys = []
    for j in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for c in rows[:, j : j + per].T:
            key = key << bits | c
        keys.append(key)
    order = np.lexsort(keys[::-1])
    a = rows[order]
    same = a[1:] == a[:-1]
    return order, np.concatenate([[0], np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))]).astype(np.int64)


def deep_nodes(stretches: list[bytes], n_windows: list[int], _, width: int, __, memory: int = MEMORY) -> list[np.ndarray]:
    """Per stretch, which of its first ``n_windows`` suffixes lie in an inner node of at least ``width`` words."""
    number = Numbers()
    words = [np.fromiter(map(number.__getitem__, x.split()), np.int32) for x in stretches]  # of bytes, this splits at the same six characters
    text, size = np.concatenate(words), np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    starts, _ = ranges(first, first + np.array(n_windows))
    flags = np.zeros(len(starts), bool)
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        group, depth = todo.pop()  # suffixes that share their first ``depth`` words
        if len(group) < 2:
            continue
        if depth == width:
            flags[group] = True
        elif len(group) > memory:  # one more word
            word = text[starts[group] + depth]
            by = np.argsort(word, kind="stable")
            group, word = group[by], word[by]
            cut = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1, [len(group)]])
            lo = 0
            for k in range(1, len(cut)):
                if cut[k] - cut[k - 1] > memory:  # a prefix of its own
                    todo += [(group[cut[lo] : cut[k - 1]], depth), (group[cut[k - 1] : cut[k]], depth + 1)]
                    lo = k
                elif cut[k] - cut[lo] > memory:
                    todo.append((group[cut[lo] : cut[k - 1]], depth))
                    lo = k - 1
            todo.append((group[cut[lo] :], depth))
        else:
            order, shared = sorted_suffixes(text[starts[group][:, None] + np.arange(depth, width)])
            tree = tree_of(shared, width - depth)
            deep = tree.depth >= width - depth
            flags[group[order[ranges(tree.start[deep], tree.end[deep])[0]]]] = True
    return np.split(flags, np.cumsum(n_windows)[:-1])


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_symbols, removed, kept_sha256), symbols being words."""
    return repeated_windows(docs, Words, window, min(gram, window), deep_nodes, id_col, text_col, hot)
