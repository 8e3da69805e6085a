"""Token counts by heap-and-linked-list byte-pair merging.

A pretoken's bytes start as a doubly linked list of symbols. A heap holds (rank, position) of
every adjacent pair that the vocabulary can merge; the lowest is popped, checked against the list
(pairs that changed meanwhile are stale) and merged. The count is initial symbols minus merges;
no identifiers are emitted. Pretokens repeat, so each Python worker remembers counts of those it
has seen, in a table of bounded size.

Nulls count as empty texts (0 tokens), empty texts have 0 tokens, very long pretokens cost
n log n, repeated rows are counted each, an empty table gives an empty result, other columns of
the input are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000
BITS = 24


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << BITS | vocab[b]] = rank << BITS | vocab[a + b]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.seen: dict[str, int] = {}

    def merge_count(self, piece: bytes) -> int:
        """Symbols left after all merges."""
        n = len(piece)
        if n < 2:
            return n
        get, mask = self.merges.get, (1 << BITS) - 1
        sym = [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := get(sym[i] << BITS | sym[i + 1])) is not None:
                heap.append((m >> BITS, i))
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            m = get(sym[i] << BITS | sym[j])
            if m is None or m >> BITS != rank:
                continue
            sym[i], sym[j] = m & mask, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (m := get(sym[i] << BITS | sym[k])) is not None:
                    heapq.heappush(heap, (m >> BITS, i))
            if (h := before[i]) >= 0 and (m := get(sym[h] << BITS | sym[i])) is not None:
                heapq.heappush(heap, (m >> BITS, h))
        return left

    def count(self, text: str, split) -> int:
        total = 0
        parts = [text]
        for s in self.special:  # as the library does by default, a special string is one token
            if s in text:
                cut = [p.split(s) for p in parts]
                total += sum(len(c) - 1 for c in cut)
                parts = [x for c in cut for x in c]
        seen = self.seen
        for part in parts:
            for piece in split(part):
                n = seen.get(piece)
                if n is None:
                    n = seen[piece] = self.merge_count(piece.encode("utf-8"))
                total += n
        if len(seen) > REMEMBERED:
            seen.clear()
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per input row, map-only."""

    def run(batches):
        import regex

        split, c = regex.compile(PATTERN).findall, counter(tokenizer_path)
        for b in batches:
            counts = [c.count(t.as_py(), split) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = renamed(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    return d.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
