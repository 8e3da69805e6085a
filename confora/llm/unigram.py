"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file gives pieces, log scores and kinds. Pieces go into a double-array trie over UTF-8
bytes (``base``, ``check``, ``value``). A text is escaped (space -> U+2581, with the dummy prefix that
the model asks for) and the best path by summed scores is taken, in double precision and with the
earlier start winning ties; a character that no piece covers costs the unknown score and is written
as its bytes. (The public library sums in single precision over the whole text, so where scores
are huge it can return a path with a lower sum.)

No piece crosses from other characters into a whitespace marker, so paths of words are
independent: each distinct word of a batch is decoded once, all of them side by side in numpy, and
Python workers remember words in a table of bounded size. Where a vocabulary has pieces across
markers, whole texts are decoded instead; words of more than LONG bytes are decoded one by one.

Nulls encode like empty texts, to nothing; texts are never cut; empty tables give an empty result;
rows, also repeated ones or with null ids, give one row each; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
LONG = 192
REMEMBERED = 300_000


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: ints, 4 or 8 raw bytes, or byte strings."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class DoubleArrayTrie:
    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = value
        size = len(children) * 2 + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        free, dense, place, todo = 257, 257, {0: 0}, [0]
        for node in todo:
            at = place[node]
            value[at] = ends[node]
            kids = sorted(children[node])
            if not kids:
                continue
            free = used.find(0, free)
            start, low = (free if len(kids) == 1 else used.find(0, dense)), kids[0]
            while any(used[start - low + b] for b in kids):
                start = used.find(0, start + 1)
                if start < 0 or start + 256 >= size:
                    start = size - 256 if start < 0 else start
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    used += bytearray(size)
                    size *= 2
            if start > dense + 2048:
                dense = start - 2048  # below it, siblings rarely find room together
            base[at] = start - low
            for b in kids:
                slot = start - low + b
                used[slot], check[slot] = 1, at
                place[children[node][b]] = slot
                todo.append(children[node][b])
        last = max(i for i in range(size) if used[i]) + 257
        self.base = np.array((base + [0] * 257)[:last], np.int32)
        self.check = np.array((check + [-1] * 257)[:last], np.int32)
        self.value = np.array((value + [-1] * 257)[:last], np.int32)

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that starts at ``at``."""
        node, base, check, value = 0, self.base, self.check, self.value
        for i in range(at, len(data)):
            nxt = base[node] + data[i]
            if check[nxt] != node:
                return
            node = nxt
            if value[node] >= 0:
                yield i + 1, int(value[node])


class Unigram:
    def __init__(self, model: bytes):
        self.pieces, self.kinds, scores = [], [], []
        self.dummy_prefix = self.escape = True
        self.squeeze = True
        for number, v in fields(model):
            if number == 1:
                p = dict(fields(v))
                self.pieces.append(p[1].decode("utf-8"))
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 3:
                spec = dict(fields(v))
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
        if self.squeeze or not self.escape:
            raise ValueError("models that squeeze white space or do not escape it are not supported")
        normal = [s for s, k in zip(scores, self.kinds, strict=True) if k == NORMAL]
        self.low, self.high = min(normal), max(normal)
        self.unknown_score = self.low - UNKNOWN_PENALTY
        self.unknown = self.kinds.index(UNKNOWN)
        keys = {p.encode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
        self.scores = np.array(scores, np.float64)
        for i, k in enumerate(self.kinds):
            if k == USER:
                self.scores[i] = len(self.pieces[i].encode()) * self.high - 0.1
        self.trie = DoubleArrayTrie(keys)
        at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [at.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("the model has no byte fallback")
        texts = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER, UNUSED)]
        crossing = any(MARK in p.lstrip(MARK) for p in texts)
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in texts))
        self.words = re.compile("(?s).+" if crossing else f"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        first = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes_of = [
            first[i] if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
        ]

    def escaped(self, text: str) -> str:
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK) if text else ""

    # one word at a time
    def best_path(self, data: bytes) -> list[int]:
        n = len(data)
        best, start, piece = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            if best[at] is None:
                continue
            b = data[at]
            char = at + (1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4)
            covered = False
            for end, i in self.trie.prefixes(data, at):
                if self.kinds[i] == UNUSED:
                    continue
                s = self.scores[i] + best[at]
                if best[end] is None or s > best[end]:
                    best[end], start[end], piece[end] = s, at, i
                covered |= end == char
            if not covered:
                s = self.unknown_score + best[at]
                if best[char] is None or s > best[char]:
                    best[char], start[char], piece[char] = s, at, self.unknown
        return self.back(data, start, piece)

    def back(self, data: bytes, start, piece) -> list[int]:
        out, at = [], len(data)
        while at > 0:
            i, s = piece[at], start[at]
            out += [self.byte_ids[b] for b in reversed(data[s:at])] if i == self.unknown else [i]
            at = s
        return out[::-1]

    # many words side by side
    def best_paths(self, words: list[bytes]) -> list[list[int]]:
        """Paths of words of at most LONG bytes, walking the trie for all of them at once."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        found: list = [None] * len(words)
        for lo in range(0, len(order), 16384):
            some = order[lo : lo + 16384]
            for i, path in zip(some, self._side_by_side([words[i] for i in some]), strict=True):
                found[i] = path
        return found

    def _side_by_side(self, words: list[bytes]) -> list[list[int]]:
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 5), np.int16), np.zeros((n, width + 5), np.int32)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        usable = np.array([k != UNUSED for k in self.kinds])
        for at in range(width):
            rows = np.nonzero((size > at) & (best[:, at] > -np.inf))[0]
            if not len(rows):
                continue
            here = data[rows, at]
            char = at + 1 + (here >= 192) + (here >= 224).astype(int) + (here >= 240)
            covered = np.zeros(n, bool)
            end_of_char = np.zeros(n, int)
            end_of_char[rows] = char
            live, node = rows, np.zeros(len(rows), np.int32)
            for i in range(at, width):
                nxt = base[node] + data[live, i]
                ok = (check[nxt] == node) & (size[live] > i)
                live, node = live[ok], nxt[ok]
                if not len(live):
                    break
                v = value[node]
                hit = v >= 0
                if hit.any():
                    w, p = live[hit], v[hit]
                    fine = usable[p]
                    w, p = w[fine], p[fine]
                    s = scores[p] + best[w, at]
                    better = s > best[w, i + 1]
                    w, p = w[better], p[better]
                    best[w, i + 1], start[w, i + 1], piece[w, i + 1] = s[better], at, p
                    every = live[hit][fine]
                    covered[every[end_of_char[every] == i + 1]] = True
            bare = rows[~covered[rows]]
            if len(bare):
                end = end_of_char[bare]
                s = self.unknown_score + best[bare, at]
                better = s > best[bare, end]
                w, end = bare[better], end[better]
                best[w, end], start[w, end], piece[w, end] = s[better], at, self.unknown
        return [self.back(w, start[i].tolist(), piece[i].tolist()) for i, w in enumerate(words)]

    def encode_all(self, texts: list[str], seen: dict[str, bytes]) -> list[np.ndarray]:
        split = [self.words.findall(self.escaped(t)) for t in texts]
        new = list({w for ws in split for w in ws if w not in seen})
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        for i, path in zip(short, self.best_paths([raw[i] for i in short]), strict=True):
            seen[new[i]] = np.array(path, np.int32).tobytes()
        for i, w in enumerate(raw):
            if len(w) > LONG:
                seen[new[i]] = np.array(self.best_path(w), np.int32).tobytes()
        get = seen.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.int32) for ws in split]

    def decode(self, ids) -> str:
        """The text of piece ids: markers become spaces, byte pieces bytes, and the dummy prefix goes."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", texts_per_step: int = 512) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, pieces, round_trip): round_trip tells whether decoding gives the text again."""
    with open(model_path, "rb") as f:
        model = Unigram(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB: the model file's own size bounds it

    def run(batches):
        m = shared.value
        is_byte = np.array([k == BYTE for k in m.kinds])
        for b in batches:
            for lo in range(0, b.num_rows, texts_per_step):
                part = b.slice(lo, texts_per_step)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = m.encode_all(texts, _seen)
                same = [m.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                ends = np.cumsum([0, *map(len, ids)])
                n_byte = np.diff(np.concatenate([[0], np.cumsum(is_byte[flat])])[ends])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(n_byte, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(same)],
                    ["doc_id", "n_pieces", "n_byte_pieces", "pieces", "round_trip"],
                )
                if len(_seen) > REMEMBERED:
                    _seen.clear()

    d = renamed(docs, id=id_col, text=text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['id'].dataType.simpleString()}, n_pieces long, n_byte_pieces long, pieces array<int>, round_trip boolean")


#: Words that have been decoded; it travels with the function, so it lives for one task.
_seen: dict[str, bytes] = {}
