"""Toxicity scores of text that was restored by a noisy-channel decoder.

1. A character trigram model is counted over all documents (dense counts per task, summed by Spark).
2. Suspicious tokens (leetspeak, letters kept apart by spaces or signs, letters repeated three times
   and more) become lattices: every sign may stand for itself or for letters, separators may go, a run
   of a letter may be one, two or all of them. Viterbi decoding under the character model picks
   the restored token.
3. The restored text is scored by a model of words and word beginnings, fitted on labelled rows whose
   crc32(doc_id) mod 5 is not 0: weights are lower confidence bounds of log odds, and a logistic
   regression over the sum of the three largest gives the score, so evidence only ever adds.

The classifier is fitted on at most FIT_ROWS labelled rows (those with the smallest hash of their id);
everything else covers all rows. Nulls and empty texts are scored like texts without words; labels
that are null are unlabelled and of contradicting ones the toxic one counts; without labels of both
kinds every score is 0; rows with a null id are scored and never held out; repeated rows give a row
each, and of rows that share an id one (the least text) is a training row; very long texts and tokens are
read whole; an empty table gives an empty result; extra columns are ignored.

Every step but the joining of letters kept apart by spaces looks at one token between white space at a time, so
a task reads each distinct token once: almost all are plain and without weight, and a text costs a set difference.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from .common import renamed, written
from .hashing import word_hashes

FIT_ROWS = 20_000
BUCKETS = 1 << 20
LEAST_WEIGHT = 0.5
RIDGE = 0.002
#: What each sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Costs of the channel, as natural logarithms.
KEEP_SIGN, READ_SIGN, DROP_SEPARATOR, ONE_OF_RUN, TWO_OF_RUN, ALL_OF_RUN = -6.0, -1.0, -0.5, -0.5, -1.5, -4.0
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
EDGE, OTHER, N_CLASSES = len(LETTERS), len(LETTERS) + 1, len(LETTERS) + 2
CLASS = np.full(0x110000, OTHER, np.uint8)
CLASS[[ord(c) for c in LETTERS]] = range(len(LETTERS))
for _c in " \t\r\n.,;:?\"'()[]{}":
    CLASS[ord(_c)] = EDGE
WORD = re.compile(r"\w+")
SIGNS = "".join(LEET)
#: Whole tokens that hold a sign; all digits are signs. Tokens start only where none runs on, and no loop backtracks.
LEET_TOKEN = re.compile(f"(?<![\\w{re.escape(SIGNS)}])[^\\W0-9]*+[{re.escape(SIGNS)}][\\w{re.escape(SIGNS)}]*+")
RUN = re.compile(r"([^\W\d_])\1\1")
REST = re.compile(r"\w*")
SPACED_TOKEN = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\w)")
SEPARATORS = " .-_*"
#: Signs that also end sentences.
CLOSING = "!"
#: Results remembered per task, and the longest token among them; longer ones are decoded each time.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64


def classes(text: str) -> np.ndarray:
    return CLASS[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]


#: Characters counted at once.
AT_ONCE = 1 << 20


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): character trigram counts of ``text`` over all rows; at most N_CLASSES cubed."""

    def run(batches):
        total = np.zeros(N_CLASSES**3, np.int64)

        def add(texts):
            c = classes("\n\n".join(["", *texts, ""])).astype(np.int32)
            for lo in range(0, len(c) - 2, AT_ONCE):
                x = c[lo : lo + AT_ONCE + 2]
                total[:] += np.bincount((x[:-2] * N_CLASSES + x[1:-1]) * N_CLASSES + x[2:], minlength=len(total))

        for b in batches:
            held, size = [], 0
            for t in b.column(0):
                if t := t.as_py():
                    held.append(t)
                    size += len(t)
                    if size > AT_ONCE:
                        add(held)
                        held, size = [], 0
            if held:
                add(held)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi over character lattices."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape((N_CLASSES,) * 3).astype(np.float64)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + N_CLASSES)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()
        self.seen: dict[str, str] = {}

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        arcs, i = [], 0
        while i < len(token):
            c = token[i]
            j = i + 1
            while j < len(token) and token[j] == c:
                j += 1
            n = j - i
            if c in SEPARATORS:
                arcs.append([("", DROP_SEPARATOR)])
            else:
                for_c = [(c, 0.0)] if c not in LEET else [(x, READ_SIGN) for x in LEET[c]] + [(c, KEEP_SIGN)]
                if n == 1:
                    arcs.append(for_c)
                elif n == 2:
                    arcs.append([(x + x, p) for x, p in for_c] + [(x, p + TWO_OF_RUN) for x, p in for_c])
                else:
                    arcs.append([(x * k, p + q) for x, p in for_c for k, q in ((1, ONE_OF_RUN), (2, TWO_OF_RUN), (n, ALL_OF_RUN))])
            i = j
        return arcs

    def decode(self, token: str) -> str:
        token = token.lower()
        if (found := self.seen.get(token)) is not None:
            return found
        best = self.likeliest(self.lattice(token))
        if stem := token.rstrip(CLOSING):
            if stem != token:  # closing punctuation may also be just that
                plain = [[(c, 0.0)] for c in stem] if not RUN.search(stem) and not any(c in LEET for c in stem) else self.lattice(stem)
                score, letters = self.likeliest(plain)
                best = max(best, (score, letters + token[len(stem) :]))
        if len(token) <= REMEMBERED_LENGTH:
            if len(self.seen) > REMEMBERED // 4:
                self.seen.clear()
            self.seen[token] = best[1]
        return best[1]

    def likeliest(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """(score, text) of the best path.

        A path's character cost is per letter, so that dropping letters gains nothing by itself. Texts are chains of
        (the chain before, letters), so that a step costs the same however long the token is.
        """
        paths: dict = {(EDGE, EDGE): (0.0, None)}
        for arcs in lattice:
            new: dict = {}
            for (a, b), (score, chain) in paths.items():
                for x, cost in arcs:
                    p, q, s = a, b, score + cost
                    for ch in x:
                        r = int(CLASS[ord(ch)])
                        s += self.log[p][q][r]
                        p, q = q, r
                    if (p, q) not in new or new[p, q][0] < s:
                        new[p, q] = (s, (chain, x))
            paths = new
        score, chain = max(((s + self.log[a][b][EDGE], c) for (a, b), (s, c) in paths.items()), key=lambda x: x[0])
        letters = []
        while chain:
            chain, x = chain
            letters.append(x)
        return score, "".join(reversed(letters))

    def joined(self, text: str) -> str:
        """Letters kept apart, decoded."""
        return SPACED_TOKEN.sub(lambda m: self.decode(m[0]), text)

    def restore(self, text: str) -> str:
        return self.plain(self.joined(text.lower()))

    def plain(self, text: str) -> str:
        """Signs and runs decoded; no match holds white space."""
        text = LEET_TOKEN.sub(lambda m: self.decode(m[0]) if any(c.isalpha() for c in m[0]) else m[0], text)
        return self.without_runs(text)

    def without_runs(self, text: str) -> str:
        """Every word with a run, decoded; words are found outwards from their first run."""
        parts, at = [], 0
        for m in RUN.finditer(text):
            if (lo := m.start()) >= at:
                while lo > at and (text[lo - 1].isalnum() or text[lo - 1] == "_"):
                    lo -= 1
                hi = REST.match(text, m.end()).end()
                parts += text[at:lo], self.decode(text[lo:hi])
                at = hi
        return "".join(parts) + text[at:] if parts else text


def beginnings(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


#: A letter or digit with none beside it: every letter of a SPACED_TOKEN is one, whatever separates them.
SINGLE = re.compile(r"(?<![^\W_])[^\W_](?![^\W_])")
#: Signs around a word that stand for nothing and belong to no word.
AROUND = ".,;:?\"')[]{}%&#*-"


class Reader:
    """Evidence of texts, from what is remembered of their distinct tokens."""

    def __init__(self, decoder: Decoder, weights: dict[int, float]):
        self.decoder, self.weights = decoder, weights
        self.plain: set[str] = set()
        #: token -> (words of positive weight and their weights, whether restoring changes it, its single letters)
        self.special: dict[str, tuple[dict, bool, int]] = {}

    def weight(self, word: str) -> float:
        """The largest weight of the word and its beginnings."""
        get = self.weights.get
        return max([get(xxh64_intdigest(f) % BUCKETS, 0.0) for f in beginnings(word)])

    def learn(self, tokens: list[str]) -> None:
        for t in tokens:
            core = t.strip(AROUND)
            if core.isalpha() and len(core) > 1 and not RUN.search(core):  # most tokens: a word, which restoring leaves alone
                if (w := self.weight(core)) > 0:
                    self.special[t] = ({core: w}, False, 0)
                else:
                    self.plain.add(t)
                continue
            r = self.decoder.plain(t)
            known = {x: w for x in set(WORD.findall(r)) if (w := self.weight(x)) > 0}
            singles = len(SINGLE.findall(t))
            if known or r != t or singles:
                self.special[t] = (known, r != t, singles)
            else:
                self.plain.add(t)

    def kept_apart(self, tokens: list[str]) -> bool:
        """Whether letters may be kept apart: a token with two single letters, or two neighbours with one."""
        n = [x[2] if (x := self.special.get(t)) else 0 for t in tokens]
        return max(n) > 1 or any(map(min, n, n[1:]))

    def read(self, text: str) -> tuple[float, bool]:
        """(sum of the three largest weights of distinct words, whether restoring changes the text)."""
        text, changed = text.lower(), False
        tokens = text.split()
        hits = self.hits(tokens)
        if any(self.special[t][2] for t in hits) and self.kept_apart(tokens):
            joined = self.decoder.joined(text)
            if joined != text:
                changed = True
                hits = self.hits(joined.split())
        found: dict[str, float] = {}
        for t in hits:
            known, c, _ = self.special[t]
            found.update(known)
            changed = changed or c
        if len(self.plain) + len(self.special) > REMEMBERED:
            self.plain.clear(), self.special.clear()
        return sum(sorted(found.values(), reverse=True)[:3]), changed

    def hits(self, tokens: list[str]) -> list[str]:
        rest = set(tokens) - self.plain
        if new := [t for t in rest if t not in self.special]:
            self.learn(new)
        return [t for t in rest if t in self.special]


def buckets(words: list[str]) -> np.ndarray:
    """A row of four buckets for each word: the word and its beginnings, the first repeated where there are fewer."""
    rows = []
    for w in words:
        f = beginnings(w)
        rows += f + f[:1] * (4 - len(f))
    return (word_hashes(rows) % np.uint64(BUCKETS)).astype(np.int32).reshape(-1, 4)


def features(text: str) -> np.ndarray:
    """The buckets of every distinct word."""
    return buckets(sorted(set(WORD.findall(text))))


def bounds(tox, clean, n1, n0):
    """Lower confidence bounds of the log odds, where they are clear; else 0."""
    tox, clean = np.maximum(tox, 0), np.maximum(clean, 0)  # a row left out takes its own count from buckets that others may not have
    odds = np.log((tox + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    low = odds - 1.64 * np.sqrt(1 / (tox + 0.5) + 1 / (clean + 0.5))
    return np.where((tox >= 2) & (low >= LEAST_WEIGHT), low, 0)


def left_out(y: int, rows: np.ndarray, tox: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> float:
    """The evidence in a training row, whose own count must not vouch for it."""
    w = bounds(tox[rows] - y, clean[rows] - (1 - y), n1 - y, n0 - (1 - y)).max(axis=1, initial=0)
    return float(np.sort(w)[-3:].sum())


def calibrated(evidence: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(intercept, slope) of a logistic regression on the evidence."""
    x, b = np.stack([np.ones(len(evidence)), evidence], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ b).clip(-30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        b = b + np.linalg.solve(h, x.T @ (labels - p) - RIDGE * b)
    return b


def free_prefix(columns: list[str]) -> str:
    prefix = ""
    while any((prefix + c) in columns for c in ("held_out", "score", "predicted", "was_obfuscated")):
        prefix += "_"
    return prefix


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", fit_rows: int = FIT_ROWS, keep_columns: bool = False
) -> DataFrame:
    """(doc_id, held_out, score, predicted, was_obfuscated): one row per document.

    With ``keep_columns`` the columns of ``docs`` come first, unchanged, doc_id is left out, and the names of the
    others are preceded by as many underscores as no column of ``docs`` begins with (see ``free_prefix``).
    """
    spark = docs.sparkSession
    d = renamed(docs, id=id_col, text=text_col)
    counts = np.zeros(N_CLASSES**3, np.int64)
    grams = character_counts(d).toPandas()  # bounded by N_CLASSES cubed
    counts[grams["gram"].to_numpy(np.int64)] = grams["n"]
    decoder = spark.sparkContext.broadcast(counts)
    remainder = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    known = renamed(labels, id=label_id_col, y=label_col).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    taken = written(known.where(remainder(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id").limit(fit_rows), "taken")  # at most fit_rows ids, so it may be broadcast
    fit = d.join(F.broadcast(taken), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))

    def training(batches):
        dec = Decoder(decoder.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [features(dec.restore(t.as_py() or "")).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["y", "words"])

    rows = written(fit.select(F.col("y").cast("int").alias("y"), "text").mapInArrow(training, "y int, words binary"), "training")

    def training_rows(batches):
        for b in batches:
            for y, f in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield y, np.frombuffer(f.as_py(), np.int32).reshape(-1, 4)

    def count_features(batches):
        """Dense counts per task; the last bucket counts rows."""
        tox, n = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for y, f in training_rows(batches):
            once = np.append(np.unique(f), BUCKETS)
            n[once] += 1
            tox[once] += y
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(tox[at]), pa.array(n[at])], ["bucket", "tox", "n"])

    # buckets of fewer than two toxic rows never weigh anything; at most BUCKETS rows come back
    tox, clean = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    c = rows.mapInArrow(count_features, "bucket int, tox long, n long").groupBy("bucket").agg(F.sum("tox").alias("tox"), F.sum("n").alias("n"))
    c = c.where((F.col("tox") > 1) | (F.col("bucket") == BUCKETS)).toPandas()
    at = c["bucket"].to_numpy(np.int64)
    tox[at], clean[at] = c["tox"], c["n"] - c["tox"]
    n1, n0 = int(tox[BUCKETS]), int(clean[BUCKETS])
    weights, coef = np.zeros(BUCKETS, np.float32), np.array([-40.0, 0])
    if n1 and n0:
        counts_of = spark.sparkContext.broadcast((tox[:BUCKETS].astype(np.int32), clean[:BUCKETS].astype(np.int32)))

        def evidence_of(batches):
            out = [(y, left_out(y, f, *counts_of.value, n1, n0)) for y, f in training_rows(batches)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.float64())], ["y", "e"])

        e = rows.mapInArrow(evidence_of, "y int, e double").toPandas().sort_values(["e", "y"])  # two numbers for each training row
        weights = bounds(tox[:BUCKETS], clean[:BUCKETS], n1, n0).astype(np.float32)
        coef = calibrated(e["e"].to_numpy(), e["y"].to_numpy(np.float64))
    at = np.nonzero(weights)[0].astype(np.int32)
    model = spark.sparkContext.broadcast((at, weights[at], coef))

    def ready():
        at, w, coef = model.value
        return Reader(Decoder(decoder.value), dict(zip(at.tolist(), w.tolist(), strict=True))), *coef.tolist()

    def score(batches, state=None):
        reader, c0, c1 = state or ready()
        for b in batches:
            scores, changed = [], []
            for t in b.column(2):
                s, restored = reader.read(t.as_py() or "")
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * s)))))
                changed.append(restored)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(changed, pa.bool_())], ["doc_id", "held_out", "score", "predicted", "was_obfuscated"])

    held = F.coalesce(remainder(F.col("id")) == 0, F.lit(False))
    added = "held_out boolean, score double, predicted int, was_obfuscated boolean"
    if not keep_columns:
        return d.select("id", held.alias("held_out"), "text").mapInArrow(score, f"doc_id {d.schema['id'].dataType.simpleString()}, {added}")

    prefix = free_prefix(docs.columns)
    at, n = docs.columns.index(text_col), len(docs.columns)
    own = docs.select("*", F.coalesce(remainder(F.col(f"`{id_col}`")) == 0, F.lit(False)).alias(f"{prefix}held_out"))

    def beside(batches):
        state = ready()
        for b in batches:
            slim = pa.RecordBatch.from_arrays([b.column(n), b.column(n), b.column(at)], ["id", "held_out", "text"])
            out = next(score(iter([slim]), state))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + [out.column(i) for i in range(1, 5)], b.schema.names[:n] + [prefix + x for x in out.schema.names[1:]])

    extra = own.sparkSession.createDataFrame([], added).schema.fields
    return own.mapInArrow(beside, StructType([*docs.schema.fields, *(StructField(prefix + f.name, f.dataType) for f in extra)]))
