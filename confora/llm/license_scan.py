"""License detection by ordered signature rules behind a keyword prefilter.

A text is lower-cased in A-Z and read as words of digits, letters and anything beyond ASCII. Base detections are the places of the
fixed phrases. The rules of ``license_rules.py`` are regular expressions over the words joined by one space, matched at whole words, leftmost and
non-overlapping per rule. One Aho-Corasick pass over a text finds the keywords in it, and only rules whose keyword occurs are run.

Detections are resolved in order of priority: tier, then length (longer first), then rule, then place. One that is contained in an accepted detection,
or overlaps it, is suppressed. The labels of a text are those of its base places, which always stay, and of its accepted detections; the score is
the best confidence among them, 0 without any.

Each text is read on its own, whole, in a map without shuffles. Nulls are empty texts; ids of any type, null and repeated ones included, are carried along,
one row for each input row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed
from .license_rules import PHRASES, TIERS

#: A-Z to a-z, bytes that are in no word to spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What ``~`` stands for in a rule.
GAP = r"(?:[^ ]+ ){0,3}"


class Rule(NamedTuple):
    label: str
    keyword: str
    expression: re.Pattern
    tier: int
    confidence: float


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    rule: int
    confidence: float


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    out = []
    for tier, (confidence, lines) in enumerate(TIERS):
        for line in lines.strip().splitlines():
            label, keyword, expression = (x.strip() for x in line.split(" | "))
            out.append(Rule(label, keyword, re.compile(f"(?<![^ ])(?:{expression.replace('~ ', GAP)})(?![^ ])"), tier, confidence))
    return tuple(out)


@lru_cache(maxsize=1)
def prefilter():
    """An automaton of all keywords, each with the numbers of its rules."""
    import ahocorasick

    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by_keyword.setdefault(r.keyword, []).append(i)
    found = ahocorasick.Automaton()
    for keyword, numbers in by_keyword.items():
        found.add_word(keyword, tuple(numbers))
    found.make_automaton()
    return found


def word_string(text: bytes) -> str:
    """The words joined by one space; bytes beyond ASCII stand for themselves, so that lengths are those of UTF-8."""
    return b" ".join(text.translate(WORD_BYTES).split()).decode("latin-1")


def matches(words: str) -> list[Detection]:
    """Every match of every rule whose keyword occurs, with places in words."""
    due = set().union(*(numbers for _, numbers in prefilter().iter(words)))
    found = [(m.start(), m.end(), i) for i in sorted(due) for m in rules()[i].expression.finditer(words)]
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(words.encode("latin-1"), np.uint8) == 32)
    starts = np.searchsorted(spaces, [f[0] for f in found]).tolist()
    ends = (np.searchsorted(spaces, [f[1] for f in found]) + 1).tolist()
    return [Detection(s, e, rules()[i].label, i, rules()[i].confidence) for s, e, (_, _, i) in zip(starts, ends, found)]


def resolved(found: list[Detection]) -> list[Detection]:
    """Those that remain, in order of place."""
    if not found:
        return []
    first, taken = min(d.start for d in found), bytearray(max(d.end for d in found) - min(d.start for d in found))
    kept = []
    for d in sorted(found, key=lambda d: (rules()[d.rule].tier, d.start - d.end, d.rule, d.start)):
        if not any(taken[d.start - first : d.end - first]):
            taken[d.start - first : d.end - first] = b"\1" * (d.end - d.start)
            kept.append(d)
    return sorted(kept)


def phrase_places(words: str) -> list[tuple[int, str]]:
    """(word, label) of every place of a phrase."""
    padded, out = f" {words} ", []
    for phrase, label in PHRASES:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    if not out:
        return []
    spaces = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), np.uint8) == 32)
    return sorted(zip(np.searchsorted(spaces, [at for at, _ in out]).tolist(), (label for _, label in out)))


KIND = "n_words long, base array<struct<word: int, label: string>>, detections array<struct<start: int, end: int, label: string, rule: int, confidence: double>>"
ARROW = [
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())]))),
    ("detections", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rule", pa.int32()), ("confidence", pa.float64())]))),
]


def license_detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, detections): places of the fixed phrases and accepted detections of the rules, in words from 0, end exclusive."""
    d = renamed(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            n, base, found = [], [], []
            for text in b.column(1):
                words = word_string(text.as_py())
                n.append(words.count(" ") + 1 if words else 0)
                base.append([{"word": w, "label": x} for w, x in phrase_places(words)])
                found.append([x._asdict() for x in resolved(matches(words))])
            columns = [b.column(0), *(pa.array(c, kind) for c, (_, kind) in zip((n, base, found), ARROW))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(name for name, _ in ARROW)])

    text = F.coalesce("text", F.lit("")).cast("binary")
    return d.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {KIND}")
