"""License rules: the prefilter loses nothing, overlaps resolve as stated, and the query equals a loop."""

import random
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from confora.llm.license_rules import PHRASES
from confora.llm.license_scan import license_detections, matches, resolved, rules, word_string
from confora.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned_plainly(text):
    """Every rule on every text; suppression by comparing all pairs of intervals in order of priority."""
    words = plain_words(text)
    joined = " ".join(words)
    base = sorted((i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found = []
    for i, r in enumerate(rules()):
        for m in r.expression.finditer(joined):
            start = joined[: m.start()].count(" ")
            found.append((r.tier, -(m.group().count(" ") + 1), i, start, start + m.group().count(" ") + 1, r))
    kept = []
    for d in sorted(found, key=lambda d: d[:4]):
        if all(d[4] <= k[3] or k[4] <= d[3] for k in kept):
            kept.append(d)
    labels = {label for _, label in base} | {d[5].label for d in kept}
    score = 1.0 if base else max((d[5].confidence for d in kept), default=0.0)
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def test_there_are_hundreds_of_rules_in_order():
    tiers = [r.tier for r in rules()]
    assert len(rules()) > 250 and tiers == sorted(tiers) and all(r.keyword and r.label for r in rules())


@pytest.mark.parametrize("tier", range(5))
def test_every_match_contains_its_keyword(tier):
    """Random strings of each expression: the prefilter never hides a match."""
    for rule in (r for r in rules() if r.tier == tier):
        inner = rule.expression.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")

        @settings(max_examples=8, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(inner, re.ASCII), fullmatch=True))
        def holds(text):
            if rule.expression.fullmatch(text):
                assert rule.keyword in text, (rule, text)

        holds()


def labels(text):
    return [d.label for d in resolved(matches(word_string(text.encode())))]


def test_known_notices():
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert labels("SPDX-License-Identifier: GPL-2.0-only") == ["gpl-2.0-only"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["unknown-license", "apache-2"]
    assert labels("Released under the MIT License, see https://opensource.org/licenses/MIT.") == ["mit", "mit"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("https://creativecommons.org/licenses/by-nc-sa/4.0/") == ["cc-by-nc-sa-4.0"]
    assert labels("CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"]
    assert labels("Dual-licensed under MIT and LGPL-3.0-or-later") == ["mit", "lgpl-3.0-or-later"]  # the hint overlaps a rule of a better tier
    assert labels("a permit to licence unsplash, commit licenses") == []


def test_a_contained_detection_goes():
    """The name inside a notice of a better tier, the abbreviation inside a longer name, the hint beside both."""
    text = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    assert len(matches(word_string(text.encode()))) >= 3
    assert labels(text) == ["apache-2"]


TEXTS = [
    None, "", "...", "under the mit license", "Under the\tMIT-license! under the mit license", "xunder the mit license", "under the mit licenses", "apache license version 20",
    "Apache License, Version 2.0", "cc by nc cc-by-nc 4.0 CC BY-NC-SA 4.0", "cc by ncé", "ünder the mit license é cc by nc", "GPLv3 gpl v2+ GPL 2 or later, agpl-3.0", "\x00under\x7fthe{mit}license",
    "Copyright (c) 2001 2002 All rights reserved. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "cc by nc " * 5000, "the " * 30_000 + "under the mit license", "SPDX-License-Identifier: MIT " * 300 + "mit license",
]


def test_detections_equal_a_loop(spark, tmp_path):
    """Fixed cases, texts strung together from words of the rules, nulls, long texts, repeated rows, clashing columns and a null id."""
    rng = random.Random(4)
    pool = sorted({w for r in rules() for w in re.findall(r"[a-z0-9]+", r.expression.pattern)}) + ["é", "3", "2", "0"]
    phrases = [re.sub(r"[^a-z0-9 ]", "", r.expression.pattern) for r in rules()] + [p for p, _ in PHRASES]
    texts = TEXTS + ["".join(rng.choice([rng.choice(phrases), rng.choice(pool), rng.choice(pool)]) + rng.choice([" ", "-", ". ", "/"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, "cc by nc", "x", 1), (0, "cc by nc", "x", 1), (None, "mit license", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string, rule int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op11_license_scan"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *scanned_plainly(t)) for i, t, _, _ in rows], key=str)
    assert license_detections(frame.limit(0)).collect() == []


def test_the_given_table(spark):
    path = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op11_license_scan"](spark, path).collect()}
    table = pq.read_table(f"{path}/documents.parquet").to_pylist()
    assert got == {r["doc_id"]: scanned_plainly(r["text"]) for r in table}
    assert sum(bool(x[4]) for x in got.values()) > 5 and sum(x[6] > 0 for x in got.values()) < len(got) / 2
