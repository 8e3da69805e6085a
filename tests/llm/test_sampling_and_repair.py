"""Importance resampling and conversation repair against plain loops over all rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from confora.llm import conversations, importance
from confora.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# 12
def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def resampled_plainly(docs, target, percent, min_words, ngrams, buckets, seed):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]

    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("ngrams, buckets", [(1, 10_000), (2, 500), (3, 7)])
def test_resampling_equals_a_loop(spark, monkeypatch, ngrams, buckets):
    """Nulls, empty and long texts, ties, repeated rows and ids, letters beyond ASCII, and columns with the operator's own names."""
    monkeypatch.setattr(importance, "BLOCK", 3)
    monkeypatch.setattr(importance, "COARSE", 5)
    rng = random.Random(ngrams)
    vocabulary = [f"w{i}" for i in range(50)] + ["Éclair", "ÄÖ", "naïve", "字", "x²", "İ"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "Word, WORD-word {word}\x7f\x00" * 400), (None, docs[3][1] + " more" * 20), (None, "w1 " * 30)]
    docs += [(7, "w1 w2 " * 20)] * 9 + [(8, "w3 " * 25), (8, "w3 " * 26)]
    target = [" ".join(rng.choice(vocabulary[:9]) for _ in range(30)) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in docs], "doc_id long, text string, words string, score int, rank int")
    texts = spark.createDataFrame([(t, 0) for t in target], "text string, bucket int")
    for percent in (30, 100):
        got = importance.resampled(frame, texts, percent=percent, ngrams=ngrams, buckets=buckets)
        assert sorted(map(tuple, got.collect()), key=str) == resampled_plainly(docs, target, percent, 20, ngrams, buckets, 2024)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "w " * 30)], "doc_id long, text string")
    assert importance.resampled(none, some).collect() == []
    assert sorted(map(tuple, importance.resampled(some, none, percent=50).collect()), key=str) == resampled_plainly([(1, "a b"), (2, "w " * 30)], [], 50, 20, 1, 10_000, 2024)


def test_scores_far_apart_are_shuffled_alike(spark, monkeypatch):
    """Offsets beyond the broadcast bound, scores of any spread, ids that are strings."""
    monkeypatch.setattr(importance, "BROADCAST_SCORES", 0)
    docs = [(f"d{i}", "rare " * (i * i) + "common " * 20) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    got = importance.resampled(frame, frame.limit(2).select("text"), percent=25)
    want = resampled_plainly(docs, [t for _, t in docs[:2]], 25, 20, 1, 10_000, 2024)
    assert sorted(map(tuple, got.collect()), key=str) == want


# 13
ENDS = re.compile(r"(?:s?(?:ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        content = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not content else "duplicate" if (role, text) in seen else "truncated" if content[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repaired_plainly(rows, most=2):
    """The least (cost, audit) and its result among all edits, with up to ``most`` inserts at a place: by full enumeration."""
    faults = faults_of(rows)
    inserts = [x for k in range(most + 1) for x in itertools.product(("user", "assistant"), repeat=k)]
    best = None

    def visit(i, cost, audit, out):
        nonlocal best
        for x in inserts:
            c, a, o = cost + 2 * len(x), audit + "I" * len(x), out + [(r, "") for r in x]
            if best is not None and c > best[0]:
                continue
            if i == len(rows):
                if ENDS.fullmatch("".join(r[:1] or "?" for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text = rows[i]
            visit(i + 1, c + 3, a + "D", o)
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                visit(i + 1, c + late, a + "K", o + [(role, text)])
                for r in ("user", "assistant"):
                    visit(i + 1, c + 2 + late, a + "R", o + [(r, text)])

    visit(0, 0, "", [])
    return best


def summary(rows):
    """As the query returns it, of (turn, role, text) rows in order."""
    named = [(r, t) for _, r, t in rows]
    faults = Counter(faults_of(named))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = repaired_plainly(named)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(named))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def conversations_of(rng, n):
    for c in range(n):
        turn = rng.choice([0, 0, -2, 7, 10**6])
        for _ in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", "", "User"])
            yield c, turn, role, rng.choice(["One.", "Two!", "Three?", "open", "", " \n", "One.", "Four. \t", "x", "é."]) + rng.choice(["", "", str(rng.randrange(9)) + "."])
            turn += rng.choice([1, 1, 1, 2, 3])


@pytest.mark.parametrize("chunk", [4096, 2])
def test_repair_equals_enumeration(spark, monkeypatch, chunk):
    """All edits of 250 short conversations, whole and in chunks of two turns, with nulls, null turns and a null id, and clashing columns."""
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = list(conversations_of(random.Random(chunk), 250))
    rows += [(None, 1, "user", "Lost."), (None, 2, None, None), (900, None, "user", "A."), (900, None, "user", "A."), (900, 3, "assistant", None), (901, None, None, "B.")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, fault string").repartition(5)
    audits = conversations.audited(frame)
    digest = {r.conv_id: r.repaired_sha256 for r in conversations.digests(conversations.repaired(frame, audits)).collect()}
    got = {r.conv_id: (*r[1:8], digest.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in audits.collect()}
    by_id = defaultdict(list)
    for c, turn, role, text in rows:
        by_id[c].append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {c: summary(sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0))) for c, rs in by_id.items()}


def test_chunks_join_to_the_same_string(spark, monkeypatch):
    """A conversation of 3,000 turns with every fault, whole and in chunks of 7, 64 and 1,000 turns."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"{t}.", f"{t}", ""])) for t in range(3000) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = set()
    for chunk in (10_000, 7, 64, 1000):
        monkeypatch.setattr(conversations, "CHUNK", chunk)
        audits = conversations.audited(frame)
        found.add((audits.drop("pieces").first(), conversations.digests(conversations.repaired(frame, audits)).first()))
    assert len(found) == 1
    fixed = conversations.repaired(frame, audits).orderBy("chunk", "position").collect()
    assert ENDS.fullmatch("".join(r.role[0] for r in fixed)) and len(fixed) > 1000


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits = conversations.audited(none)
    assert audits.collect() == [] and conversations.digests(conversations.repaired(none, audits)).collect() == []


def damaged_plainly(rows):
    out, text_of = defaultdict(list), lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
        out[c]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text_of(text)) if kind == 2 else text_of(text)
            out[c] += [(turn, "user" if kind == 4 else text_of(role), text)] * (2 if kind == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in out.items()}


def test_query_equals_enumeration(spark, tmp_path):
    """The registered query over short conversations, of which some lose all rows."""
    rng = random.Random(3)
    rows = [(c, t if c else None, rng.choice(["system", "user", "user", "assistant"]), rng.choice(["Yes.", "No", "Why?", f"{t}."])) for c in range(400) for t in range(rng.randrange(1, 5)) if c or not t]
    rows += [(None, 1, "user", None), (None, None, None, "Hm.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    want = damaged_plainly(rows)
    assert any(not r for r in want.values()) and len(got) == len(want)
    assert got == {c: summary(rs) for c, rs in want.items()}


def test_query_on_the_given_table(spark):
    """Gaps and faults of every conversation by a loop; the grammar holds after the edits that the audit names."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01"
    table = pq.read_table(f"{path}/conversations.parquet").to_pylist()
    want = damaged_plainly([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table])
    for r in queries()["op13_conversation_repair"](spark, path).collect():
        rows = want[r.conv_id]
        faults = Counter(faults_of([(role, text) for _, role, text in rows]))
        assert (r.blank, r.duplicate, r.truncated) == (faults["blank"], faults["duplicate"], faults["truncated"])
        assert sum(x != "I" for x in r.audit) == len(rows)
        if len(rows) <= 5:
            assert (r.cost, r.audit, r.repaired_sha256) == summary(rows)[5:]
