"""The ten operators against brute force, public libraries and planted cases, with the edge cases each docstring names."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from confora.llm import bm25_wand, bpe_count, embedding_cells, minhash_join, personal_data, toxicity, unigram, warc
from confora.llm.common import connected_components
from confora.llm.suffix_array_dedup import remove_repeated_bytes
from confora.llm.suffix_tree_dedup import remove_repeated_words

DOCS = "doc_id long, text string, id string, k1 int, value string"


def docs(spark, texts):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], DOCS)


def words(rng, n, tag="w", pool=10_000):
    return [f"{tag}{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {i: 0 for i in range(31)} | {50: 50, 60: 50}
    assert connected_components(e.limit(0)).count() == 0


# 1
def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "TILE_ROWS", 8)  # several tiles per bucket
    rng = random.Random(1)
    base = words(rng, 120)
    texts = [" ".join(words(rng, 60)) for _ in range(10)]
    for _ in range(25):
        w = list(base)
        w[rng.randrange(120)] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 3 + [None, "", "...", "two words", "Two, WORDS!", " ".join(base[:100])]
    got = {r.doc_id: r for r in minhash_join.near_duplicate_classes(docs(spark, texts)).collect()}
    sets = [set(minhash_join.ngram_set(t).tolist()) if t else set() for t in texts]
    link = {i: [j for j in range(len(texts)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(texts))}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in link.items()}
    label = {i: i for i in link}
    for _ in texts:
        label = {i: min([label[i], *(label[j] for j in link[i])]) for i in link}
    assert {i: r.class_id for i, r in got.items()} == label


def test_near_duplicates_of_repeated_ids_and_rows(spark):
    """Repeated rows, one id with two texts, and null ids: every row is a document."""
    rng = random.Random(11)
    a = words(rng, 100)
    near, far = " ".join([*a[:50], "other", *a[51:]]), " ".join(words(rng, 100, "z"))
    a = " ".join(a)
    for rows in (
        [(1, a), (1, a), (2, near)],
        [(1, a), (1, far), (2, near), (3, far)],
        [(None, a), (None, near), (None, far), (4, far), (None, None), (None, a)],
        [(7, a), (7, near), (7, a), (None, near), (3, None), (3, "")],
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        sets = [set(minhash_join.ngram_set(t).tolist()) if t else set() for _, t in rows]
        link = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
        reach = [{i} for i in range(len(rows))]
        for _ in rows:
            reach = [r.union(*(reach[j] for j in link[i])) for i, r in enumerate(reach)]
        low = [min((rows[j][0] for j in r if rows[j][0] is not None), default=None) for r in reach]
        got = [(r.doc_id, r.class_id, r.n_links) for r in minhash_join.near_duplicate_classes(df).collect()]
        assert Counter(got) == Counter((i, c, len(x)) for (i, _), c, x in zip(rows, low, link, strict=True))


def test_words_are_those_of_the_pattern():
    for t in ("Don't stop_now, ÉTÉ 漢字2 ß", "", "  ", "a", "x" * 70_000 + " y"):
        w = re.findall(r"\w+", t.lower())
        got = minhash_join.hashes_of_words(t)
        assert len(got) == len(w) and [int(x) for x in got] == [int(minhash_join.hashes_of_words(x)[0]) for x in w]


def test_ids_of_any_type(spark, piece_model):
    """Text ids are carried as they are; the least of a class is the least text."""
    rows = [("b", "one two three four five six seven"), ("a", "One two, three four five six seven"), ("c", None), (None, "other words here and there now")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in minhash_join.near_duplicate_classes(df).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0), None: (None, 0)}
    assert {r.doc_id for r in unigram.encoded(df, piece_model).collect()} == {"a", "b", "c", None}
    bench = spark.createDataFrame([("q1", "one two three four five. six seven.")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in bm25_wand.contaminated(df, bench).collect()} == {("a", "q1"), ("b", "q1")}
    assert {r.doc_id for r in toxicity.toxicity(df, spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, toxic int")).collect()} == {"a", "b", "c", None}


def test_toxicity_of_null_and_repeated_ids(spark):
    """Rows of one id are scored each, null ids are never held out, and columns of clashing names are carried through."""
    rows = [(i, "the house " + ("moron" if i % 3 == 0 else "idea")) for i in range(90)] + [(3, "the house moron"), (3, None), (None, "a moron"), (None, "an idea"), (None, None)]
    df = spark.createDataFrame([(i, t, 0.25, 7) for i, t in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 1), (0, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(rows) and not any(r.held_out for r in got if r.doc_id is None)
    assert sorted(r.predicted for r in got if r.doc_id == 3) == [0, 1, 1] and sorted(r.predicted for r in got if r.doc_id is None) == [0, 0, 1]
    kept = toxicity.toxicity(df, labels, keep_columns=True)
    assert kept.columns[:4] == df.columns and kept.select("score").distinct().collect() == [(0.25,)] and kept.where("_predicted = 1").count() == sum(r.predicted for r in got)


def test_bands():
    b, r = minhash_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= minhash_join.MAX_HASHES
    assert minhash_join.near_duplicate_classes  # empty input below


def test_empty_tables(spark):
    none = docs(spark, []).where("false")
    assert minhash_join.near_duplicate_classes(none).count() == 0
    assert remove_repeated_words(none).count() == remove_repeated_bytes(none).count() == 0
    assert personal_data.personal_spans(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(none, labels).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert bm25_wand.contaminated(none, bench).count() == 0
    assert bm25_wand.contaminated(docs(spark, ["a b c"]), bench).count() == 0
    assert embedding_cells.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.merged_index(warc.capture_runs(spark, warc.write_archives(pages, F.lit(None).cast("timestamp")))).count() == 0


# 2
def test_wand_equals_exhaustive_scores():
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(5, 30), "b", 200)), "") for i in range(60)]
    ix = bm25_wand.Index(items)
    for _ in range(200):
        query = {ix.term.get(w, 0) for w in words(rng, 40, "b", 220) + items[rng.randrange(60)][1].split()[: rng.randrange(30)]}
        score = Counter()
        for t in query:
            for i, x in zip(ix.items[t], ix.impact[t], strict=True):
                score[i] += x
        for threshold in (0.2, 0.5, 0.8):
            assert {i for i, _ in ix.wand(query, threshold)} == {i for i, s in score.items() if s >= threshold - 1e-9}


def test_contamination(spark):
    rng = random.Random(3)
    items = [" ".join(words(rng, 20, "q", 500)) + ". " + " ".join(words(rng, 6, "a", 500)) + "." for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate([*items, None, ""])), "item_id long, text string")
    pad = lambda: " ".join(words(rng, 150))
    texts = [pad(), f"{pad()} {items[3]} {pad()}", items[5], None, "", " ".join(items[7].split()[:8]), f"{pad()} {items[2].upper()}\n{items[9]}", items[4].split(".")[0]]
    hits = {(r.doc_id, r.item_id) for r in bm25_wand.contaminated(docs(spark, texts), bench).collect()}
    assert hits == {(1, 3), (2, 5), (6, 2), (6, 9)}


def test_contamination_equals_brute_force(spark):
    """Every passage against every item, without index or bounds; whole, in parts, with null and repeated ids, repeated items and a very long text."""
    rng = random.Random(32)
    item = lambda: f"{' '.join(words(rng, rng.randrange(6, 25), 'q', 60))}. {' '.join(words(rng, rng.randrange(1, 9), 'a', 60))}."
    items = [item() for _ in range(25)]
    items += [items[3], None, "", "one", "..."]
    bench = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")

    def text(n):
        w = words(rng, n, "q", 60)
        for _ in range(2):
            own = items[rng.randrange(25)].split()
            own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own[: rng.randrange(len(own) // 2, len(own) + 1)]
        return " ".join(w)

    texts = [text(rng.randrange(5, 120)) for _ in range(60)] + [None, "", "...", "one", items[0], text(20_000)]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    ix = bm25_wand.Index([(i if i != 4 else None, *bm25_wand.split_answer(t or "")) for i, t in enumerate(items) if bm25_wand.words(t)])
    want = Counter()
    for i, t in rows:
        ws, hits = bm25_wand.words(t), {}
        for lo in range(0, len(ws), ix.longest):
            passage = ws[lo : lo + 2 * ix.longest]
            score = Counter()
            for x in {ix.term.get(w, 0) for w in passage}:
                for k, s in zip(ix.items[x], ix.impact[x], strict=True):
                    score[k] += s
            for k, s in score.items():
                parts = [bm25_wand.tolerant_overlap(p, passage, 5, 0.8) for p in (*ix.parts[k], ix.full[k])]
                if s >= 0.5 - 1e-9 and (min(parts[:2]) >= 0.8 or parts[2] >= 0.8):
                    hits[k] = max(hits.get(k, 0), round(s, 9))
        want.update((i, ix.ids[k], s) for k, s in hits.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part_bytes in (bm25_wand.PART_BYTES, 400):
        got = bm25_wand.contaminated(df, bench, part_bytes=part_bytes).collect()
        assert Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in got) == want and len(want) > 20


def test_contamination_of_edited_items(spark):
    """One changed word anywhere, or a missing short last sentence, hides no item; items that share half their words are not hits."""
    rng = random.Random(31)
    item = lambda n, m: (words(rng, n, "q", 9000), words(rng, m, "a", 9000))
    text = lambda q, a: f"{' '.join(q)}. {' '.join(a)}."
    items = [item(20, 7), item(30, 3), item(9, 3), item(60, 7)]
    bench = spark.createDataFrame([(i, text(*x)) for i, x in enumerate(items)], "item_id long, text string")
    pad, texts, want = " ".join(words(rng, 80)), [], set()
    for i, (q, a) in enumerate(items):
        for k in range(len(q) + len(a)):
            w = q + a
            w[k] = "changed"
            want.add((len(texts), i))
            texts.append(f"{pad} {text(w[: len(q)], w[len(q) :])} {pad}")
    want.add((len(texts), 1))
    texts += [f"{pad} {' '.join(items[1][0])}. {pad}", f"{pad} {' '.join(items[0][0][:14] + items[0][1])} {pad}"]
    assert {(r.doc_id, r.item_id) for r in bm25_wand.contaminated(docs(spark, texts), bench).collect()} == want
    for _ in range(50):
        part, passage = words(rng, rng.randrange(1, 8), "w", 5), words(rng, rng.randrange(1, 12), "w", 5)
        table = [[0] * (len(passage) + 1)]
        for x in part:
            row = [len(table)]
            for j, y in enumerate(passage):
                row.append(min(table[-1][j] + (x != y), table[-1][j + 1] + 1, row[-1] + 1))
            table.append(row)
        assert bm25_wand.edit_similarity(part, passage) == 1 - min(table[-1]) / len(part)


# 3
def test_unigram_equals_library_and_brute_force(piece_model):
    sentencepiece = pytest.importorskip("sentencepiece")
    raw = open(piece_model, "rb").read()
    m = unigram.Unigram(raw)
    at = raw.index(b"tok_v0\x18\x02")
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[: at + 7] + b"\x01" + raw[at + 8 :])
    rng = random.Random(4)
    texts = ["Hello world, this is fine.", "unbelievable", "", "a  b", "été à Paris", "x" * 300] + [" ".join("".join(rng.choice("abcdeéth") for _ in range(rng.randrange(1, 12))) for _ in range(6)) for _ in range(60)]
    ids = [x.tolist() for x in m.encode_all(texts, {})]
    total = lambda p: sum(m.scores[i] for i in p)
    for text, mine, theirs in zip(texts, ids, library.encode(texts), strict=True):
        assert mine == theirs or total(mine) >= total(theirs) - 1e-6, text
    # single words, whose sums no precision blurs: the same ids, but for rare ones where the library's path scores less
    import pyarrow.parquet as pq

    some = sorted({w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() for w in (t or "").split() if len(w) < 20})[:3000]
    mine, theirs = [x.tolist() for x in m.encode_all(some, {})], library.encode(some)
    other = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert len(other) <= len(some) // 1000 and all(total(a) > total(b) for a, b in other)
    for text in ("hello", "ab é", "thethe", "ariear"):  # all segmentations
        data = m.escaped(text).encode()
        keys = {p.encode(): m.scores[i] for i, p in enumerate(m.pieces) if m.kinds[i] == unigram.NORMAL}
        best = [0.0] + [-np.inf] * len(data)
        for e in range(1, len(data) + 1):
            best[e] = max([best[s] + keys[data[s:e]] for s in range(e) if data[s:e] in keys] or [-np.inf])
        assert total(m.encode_all([text], {})[0]) == pytest.approx(best[-1])


def test_encoding_round_trip(spark, piece_model):
    texts = ["Hello  world\n\ttabs", None, "", "漢字 🎉 ᚠ", " lead and trail ", "y" * 1000, "a▁b"]
    got = unigram.encoded(docs(spark, texts), piece_model).orderBy("doc_id").collect()
    assert [r.round_trip for r in got] == [True] * 6 + [False]
    assert [got[1].n_pieces, got[2].n_pieces] == [0, 0] and got[3].n_byte_pieces > 0


# 4
def test_loser_tree():
    rng = random.Random(5)
    capture = lambda r, i: (rng.choice("abc"), f"{rng.randrange(9)}", str(rng.randrange(50)), 0, "", "", None, f"file{r}", i)
    runs = [sorted([capture(r, i) for i in range(rng.randrange(8))], key=warc.order) for r in range(30)]
    for out in (list(warc.LoserTree(runs)), warc.merged(runs, 2), warc.merged(runs, 4)):
        assert sorted(map(warc.order, out)) == [warc.order(x) for x in out] and len(out) == sum(map(len, runs))
    assert list(warc.LoserTree([])) == [] and list(warc.LoserTree([[]])) == [] and warc.merged([]) == []


def test_dates_are_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = spark.sql("select explode(array(0, -1, 1604217599, 4102444800, -2208988801)) as s").select("s", warc.utc(F.timestamp_seconds("s")).alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = {0: "1970-01-01T00:00:00Z", -1: "1969-12-31T23:59:59Z", 1604217599: "2020-11-01T07:59:59Z", 4102444800: "2100-01-01T00:00:00Z", -2208988801: "1899-12-31T23:59:59Z"}
    assert {r.s: r.t for r in found} == want


def test_archives(spark):
    pages = [(3, "http://b.com/x", "same"), (1, "http://a.com/y?q=1#f", "same"), (2, None, None), (4, "odd\r\nurl", ""), (5, "http://a.com/y?q=1", "é\r\n\r\nWARC/1.1"), (5, "http://a.com/y?q=1", "é\r\n\r\nWARC/1.1"), (None, "http://c.com", "same")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    at = F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))
    runs = warc.capture_runs(spark, warc.write_archives(df, at, records_per_file=2))
    rows = warc.merged_index(runs, captures_per_range=2).orderBy("range_id", "position").collect()
    keys = [(r.url_key, r.capture_time) for r in rows]
    assert keys == sorted(keys) and len(rows) == 7
    numbered = warc.globally_numbered(warc.merged_index(warc.capture_runs(spark, warc.write_archives(df, at, records_per_file=1), run_captures=2), captures_per_range=2))
    assert [r.url_key for r in numbered.orderBy("index_position").collect()] == [k for k, _ in keys] and numbered.agg(F.max("index_position")).first()[0] == 6
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows}
    assert got == {("3", 4, "revisit", "1"), ("1", 4, "response", None), ("2", 0, "response", None), ("4", 0, "revisit", "2"), ("5", 14, "response", None), (None, 4, "revisit", "1")}
    assert {r.payload_digest for r in rows if r.page_id == "1"} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    high = warc.merged_index(warc.capture_runs(spark, warc.write_archives(df, at, min_revisit_bytes=5)))
    assert {r.record_type for r in high.collect()} == {"response"}


# 5 and 8
def brute_removal(texts, split, join, width):
    seqs = [split((t or "").encode()) for t in texts]
    count = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = set()
        for i in range(len(s) - width + 1):
            if count[tuple(s[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(s), len(gone), hashlib.sha256(join([x for i, x in enumerate(s) if i not in gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 3])
@pytest.mark.parametrize(("operator", "width"), [(remove_repeated_words, 35), (remove_repeated_words, 7), (remove_repeated_bytes, 100)])
def test_removal_equals_brute_force(spark, operator, width, hot):
    rng = random.Random(6)
    shared = words(rng, 50)
    texts = ["a b " * 60, "a " * 90, "x " * 34, "x " * 35, "x\t" * 36, None, "", "the  quick\r\n" + " ".join(shared), "é" * 70]
    texts += [" ".join([*words(rng, 20, "u"), *shared[rng.randrange(5) :], *words(rng, 20, "v")]) for _ in range(15)] + ["a b " * 60]
    split, join = (lambda b: re.findall(rb"[^\x20\x09-\x0D]+", b), b" ".join) if operator is remove_repeated_words else (list, bytes)
    got = operator(docs(spark, texts), window=width, hot=hot).orderBy("doc_id").collect()
    assert [(r.n_symbols, sum(s.length for s in r.removed), r.kept_sha256) for r in got] == brute_removal(texts, split, join, width)


@pytest.mark.parametrize("operator", [remove_repeated_words, remove_repeated_bytes])
def test_removal_at_the_default_width(spark, operator):
    """Passages near the width, at every place of a text, in near copies, in one text twice, periodic, and in very long texts."""
    rng = random.Random(61)
    long = words(rng, 9000, "z", 300)
    texts = [" ".join(long), " ".join(long[100:4000] + ["x"] + long[4001:])]
    for n in (20, 34, 35, 36, 50, 60, 61, 62, 63, 64, 65, 66, 80, 120):
        p = words(rng, n, "p")
        texts += [" ".join([*words(rng, rng.randrange(60), "u"), *p, *words(rng, rng.randrange(60), "v")]) for _ in range(3)] + [" ".join(p)]
    p = words(rng, 90, "q")
    texts += [" ".join([*p, *words(rng, 9), *p]), "ab " * 900, "ab " * 901, "é" * 500, "é" * 501, "", None, "short", "\x00" * 900, "\x00" * 800 + "1"]
    near = words(rng, 400, "n")
    for _ in range(12):
        w = list(near)
        w[rng.randrange(400)] = "changed"
        texts.append(" ".join(w))
    split, join, width = (lambda b: re.findall(rb"[^\x20\x09-\x0D]+", b), b" ".join, 35) if operator is remove_repeated_words else (list, bytes, 400)
    want = brute_removal(texts, split, join, width)
    for hot in (4000, 2):
        got = operator(docs(spark, texts), hot=hot).orderBy("doc_id").collect()
        assert [(r.n_symbols, sum(s.length for s in r.removed), r.kept_sha256) for r in got] == want


def test_suffix_tree_and_induced_order():
    """Trees have the nodes of a brute-force tree; induced ranks and common prefixes are those of sorted suffixes."""
    from confora.llm import suffix_array_dedup, suffix_tree_dedup

    rng = np.random.default_rng(7)
    for _ in range(30):
        rows = rng.integers(0, 3, (40, 6)).astype(np.int32)
        order, shared = suffix_tree_dedup.sorted_suffixes(rows)
        tree = suffix_tree_dedup.tree_of(shared, 6)
        got = {(tuple(rows[order[s]][:d].tolist()), int(e - s)) for d, s, e in zip(tree.depth, tree.start, tree.end, strict=True)}
        prefixes = Counter(tuple(r[:d].tolist()) for r in rows for d in range(7))
        want = {(p, n) for p, n in prefixes.items() if n > 1 and (len(p) == 6 or len({x for x in prefixes if x[: len(p)] == p and len(x) == len(p) + 1}) > 1)}
        assert got == want
        assert all(tree.parent[i] < i and (tree.parent[i] < 0 or tree.depth[tree.parent[i]] < tree.depth[i]) for i in range(len(tree.depth)))
    for memory in (5, 100):
        data = [b" ".join(b"%d" % x for x in rng.integers(0, 2, n)) for n in (60, 80, 40)]
        n = [max(0, len(x.split()) - 4) for x in data]
        flags = np.concatenate(suffix_tree_dedup.deep_nodes(data, n, None, 5, 1, memory)).tolist()
        grams = [tuple(x.split()[i : i + 5]) for x, m in zip(data, n, strict=True) for i in range(m)]
        assert flags == [Counter(grams)[g] > 1 for g in grams]
    text = rng.integers(0, 3, 300).astype(np.uint8)
    at = np.arange(20, 260)
    queue = suffix_array_dedup.sample_suffixes(text, at, np.full(len(at), 40), np.zeros(len(at), np.int64), 40)
    for offset in range(1, 15):
        queue = queue.induced(text[at[queue.item] - offset].astype(np.int64))
        suffix = [text[a - offset : a + 40].tolist() for a in at[queue.item]]
        assert suffix == sorted(suffix)
        assert queue.shared[1:].tolist() == [next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 40 + offset) for a, b in zip(suffix, suffix[1:], strict=False)]


# 6
def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello world", None, "", "x" * 3000, "don't  stop\n\n now", "漢字🎉é", "a<|endoftext|>b <|endoftext|>", "12345 6789", "Hello world"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in bpe_count.token_counts(docs(spark, texts), path).collect()}
    lib = Tokenizer.from_file(path)
    assert got == {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}


# 7
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m) for m in EMAIL.finditer(t)] + [(1, m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))] + [(3, m) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_personal_data(spark):
    texts = [
        None, "", "a@b.c_d@e.f a.b@c..d x@y.z.w+q@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.03.4", "4111 1111 1111 1111-4111111111111111 4111--1111", "+1 (644) 555-7859. +44.20-7946 0958 +1+2 345 678 901",
        "é漢🎉 a@b.co  x@y.zz ", ".a" * 3000 + "a@" + "b." * 3000 + "c", "9" * 5000, "1.1.1.1 " * 100, "%@%.% a-b@c-d.e-f @x.y",
    ]
    texts += [f"write now to user{i}@site.org please" for i in range(6)] + ["write now to agent77x please", "nothing 5 here"]
    got = personal_data.personal_spans(docs(spark, texts)).orderBy("doc_id").collect()
    assert [sorted((s.kind, s.start, s.end) for s in r.base) for r in got] == [sorted(base_spans(t or "")) for t in texts]
    assert [(s.kind, s.start, s.end) for s in got[17].added] == [(0, 13, 21)] and not got[18].added
    d = docs(spark, texts)
    masked = {r.doc_id: r.text for r in personal_data.masked(d, personal_data.personal_spans(d)).collect()}
    assert masked[17] == "write now to <email> please" and masked[0] is None and masked[18] == texts[18]


def test_values_are_discovered_in_every_context(spark):
    """At the start of a text, after other identifiers, next to a long word and beyond a third round."""
    long = "x" * 100
    forms = ["Badge: {}", "{} signed", "on 555-1234 or {}", "account 12345 pin {}", "see {} {}", f"the {long} {{}} end"]
    texts, want = [], {}

    def add(text, value=None):
        if value:
            want[len(texts)] = text.rindex(value)
        texts.append(text)

    for k, f in enumerate(forms):
        for i in range(4):
            mail = f"user{k}n{i}@site.org"
            add(f.format(*[mail] * f.count("{}")) if f.count("{}") == 1 else f.format(f"user{k}m{i}@site.org", mail))
        add(f.format(f"agent{k}x") if f.count("{}") == 1 else f.format(f"user{k}m9@site.org", f"agent{k}x"), f"agent{k}x")
    for step in range(6):  # values of one step are the only support of the next one's pattern
        for i in range(4):
            add(f"some step{'abcdef'[step]} here {f's0i{i}@site.org' if step == 0 else f'chain{step}i{i}'} end", None if step == 0 else f"chain{step}i{i}")
            add(f"some step{'abcdef'[step]} here chain{step + 1}i{i} end", f"chain{step + 1}i{i}")
    got = personal_data.personal_spans(docs(spark, texts)).orderBy("doc_id").collect()
    missed = [texts[i] for i, at in want.items() if at not in [s.start for s in got[i].added]]
    assert not missed, missed
    assert all(not r.added for i, r in enumerate(got) if i not in want and "12345" not in texts[i] and "555" not in texts[i])


def test_discovery_of_planted_identifiers(spark):
    """Precision and recall on values that only their contexts give away: left, right and both, secrets, quotes, and none in other contexts."""
    rng = random.Random(71)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    fill = lambda: " ".join(words(rng, 12, "f", 3000)).replace("0", "o").translate({ord(str(i)): "abcdefghij"[i] for i in range(10)})
    texts, want = [], {}
    for _ in range(40):
        texts += [f'{fill()} token = "{hexed()}" {fill()}', f"{fill()} u{rng.randrange(9**9)}@site.org wrote {fill()}", f"{fill()} caller +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} hung {fill()}", f"{fill()} page {rng.randrange(999)} of {fill()}"]
    for value, form in ((f"hunter{i}", 'token = "{}"') for i in range(8)):
        want[len(texts)] = (4, value)
        texts.append(f"{fill()} {form.format(value)}; {fill()}")
    for i in range(8):
        want[len(texts)] = (0, f"user-at-{i}")
        texts.append(f"{fill()} user-at-{i} wrote {fill()}")
        want[len(texts)] = (4, f"correct{'abcdefgh'[i]}horse")
        texts.append(f"{fill()} token = 'correct{'abcdefgh'[i]}horse', {fill()}")
    got = personal_data.personal_spans(docs(spark, texts)).orderBy("doc_id").collect()
    found = {(i, s.kind, texts[i][s.start : s.end]) for i, r in enumerate(got) for s in r.added}
    secrets = {x for x in found if len(x[2]) == 40}
    planted = {(i, k, v) for i, (k, v) in want.items()}
    assert len(secrets) == 40 and found - secrets == planted


def test_one_long_word_of_many_matches(spark):
    got = personal_data.personal_spans(docs(spark, ["1.1.1.1," * 20_000, "q" * 1_000_000 + " 5"])).orderBy("doc_id").collect()
    assert len(got[0].base) == 20_000


def test_personal_data_is_native():
    source = open(personal_data.__file__).read()
    assert not re.search(r"udf|mapIn|applyIn|toPandas|\.rdd|import (pandas|pyarrow|numpy)", source)


# 9
def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "scum"]
    vocabulary = ["the", "house", "green", "idea", "motor", "ice", "radio", "patio", "minor", "morning", "sum", "scuba"]
    text = lambda toxic: " ".join([rng.choice(vocabulary) for _ in range(30)] + ([rng.choice(bad) for _ in range(2)] if toxic else []))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    extra = [(1000, "green 1d10t house m0r0n", 1), (1001, "the i.d.i.o.t and s c u m", 1), (1002, "moroooon scuuuum", 1), (1003, None, 0), (1004, "", 0), (1005, "3 apples for 5 people!!!", 0)]
    d = docs(spark, []).sparkSession.createDataFrame([(i, t) for i, t, _ in rows + extra], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) >= 0.95
    assert [got[i].predicted for i, _, _ in extra] == [y for _, _, y in extra]
    kept = toxicity.toxicity(d.withColumn("source", F.lit("s")), labels, keep_columns=True)
    assert kept.columns[:3] == ["doc_id", "text", "source"] and kept.count() == len(got)
    unlabelled = toxicity.toxicity(d, labels.where("false")).agg(F.max("score")).first()[0]
    assert unlabelled < 1e-9


def test_every_obfuscated_token_is_restored():
    """Alone in a text and however long; closing punctuation stays."""
    counts = np.zeros(toxicity.N_CLASSES**3, np.int64)
    for w in ("moron", "dumbass", "shit", "you", "go", "hello", "the"):
        c = np.concatenate([[toxicity.EDGE], toxicity.classes(w), [toxicity.EDGE]]).astype(np.int64)
        np.add.at(counts, (c[:-2] * toxicity.N_CLASSES + c[1:-1]) * toxicity.N_CLASSES + c[2:], 50)
    restore = toxicity.Decoder(counts).restore
    want = {
        "you dumb@$$ go": "you dumbass go", "sh1+": "shit", "m" + "0" * 60 + "ron": "moron", "mor" + "o" * 70 + "n": "moron", "the m_o_r_o_n": "the moron",
        "hello! you": "hello! you", "m0r0n!!": "moron!!", "the 2020": "the 2020",
    }
    assert {t: restore(t) for t in want} == want
    long = "".join(random.Random(9).choice("moron0123") for _ in range(100_000))
    assert len(restore(long)) > 50_000


# 10
def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_cells, "BLOCK", 16)
    monkeypatch.setattr(embedding_cells, "BATCH", 32)
    rng = np.random.default_rng(0)
    b = rng.normal(size=(30, 16))
    x = np.concatenate([b[rng.integers(0, 30, 300)] + rng.normal(size=(300, 16)) * 0.12, b[:3], b[:3], np.zeros((1, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, float("nan")]), (402, [1.0, 2.0]), (403, [2.0, 4.0]), (404, []), (405, [None, 1.0]), (406, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, cell int")
    found = embedding_cells.near_duplicate_vectors(df, rows_per_cell=10)
    got = {r.vec_id: r for r in found.collect()}
    u = x[:306] / np.linalg.norm(x[:306], axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(306)
    for _ in range(306):
        label = np.minimum(label, np.where(near, label, 999).min(axis=1))
    assert [got[i].n_links for i in range(306)] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(306)] == label.tolist()
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (306, 400, 401, 404, 405, 406)] == [(0, i, True) for i in (306, 400, 401, 404, 405, 406)]
    assert (got[402].n_links, got[403].component_id, got[403].kept) == (1, 402, False)
    assert embedding_cells.recall(df.where("vec_id < 306"), found) == 1.0


@pytest.mark.parametrize("kind", ["isotropic", "subspace", "clusters", "one_direction"])
def test_no_link_is_lost(spark, kind):
    """All links at the default threshold, whatever the shape of the data, with small cells."""
    rng = np.random.default_rng(3)
    n, d, k = 1500, 64, 8
    if kind == "subspace":
        d, k = 384, 16
        x = rng.normal(size=(n, k)) @ np.linalg.qr(rng.normal(size=(d, k)))[0].T
    elif kind == "clusters":
        x = rng.normal(size=(20, d))[rng.integers(0, 20, n)] + rng.normal(size=(n, d)) * 0.2
    else:
        x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.normal(size=(n, d)) if kind != "one_direction" else np.tile(np.eye(d)[0], (n, 1))
    if kind == "subspace":
        step = step @ np.linalg.qr(x[:k].T)[0] @ np.linalg.qr(x[:k].T)[0].T
    step -= (step * x).sum(axis=1, keepdims=True) * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.97, n)[:, None]
    x = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * step])
    near = (x @ x.T) >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_cells.near_duplicate_vectors(df, rows_per_cell=50).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(axis=1).tolist() and near.sum() >= 2 * n
