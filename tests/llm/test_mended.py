"""Cases that went wrong once: self-similar sequences, letters kept apart by underscores, null ids, and columns with the operators' internal names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from confora.llm import embedding_cells, minhash_join, stages, toxicity
from confora.llm.hashing import PRIME, Fingerprints, Identities, mix
from confora.llm.personal_data import masked, personal_spans
from confora.llm.suffix_array_dedup import remove_repeated_bytes
from confora.llm.suffix_tree_dedup import remove_repeated_words


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


# hashes
def test_fingerprints_of_self_similar_sequences():
    """Polynomials modulo a power of two give equal values for these from 1,024 symbols on."""
    code = mix(np.arange(2, dtype=np.uint64))
    for n in (1024, 2048, 4096, 16384):
        one, other = (Identities(code[np.array(thue_morse(n, *ab))]) for ab in ((0, 1), (1, 0)))
        assert one.at(np.array([0]), n) != other.at(np.array([0]), n)
        assert minhash_join.hashes_of_words("".join(thue_morse(n, "a", "b"))) != minhash_join.hashes_of_words("".join(thue_morse(n, "b", "a")))


def test_fingerprints_depend_on_content_alone():
    rng = np.random.default_rng(1)
    symbols = mix(rng.integers(0, 4, 3000).astype(np.uint64))
    for kind in (Fingerprints, Identities):
        whole = kind(symbols)
        for width in (1, 5, 64, 700):
            starts = np.arange(3001 - width)
            all_of = whole.at(starts, width)
            for at in rng.integers(0, 3000 - width, 20):
                assert kind(symbols[at : at + width]).at(np.array([0]), width)[0] == all_of[at]
            content = {symbols[i : i + width].tobytes() for i in starts}
            assert len(set(all_of.tolist())) == len(content)
        assert kind is Identities or (whole.all(64) == whole.at(np.arange(2937), 64)).all()
    top = Identities(np.full(70_000, PRIME, np.uint64))  # symbols that are 0 in one half
    assert len(set(top.at(np.arange(69_998), 3).tolist())) == 1


def test_near_duplicates_of_self_similar_words(spark):
    pair = ["".join(thue_morse(2048, *ab)) for ab in (("a", "b"), ("b", "a"))]
    rows = [(i, f"{w} one two three four") for i, w in enumerate(pair)]
    got = minhash_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(0, 0, 0), (1, 1, 0)}


def removed_plainly(texts, width, split, join):
    parts = [split(t) for t in texts]
    starts = Counter(tuple(p[i : i + width]) for p in parts for i in range(len(p) - width + 1))
    out = []
    for p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - width + 1):
            if starts[tuple(p[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(p), sum(gone), hashlib.sha256(join([x for x, g in zip(p, gone) if not g])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 2, 30])
@pytest.mark.parametrize("operator, width", [(remove_repeated_words, 40), (remove_repeated_bytes, 48)])
def test_frequent_anchors_take_the_same_way(spark, hot, operator, width):
    """Self-similar texts, long runs of one symbol and passages shared by many, with anchors above and below the bound: windows are compared, not counted by fingerprint."""
    rng = random.Random(width)
    rows = [thue_morse(300, *ab) for ab in (("ab", "cd"), ("cd", "ab"))] + [["ab"] * 200, ["ab"] * 90 + ["x"] + ["ab"] * 90]
    common = [f"w{rng.randrange(50)}" for _ in range(80)]
    rows += [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))] + common[rng.randrange(20) :] + [f"w{i}"] for i in range(25)]
    texts = [" ".join(r) for r in rows] + ["", None, " ".join(rows[5])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = [(r.n_symbols, sum(x["length"] for x in r.removed), r.kept_sha256) for r in operator(frame, window=width, gram=8, hot=hot).orderBy("doc_id").collect()]
    texts = [t or "" for t in texts]
    if operator is remove_repeated_words:
        want = removed_plainly(texts, width, lambda t: t.encode().split(), b" ".join)
    else:
        want = removed_plainly(texts, width, lambda t: list(t.encode()), bytes)
    assert got == want and sum(n for _, n, _ in got) > 1000


# toxicity
def decoder():
    counts = np.zeros(toxicity.N_CLASSES**3, np.int64)
    c = toxicity.classes("\n".join(["you idiot go home", "what a moron you are", "the cat sat on the mat", "stupid people say that"] * 50)).astype(np.int64)
    np.add.at(counts, (c[:-2] * toxicity.N_CLASSES + c[1:-1]) * toxicity.N_CLASSES + c[2:], 1)
    return toxicity.Decoder(counts)


BAD = ("idiot", "moron", "stupid")
WEIGHTS = {int(toxicity.xxh64_intdigest(w) % toxicity.BUCKETS): 3.0 + i for i, w in enumerate(BAD)}
SEPARATED = st.builds(lambda w, s: s.join(w), st.sampled_from([*BAD, "cat", "go", "a"]), st.sampled_from([" ", ".", "-", "_", "*", "", "", "__", ". "]))
MIXED = st.text(alphabet="idotmrnsupe_.-* \n1!0@$#%&()é", max_size=12)
RUNS = st.builds(lambda w, i, n: w[:i] + w[i : i + 1] * n + w[i:], st.sampled_from(BAD), st.integers(0, 4), st.integers(1, 5))


@settings(max_examples=400, deadline=None, database=None)
@given(st.lists(st.one_of(SEPARATED, MIXED, RUNS), max_size=8), st.sampled_from([" ", "  ", "\n", ", "]))
def test_scored_rows_are_restored_as_training_rows_are(parts, glue):
    """What a reader remembers of tokens gives the evidence of the restored text."""
    d, text = decoder_once(), glue.join(parts)
    reader = toxicity.Reader(d, WEIGHTS)
    restored = d.restore(text)
    words = set(toxicity.WORD.findall(restored))
    want = sum(sorted((w for x in words if (w := reader.weight(x)) > 0), reverse=True)[:3])
    found, changed = reader.read(text)
    assert found == pytest.approx(want), (text, restored)
    assert changed == (restored != text.lower()), (text, restored)


_kept = []


def decoder_once():
    if not _kept:
        _kept.append(decoder())
    return _kept[0]


def test_letters_apart_by_any_separator():
    reader = toxicity.Reader(decoder_once(), WEIGHTS)
    for s in " .-_*":
        assert reader.read(f"you {s.join('idiot')} go") == (reader.weight("idiot"), True)


# ids and names
def test_vectors_without_an_id_link(spark):
    """A null id links like any other; it is the least of no component with an id."""
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, -1.0]), (5, None), (None, None)]
    got = embedding_cells.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (5, 0, 5, True), (None, 0, None, True)])


def test_columns_with_internal_names(spark, tmp_path):
    """The pipeline's stages keep columns that are called as their own keys are."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(words), " ".join([*words[:150], "z", *words[151:]]), "write to a.b@example.org now", "quite another text"]
    names = ["__row", "__id", "__tk", "__spans", "id", "class", "stays", "unnamed", "class_id", "n_links"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    spark.createDataFrame([(1, " ".join(words[20:60]) + ". " + " ".join(words[60:90]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = stages.drop_near_duplicates(spark, frame, str(tmp_path))
    assert left.columns == frame.columns and {r.doc_id: r["__row"] for r in left.collect()} == {0: "__row0", 2: "__row2", 3: "__row3"}
    left = stages.drop_contaminated(spark, frame, str(tmp_path))
    assert left.columns == frame.columns and {r["__row"] for r in left.collect()} == {"__row2", "__row3"}
    clean = masked(frame, personal_spans(frame))
    assert clean.columns == frame.columns and {(r.text, r["__id"], r["__spans"]) for r in clean.where("doc_id = 2").collect()} == {("write to <email> now", "__id2", "__spans2")}
