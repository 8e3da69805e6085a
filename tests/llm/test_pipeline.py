"""The pipeline: registered queries run, every stage takes effect and keeps the columns of documents."""

import __spark_entry__
import corpus_pipeline
from confora.llm.common import written

SF = "/root/testdata/sf0.001"


def test_registration():
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # planted: an exact and a near copy, a leak, personal data, nulls
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(9001, long, "en", "s", 1), (9002, long, "en", "s", 1), (9003, long.replace("word7 ", "other "), "en", "s", 1), (9004, f"{long[:500]} {bench} {long[600:]}", "en", "s", 1), (9005, "reach me at someone@example.org today", "en", "s", 1), (9006, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        if name != "sentencepiece":
            assert docs.schema.simpleString() == before.schema.simpleString()
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "personal_data":
            assert docs.where("doc_id = 9005").first().text == "reach me at <email> today"
    assert {9001, 9005, 9006} <= ids["sentencepiece"]
    assert not {9002, 9003} & ids["near_duplicates"] and 9004 in ids["near_duplicates"] and 9004 not in ids["decontamination"]
    assert docs.where("round_trip").count() == docs.count()


def test_null_and_repeated_ids_are_dropped_too(spark):
    from confora.llm import stages

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    copy = lambda k: " ".join(f"{k}{i}" for i in range(200))
    rows = [(None, copy("a")), (None, copy("a")), (None, copy("a").replace("a7 ", "b ")), (5, copy("c")), (5, copy("c")), (3, copy("d")), (2, copy("d")), (None, copy("d")), (None, f"{copy('e')} {bench}"), (5, copy("f")), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    once = written(stages.drop_near_duplicates(spark, docs, SF))
    assert once.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:2]) for r in stages.drop_contaminated(spark, once, SF).collect())
    assert got == [("2", "d0"), ("5", "c0"), ("5", "f0"), ("None", ""), ("None", "a0")]


def test_every_stage_equals_a_plain_version(spark):
    """The five stages over all documents of the smallest tables, against loops over rows on the driver."""
    import re
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from test_operators import base_spans

    from confora.llm import bm25_wand, minhash_join, toxicity, unigram

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    stages = dict(corpus_pipeline.STAGES)

    # toxicity: the model fitted and applied text by text, without remembered tokens
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect():
        labels[r.doc_id] = max(r.toxic, labels.get(r.doc_id, 0))
    counts = Counter()
    for t in rows.values():
        c = [toxicity.EDGE, toxicity.EDGE, *toxicity.classes(t or "").tolist(), toxicity.EDGE, toxicity.EDGE] if t else []
        counts.update(zip(c, c[1:], c[2:], strict=False))
    dense = np.zeros((toxicity.N_CLASSES,) * 3, np.int64)
    for k, n in counts.items():
        dense[k] = n
    restore = toxicity.Decoder(dense.ravel()).restore
    fit = {i: y for i, y in labels.items() if i in rows and zlib.crc32(str(i).encode()) % 5}
    seen = {i: toxicity.features(restore(rows[i] or "")) for i in fit}
    tox, clean = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)
    for i, f in seen.items():
        (tox if fit[i] else clean)[np.unique(f)] += 1
    n1, n0 = sum(fit.values()), len(fit) - sum(fit.values())
    clean[tox < 2] = tox[tox < 2] = 0
    e = np.array([toxicity.left_out(fit[i], seen[i], tox, clean, n1, n0) for i in fit])
    y = np.array(list(fit.values()), float)
    by = np.lexsort((y, e))
    c0, c1 = toxicity.calibrated(e[by], y[by])
    weight = toxicity.bounds(tox, clean, n1, n0)

    def toxic(text):
        words = sorted(set(toxicity.WORD.findall(restore(text or ""))))
        found = sorted((w for w in (weight[toxicity.buckets(words)].max(axis=1) if words else []) if w > 0), reverse=True)[:3]
        return c0 + c1 * sum(found) >= 0

    kept = {i: t for i, t in rows.items() if not toxic(t)}
    got = written(stages["toxicity"](spark, docs, SF))
    assert {r.doc_id: r.text for r in got.collect()} == kept and len(kept) < len(rows)

    # near duplicates: all pairs
    sets = {i: set(minhash_join.ngram_set(t).tolist()) if t else set() for i, t in kept.items()}
    label = {i: i for i in kept}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    for _ in range(len(kept)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    kept = {i: t for i, t in kept.items() if label[i] == i}
    got = written(stages["near_duplicates"](spark, got, SF))
    assert {r.doc_id: r.text for r in got.collect()} == kept and pairs

    # decontamination: every passage against every item
    items = [(r.item_id, *bm25_wand.split_answer(r.text or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = bm25_wand.Index([x for x in items if bm25_wand.words(x[1]) or bm25_wand.words(x[2])])

    def leaks(text):
        ws = bm25_wand.words(text)
        for lo in range(0, len(ws), index.longest):
            passage = ws[lo : lo + 2 * index.longest]
            score = Counter()
            for x in {index.term.get(w, 0) for w in passage}:
                for k, s in zip(index.items[x], index.impact[x], strict=True):
                    score[k] += s
            for k, s in score.items():
                if s >= 0.5 - 1e-9:
                    q, a, whole = (bm25_wand.tolerant_overlap(p, passage, 5, 0.8) for p in (*index.parts[k], index.full[k]))
                    if min(q, a) >= 0.8 or whole >= 0.8:
                        return True
        return False

    clean_of = {i: t for i, t in kept.items() if not leaks(t)}
    got = written(stages["decontamination"](spark, got, SF))
    assert {r.doc_id: r.text for r in got.collect()} == clean_of and len(clean_of) < len(kept)

    # personal data: the shapes as plain patterns; the documents' contexts give nothing further away
    def masked(text):
        if text is None:
            return None
        secrets = [(4, m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in base_spans(text) + secrets):
            if s >= at:
                out += [text[at:s], f"<{('email', 'ip', 'card', 'phone', 'secret')[k]}>"]
                at = e
        return "".join(out) + text[at:]

    want = {i: masked(t) for i, t in clean_of.items()}
    got = written(stages["personal_data"](spark, got, SF))
    assert {r.doc_id: r.text for r in got.collect()} == want and want != clean_of
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)

    # pieces: each text alone, and back again
    model = unigram.Unigram(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    pieces = {r.doc_id: r.pieces for r in stages["sentencepiece"](spark, got, SF).collect()}
    assert pieces == {i: model.encode_all([t or ""], {})[0].tolist() for i, t in want.items()}
    assert all(model.decode(pieces[i]) == (t or "") for i, t in want.items())
