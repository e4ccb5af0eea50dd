"""Operators on whole corpora against plain versions."""

import brute
import corpus_pipeline
import edge_cases
import numpy as np
import pytest

from doclint.llm import components, decontaminate, ngram_join, quality_model, registry, suffix_dedup

SF = "/root/testdata/sf0.001"


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_jaccard_join(spark):
    rows = [(r[0], r[1]) for r in edge_cases.rows() if r[0] is not None]
    for k, threshold in ((4, 85), (5, 80)):
        want = brute.jaccard_components(rows, k, threshold)
        found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k, threshold).collect()
        assert len(found) == len(rows)
        assert {r.doc_id: (r.n, r.component_id) for r in found} == want


def test_jaccard_query(spark):
    found = registry.QUERIES["op3_ngram_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard_components(texts(spark), 4, 85)


def test_near_copies_chain(spark):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each differs from the next by one word, so ends are only linked by the chain
        words = [*words[:i], f"c{i}", *words[i + 1 :]]
        rows.append((i, " ".join(words)))
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n, r.component_id) for r in found} == brute.jaccard_components(rows, 4, 85)
    assert {r.component_id for r in found} == {0}


def test_one_of_each_group_stays(spark):
    docs = edge_cases.frame(spark)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [r for r in edge_cases.rows() if r[0] is not None]
    want = brute.jaccard_components([(r[0], r[1]) for r in rows], 5, 80)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(d for d, (n, c) in want.items() if c == d and d != 8)  # the row without a doc_id copies 8 and comes first


def test_signature_bound_never_rejects_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 90)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.integers(0, 400, rng.integers(0, 8)).astype(np.uint64))))
        if len(b):
            both = len(np.intersect1d(a, b))
            links = 100 * both >= 85 * (len(a) + len(b) - both)
            bits = [ngram_join.bitmap(x, ngram_join.width(len(x))) for x in (a, b)]
            assert ngram_join.linked(a, b, 85) == links and (ngram_join.may_link(len(a), len(b), *bits, 85) or not links)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate((s[: len(s) // 2], sets[0]))) for s in sets[:10]]
    found = ngram_join.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert int(np.bitwise_count((found[i] ^ found[j]).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (200, 201)]
    found = {r.key: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 140)) and found[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("length,batches", [(400, 2), (80, 3)])
def test_suffix_dedup(spark, length, batches):
    rows = edge_cases.rows()
    want = brute.without_repeats([r[1] for r in rows], length)
    found = suffix_dedup.remove_repeats(edge_cases.frame(spark), length, batches).collect()
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)


def test_suffix_query(spark):
    want = brute.without_repeats([t for _, t in texts(spark)], 400)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op2_suffix_dedup"](spark, SF).collect()}
    assert found == {d: (*w[:3], brute.sha(w[3])) for (d, _), w in zip(texts(spark), want, strict=True)}


def test_decontamination(spark, monkeypatch):
    rows = edge_cases.rows()
    items = [("i1", rows[7][1]), ("i2", "a b c"), ("i2", "Edh1"), (None, "word"), ("i3", None), ("i4", " ".join((rows[8][1] or "").split(" ")[2:9])), ("i1", rows[7][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.contamination([r[1] for r in rows], [(i or "", t) for i, t in items])
    key = lambda r: (r[0] is None, r[0], r[1:])
    for block in (decontaminate.BLOCK, 60):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        found = decontaminate.flag(edge_cases.frame(spark), bench, prefix="z_").collect()
        assert sorted(((r.doc_id, r.z_n_words, len(r.z_hits), r.z_items) for r in found), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
    kept = decontaminate.clean(edge_cases.frame(spark), bench)
    assert kept.columns == edge_cases.frame(spark).columns and kept.count() == sum(h == 0 for _, h, _ in want)
    assert decontaminate.clean(edge_cases.frame(spark), bench.limit(0)).count() == len(rows)


def test_decontamination_query(spark):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = texts(spark)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in registry.QUERIES["op9_decontaminate"](spark, SF).collect()}
    want = brute.contamination([t for _, t in rows], items)
    assert found == {d: (n, h, len(i), brute.sha(",".join(i)), h > 0) for (d, _), (n, h, i) in zip(rows, want, strict=True)}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in registry.QUERIES["op1_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)


def test_quality_edge_cases(spark):
    docs = edge_cases.frame(spark)
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, 0), (8, 1), (None, 1), (9, None), (999, 1)], "doc_id long, quality int")
    found = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    assert len(found) == docs.count() and len({r.score for r in found if r.doc_id in (0, 1, 2, 3)}) == 1
    assert {r.score for r in quality_model.score(docs, quality_model.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), np.zeros((1 << quality_model.BITS) + 1)).count() == 0


def test_no_rows(spark):
    docs = edge_cases.frame(spark, [])
    bench = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert ngram_join.join(docs).count() == 0 and ngram_join.keep_first(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0 and decontaminate.clean(docs, bench).count() == 0


def test_pipeline_on_edge_cases(spark, tmp_path):
    for some in (edge_cases.rows(), []):
        docs = edge_cases.frame(spark, some)
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:]:  # decontamination reads the benchmark: below
            docs = stage(spark, docs, SF)
            assert docs.columns == columns or docs.columns == ["doc_id", "n_tokens", "ids"]
        docs.collect()
        assert corpus_pipeline.benchmarks(spark, edge_cases.frame(spark, some), SF).columns == columns


def test_pipeline_rows(spark):
    from tokenizers import Tokenizer

    from doclint.llm import bpe, pii, quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bits = {r.doc_id: r.kept for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    rows = [(d, t) for d, t in texts(spark) if bits[d]]
    groups = brute.jaccard_components(rows, 5, 80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, (_, h, _) in zip(rows, brute.contamination([t for _, t in rows], items), strict=True) if not h]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.redact(kept, pii.fit(kept)).collect()}
    library = Tokenizer.from_file(bpe.public_path())
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == {d: library.encode(t, add_special_tokens=False).ids for d, t in masked.items()}
    assert not any(brute.pii_base(t) for t in masked.values())
