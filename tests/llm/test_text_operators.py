"""Operators on single texts against plain versions, on edge cases."""

import brute
import edge_cases
import pytest
import regex

from doclint.llm import bpe, html_text, pii, quality_rules, secret_scan, token_counts

by_id = lambda found: sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"]))


def inputs():
    return sorted(((r[0], r[1]) for r in edge_cases.rows()), key=lambda r: (r[0] is None, r[0]))


def plain_rules(text):
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {w: windows.count(w) for w in set(windows)} if len(windows) < 2000 else {}
    covered = {i + j for i, w in enumerate(windows) if counts.get(w, 0) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(windows) < 2000


def test_quality_rules(spark):
    found = by_id(quality_rules.ledger(edge_cases.frame(spark)).collect())
    assert len(found) == len(inputs())
    for r, (doc, text) in zip(found, inputs(), strict=True):
        n, chars, symbols, dup, repeat, small = plain_rules(text)
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (doc, n, chars, symbols, dup)
        assert not small or r.n_repeat_words == repeat


def test_policies_and_ablations(spark):
    entries = quality_rules.ledger(edge_cases.frame(spark)).cache()
    judged = quality_rules.apply_policy(entries, "base-1").collect()
    assert all(r.kept == (not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)) for r in judged)
    for policy in quality_rules.POLICIES:
        bits = [r.fail_bits & quality_rules.mask(quality_rules.POLICIES[policy]) for r in entries.collect()]
        for r in quality_rules.ablations(entries, policy).collect():
            bit = quality_rules.mask([r.rule])
            assert (r.n_failed, r.n_only_this) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
    kept = quality_rules.keep_good(edge_cases.frame(spark))
    assert kept.columns == edge_cases.frame(spark).columns
    assert kept.count() == quality_rules.apply_policy(entries).filter("kept").count()


def test_personal_data(spark):
    docs = edge_cases.frame(spark)
    model = pii.fit(docs)
    for r, (doc, text) in zip(by_id(pii.find(docs, model).collect()), inputs(), strict=True):
        assert r.doc_id == doc
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == brute.pii_base(text)
        assert all((text or "")[s.start : s.end] == s.value for s in r.spans)
    masked = pii.redact(docs, model)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[0] is None and texts[1] == ""
    assert not any(brute.pii_base(t) for t in texts.values() if t)


def test_votes_decide_added_spans(spark):
    rows = [(i, f"call phone (415) 55{i % 10}-12{i:02d} now") for i in range(40)] + [(100 + i, f"order number 123-45-67{i:02d} x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(docs, pii.fit(docs)).collect()}
    assert all(set(k) <= {"local_phone", "social_number"} for k in found.values())
    assert sum("local_phone" in found[i] for i in range(40)) > 20


def test_secrets(spark):
    for r, (doc, text) in zip(by_id(secret_scan.find(edge_cases.frame(spark)).collect()), inputs(), strict=True):
        assert r.doc_id == doc
        assert [(s.kind, s.start, s.end) for s in r.base] == brute.secrets_base(text)
        assert [s for s in r.spans if s.kind != secret_scan.LEARNED] == r.base


def test_learned_format_is_found_without_its_cue(spark):
    import random

    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789") if i % 2 else rng.choice("GHJKLMNPQRSTUVWXYZ") for i in range(24))
    rows = [(i, f"secret = {key()} end") for i in range(300)] + [(1000, f"see {key()} here"), (1001, "plain-words-with-hyphens-only 2024-01-01T00:00:00")]
    found = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1000] == ["learned"] and found[1001] == []


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.public_path())
    docs = edge_cases.frame(spark)
    tokenizer = bpe.Tokenizer(spark, bpe.public_path(), bpe.frequent_words(docs))
    both = bpe.decode(bpe.encode(docs, tokenizer), tokenizer).collect()
    assert by_id(bpe.encode(docs, tokenizer, round_trip=True).collect()) == by_id(both)
    for r, (doc, text) in zip(by_id(both), inputs(), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.ids, r.decoded) == (doc, ids, library.decode(ids, skip_special_tokens=False))


def test_transducer_numbers_every_word():
    import numpy as np

    words = sorted({w.encode() for w in "a ab abc b bc tap taps top tops stop stops über".split()})
    ids = np.arange(len(words), dtype=np.int32)
    lexicon = bpe.Lexicon(bpe.compile_words(words, ids, np.arange(len(words) + 1)))
    assert lexicon.numbers_of([*words, b"", b"to", b"topss", b"zz"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(lexicon.final) < 1 + sum(map(len, words))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = bpe.public_path(name)
    with open(path, "rb") as f:
        counter = token_counts.Counter(f.read(), path[path.rindex(".") :])
    found = by_id(token_counts.count_tokens(edge_cases.frame(spark), path).collect())
    for r, (doc, text) in zip(found, inputs(), strict=True):
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (doc, len((text or "").encode()), counter.counts([text or ""])[0])
    if counter.stable:
        for text in (t for _, t in inputs() if t and len(t) < 50_000):
            assert counter.spliced(text, 64, 8) == counter.counts([text])[0]


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="ad">Buy &amp; save</div><article><h1>Head&nbsp;line</h1><p>One  <b>bold</b>&lt;\n text<p>Two<br>more</p>
<aside>side note</aside><div class="comments"><p>first!</p></div></article><footer>&copy; x</footer><script>var t="</p>"</script></body></html>"""


def test_html(spark):
    plain = "<div><p>" + "A paragraph that is long enough to be text. " * 4 + "</p></div><div id='menu'><a>x</a><a>y</a></div>"
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", plain, 0), (5, "x", "<p>" * 3000 + "deep", 0), (None, "y", "<<<>&#0;", 0)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    texts = [r.text for r in found]
    assert texts[0] == texts[1] == "Head line\nOne bold< text\nTwo more"
    assert texts[2] == texts[3] == "" and texts[4].startswith("A paragraph") and "x" not in texts[4].split() and texts[5] == "deep"


def test_no_rows(spark):
    docs = edge_cases.frame(spark, [])
    tokenizer = bpe.Tokenizer(spark, bpe.public_path(), bpe.frequent_words(docs))
    for df in (
        quality_rules.ledger(docs), quality_rules.ablations(quality_rules.ledger(docs)), pii.find(docs, pii.fit(docs)), pii.redact(docs, pii.fit(docs)),
        secret_scan.find(docs), bpe.decode(bpe.encode(docs, tokenizer), tokenizer), token_counts.count_tokens(docs, bpe.public_path()),
        html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.collect() == [] or df.columns == ["rule", "n_failed", "n_only_this"]
