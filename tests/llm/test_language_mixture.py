"""Language mixtures: held-out accuracy, mixed texts, and a plain expectation-maximisation for one text."""

import math
from collections import Counter

import edge_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from doclint.llm import language_mixture as lm

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return lm.fit(docs, may_learn=~lm.held_out(F.col("doc_id")))


def test_held_out_accuracy(spark, docs):
    found = lm.query(spark, FOLDER)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out and r.lang]
    assert 0.2 < len(unseen) / len(rows) < 0.45
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.98 * len(unseen)


def test_nothing_is_learned_from_the_held_out(docs):
    turned = docs.withColumn("lang", F.when(lm.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in lm.fit(turned, may_learn=~lm.held_out(F.col("doc_id"))).languages


def plain_set(text, model):
    """Trigrams, mixtures and the choice of the set for one text, word for word as described."""
    flat = "".join(chr(lm.LETTER[b]) for b in text.encode())
    flat = f" {' '.join(flat.split(' '))} "
    while "  " in flat:
        flat = flat.replace("  ", " ")
    grams = Counter()
    for i in range(len(flat) - 2):
        if flat[i + 1] != " ":
            g = (ord(flat[i]) << 16) | (ord(flat[i + 1]) << 8) | ord(flat[i + 2])
            grams[((g * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - model.bits)] += 1
    if not grams:
        return {}
    total = sum(grams.values())

    def em(chosen):
        theta = {x: 1 / len(chosen) for x in chosen}
        for _ in range(lm.ROUNDS if len(chosen) > 1 else 0):
            new = dict.fromkeys(chosen, 0.0)
            for g, n in grams.items():
                norm = sum(theta[x] * float(model.shares[g, x]) for x in chosen)
                for x in chosen:
                    new[x] += n * theta[x] * float(model.shares[g, x]) / norm
            new = {x: v / total for x, v in new.items()}
            moved = max(abs(new[x] - theta[x]) for x in chosen)
            theta = new
            if moved < lm.CLOSE:
                break
        return theta, sum(n * math.log(sum(theta[x] * float(model.shares[g, x]) for x in chosen)) for g, n in grams.items())

    every = range(len(model.languages))
    rough = em(list(every))[0]
    order = sorted(every, key=lambda x: -rough[x])
    best, out = -math.inf, {}
    for k in range(1, len(order) + 1):
        theta, value = em(order[:k])
        value -= (k - 1) * (lm.RATE * total + 0.5 * math.log(total + 1))
        if value <= best:
            break
        best, out = value, theta
    return {model.languages[x]: v for x, v in out.items() if v > 0}


def test_mixtures_equal_the_plain_version(spark, docs, model):
    some = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(40).collect()]
    by_lang = {r.lang: r.text for r in docs.filter(F.length("text") > 3000).orderBy("doc_id").collect()}
    mixed = " ".join(x[-1500:] for x in (by_lang["en"], by_lang["fr"]))
    some += [(1000, mixed), (1001, by_lang["de"][:300])]
    found = {r.doc_id: r.languages for r in lm.identify(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), model).collect()}
    for doc, text in some:
        want = plain_set(text, model)
        # the batch stops when all of its texts are close, one text alone earlier
        assert set(found[doc]) == set(want) and all(abs(found[doc][x] - want[x]) < 0.02 for x in want), doc
    assert set(found[1000]) == {"en", "fr"} and all(0.4 < v < 0.6 for v in found[1000].values())


def test_edge_cases(spark, model):
    rows = lm.identify(edge_cases.frame(spark), model).collect()
    assert len(rows) == len(edge_cases.rows())
    for r in rows:
        text = next(t for d, t, *_ in edge_cases.rows() if d == r.doc_id) if r.doc_id is not None else edge_cases.texts()[8]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and (r.score == 0) == (r.lang_pred == "und")


def test_pieces_of_a_long_text_count_like_the_whole():
    raw = np.frombuffer(("Ça va bien, the end of it. " * 400).encode(), np.uint8)
    bounds = np.array([0, len(raw)])
    whole, pieces = lm.counted(raw, bounds, 16), lm.counted(raw, bounds, 16, most=4096)
    assert abs(whole[2].sum() - pieces[2].sum()) <= 2 * (len(raw) // 4096)
    assert set(whole[1]) <= set(pieces[1])


def test_nothing_to_learn(spark):
    empty = edge_cases.frame(spark, [])
    assert lm.fit(empty).languages == []
    assert {r.lang_pred for r in lm.identify(edge_cases.frame(spark), lm.fit(empty)).collect()} == {"und"}
    assert lm.identify(empty, lm.fit(empty)).collect() == []


def test_many_labels(spark):
    some = spark.createDataFrame([(i, f"text number {i}", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    model = lm.fit(some)
    assert len(model.languages) == 300 and model.shares.nbytes <= lm.MODEL and model.bits < lm.BITS
