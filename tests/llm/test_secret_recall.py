"""Recall of learned formats without their cue: short keys and dotted keys."""

import random

import pytest

from doclint.llm import secret_scan

DIGITS, UPPER, LOWER = "0123456789", "GHJKLMNPQRSTUVWXYZ", "abcdefghijklmnop"


def short(rng):
    return "".join(rng.choice(DIGITS if i % 2 else UPPER) for i in range(10))


def dotted(rng):
    return ".".join("".join(rng.choice(DIGITS + LOWER) for _ in range(8)) for _ in range(3))


# where labelled values are dotted, host names have their format too and are found with them
PLAIN = "chapter{0}.end of mail{0}.example.com, 2024-01-0{1} and v1.{0}.0 in plain-words"


@pytest.mark.parametrize("make,plain", [(short, PLAIN), (dotted, "2024-01-0{1} in plain-words-with-hyphens PAGE{0} 2024-01-01T00:00:00")])
def test_recall_of_keys_without_their_cue(spark, make, plain):
    rng = random.Random(4)
    rows = [(i, f"secret = {make(rng)} end") for i in range(300)]
    planted = {1000 + i: f"see {make(rng)} here." for i in range(100)}
    clean = {2000 + i: plain.format(i, i % 9) for i in range(100)}
    docs = spark.createDataFrame([*rows, *planted.items(), *clean.items()], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secret_scan.find(docs).collect()}
    caught = [i for i, t in planted.items() if any(s.kind == secret_scan.LEARNED and t[s.start : s.end] == t.split()[1] for s in found[i])]
    assert len(caught) >= 90
    assert sum(not found[i] for i in clean) >= 90


def test_every_labelled_value_is_learned(spark):
    rng = random.Random(5)
    long = lambda: "".join(short(rng) for _ in range(14))
    rows = [(i, f"token: {short(rng)} end") for i in range(1200)]
    rows += [(5000 + i, f"secret = {long()} end") for i in range(30)]
    docs = spark.createDataFrame([*rows, (9000, f"see {long()} here")], "doc_id long, text string")
    automaton, least = secret_scan.learn(secret_scan.cut(secret_scan.scan(docs)))["assign"]
    assert automaton.visits[0] == 1230
    assert all(automaton.score(t.split()[-2]) > float("-inf") for _, t in rows)
    found = {r.doc_id: r.spans for r in secret_scan.find(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in found[9000]] == [(secret_scan.LEARNED, 4, 144)]
