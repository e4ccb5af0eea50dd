"""Spans that the vote adds: none inside base spans, and most of those planted in each kind."""

import random

import pytest

from doclint.llm import pii

rng = random.Random(9)
digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))


def account():
    country, rest = rng.choice(("DE", "FR", "ES", "PL")), digits(18)
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country) + "00") % 97
    return f"{country}{check:02d}{rest}"


PLANTED = {
    "masked_email": lambda: f"please write mail to joe{digits(3)} [at] mail{digits(1)} [dot] com thanks",
    "local_phone": lambda: f"call me, phone ({rng.randint(2, 9)}{digits(2)}) {rng.randint(2, 9)}{digits(2)}-{digits(4)} today",
    "social_number": lambda: f"my ssn is {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} for the tax office",
    "bank_account": lambda: f"pay to iban {account()} at the bank",
}


@pytest.fixture(scope="module")
def rows():
    out = [(kind, make()) for kind, make in PLANTED.items() for _ in range(80)]
    out += [("clean", f"order number {digits(3)}-{digits(2)}-{digits(4)} shipped, invoice {digits(8)} of page {digits(2)}") for _ in range(120)]
    out += [("base", f"phone +1 ({digits(3)}) {digits(3)}-{digits(4)}, mail a{digits(2)}@b.com, host 10.0.{rng.randint(1, 99)}.7, card 4111 1111 1111 1111") for _ in range(80)]
    return [(i, kind, text) for i, (kind, text) in enumerate(out)]


@pytest.fixture(scope="module")
def found(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    return {r.doc_id: r.spans for r in pii.find(docs, pii.fit(docs)).collect()}


def test_recall_of_each_added_kind(rows, found):
    for kind in PLANTED:
        own = [i for i, k, _ in rows if k == kind]
        assert sum(any(s.kind == kind for s in found[i]) for i in own) >= 0.9 * len(own), kind


def test_no_added_span_touches_a_base_span(rows, found):
    for i, kind, _ in rows:
        base = [s for s in found[i] if s.kind in pii.BASE]
        assert not any(s.start < b.end and b.start < s.end for s in found[i] if s.kind not in pii.BASE for b in base)
        assert kind != "base" or [s.kind for s in found[i]] == ["email", "ip", "card", "phone"]


def test_most_clean_rows_stay_clean(rows, found):
    own = [i for i, k, _ in rows if k == "clean"]
    assert sum(not found[i] for i in own) >= 0.9 * len(own)


def test_check_digits(spark):
    from pyspark.sql import functions as F

    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    frame = spark.createDataFrame([(g,) for g in good] + [(g[:-1] + ("1" if g[-1] != "1" else "2"),) for g in good], "v string")
    assert [r.ok for r in frame.select(pii.account_check(F.col("v")).alias("ok")).collect()] == [True] * 3 + [False] * 3
