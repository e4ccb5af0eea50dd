from pyspark.sql import functions as F

from doclint.functions import contact as ct
from doclint.functions import dates as dt
from doclint.functions import text as tx
from doclint.functions.lexicon import DEFAULT, tokenize_entry


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_normalize(spark):
    raw = "a\r\n\r\n\r\n\r\nb‮\x00 ﻿c \t d ﬁ  "
    r = one(spark, t=tx.normalize_text(F.lit(raw)), s=tx.normalize_struct(F.lit("x" * 30), 10))
    assert r.t == "a\n\nb c d fi"
    assert r.s.text == "x" * 30 and r.s.truncated


def test_tokenize_matches_lexicon_twin(spark):
    samples = ["C++ C# Node.js .NET CI/CD front-end C/C++ React's", "a/../b x./y asp.net .net .net", "São ß 2019-2024 e.g. +55", ""]
    rows = spark.createDataFrame([(s,) for s in samples], "t STRING").select("t", tx.tokenize(F.col("t")).alias("k")).collect()
    for r in rows:
        assert r.k == tokenize_entry(r.t)
    assert rows[0].k == "c++ c# node.js dotnet ci/cd front end c c++ react".split()


def test_stem(spark):
    words = "gestoes services service processes process spring string business status designed design features".split()
    got = one(spark, s=tx.stem_array(F.array(*[F.lit(w) for w in words]))).s
    assert got == "gestao servic servic process process spring string business status design design featur".split()


def test_phrase_count(spark):
    r = one(spark, pair=tx.count_phrase(F.lit(" a a a "), "a a"), single=tx.count_phrase(F.lit(" a a a "), "a"))
    assert (r.pair, r.single) == (1, 3)


def test_phones(spark):
    yes = ["(11) 4002-8922", "+55 11 91234-5678", "11912345678"]
    no = ["12345-678", "123.456.789-09", "01.2019 - 12.2022", "2019 2020 2021", "12345678"]
    assert all(one(spark, p=ct.is_phone(F.lit(x))).p for x in yes)
    assert not any(one(spark, p=ct.is_phone(F.lit(x))).p for x in no)


def test_links_and_privacy(spark):
    r = one(
        spark, cut=ct.broken_url(F.lit("see linkedin.com/in/jane-\ndoe")), whole=ct.broken_url(F.lit("see linkedin.com/in/jane-\n\ndoe")),
        label=ct.linkedin_state(F.lit("my LinkedIn")), bad=ct.safe_url(F.lit("javascript:alert(1)")), ok=ct.safe_url(F.lit("Example.com")),
        p=ct.personal_kinds(F.lit("brasileiro | 27 anos | solteiro\nrg: 12")), q=ct.personal_kinds(F.lit("10 anos de experiencia")),
    )
    assert (r.cut, r.whole, r.label, r.bad, r.ok) == ("linkedin.com/in/jane-", None, "label", None, "https://example.com/")
    assert r.p == ["idCard", "age", "maritalStatus"] and r.q == []


def test_months(spark):
    cases = {"2021-03": "2021-03", "2021-3-15": "2021-03", "3.2021": "2021-03", "março de 2021": "2021-03", "2021": "2021", "13/2021": "", "1900": ""}
    for raw, want in cases.items():
        assert one(spark, m=dt.normalize_month(F.lit(raw))).m == want


def test_lexicon_sizes():
    assert (len(DEFAULT.job_noise), len(DEFAULT.action_verbs), len(DEFAULT.skills), len(DEFAULT.weak_phrases)) == (282, 201, 166, 43)
    assert DEFAULT.weak_disjoint
