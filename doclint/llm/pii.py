"""Personal data by weak supervision, in native column functions.

Patterns propose candidate spans in every text. Labelers vote on each candidate (1 personal, 0 not, null abstains): the
pattern's own validity test, a gazetteer, words before the span, words that speak against it, and the shape of the number.
Expectation maximisation estimates, from the counts of the distinct vote patterns (at most 3^5 a family, so the table is
bounded), how reliable each labeler is, and the posterior of every pattern trains the final span classifier, a naive Bayes
model over family, votes and length. Spans of the four base kinds that pass their tests always stay; other candidates are
added when the classifier gives them ``ACCEPT`` or more.

Defined results: a null or empty text has no spans. Positions are code points, ends exclusive. Repeated rows are handled one
by one. Without candidates the model keeps its priors. Other columns are untouched (:func:`redact`) or not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, text_of

# The base patterns. Guards and possessive parts change no match; they keep matching linear and free of deep
# recursion (a span can only start where its run of characters starts, or where the last match ended).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Added kinds: pattern, and a cheap pattern without which the text has none.
ADDED = {
    "masked_email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]{1,63}+){1,5}+", r"(?i)[\[(]\x20?at\x20?[\])]"),
    "local_phone": (r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "social_number": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "bank_account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
    "card_like": (CARD, r"[0-9]"),
}
KINDS = (*BASE, *ADDED)
ACCEPT = 0.9
# Gazetteers and cues.
TOP_DOMAINS = "com net org edu gov mil int info biz io co de fr es it uk us eu ch at nl be pt br mx ar ca au jp cn in".split()
BANK_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY "
    "MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
).split()
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel", "masked_email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "ip|address|host|server|from|client|login", "card": "card|visa|amex|master|credit|carte|tarjeta|karte|pay",
    "card_like": "card|visa|amex|master|credit|carte|tarjeta|karte|pay", "phone": "phone|tel|call|mobile|cell|fax|handy",
    "local_phone": "phone|tel|call|mobile|cell|fax|handy", "social_number": "ssn|social|security|tax", "bank_account": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|build|page|ref|number|model|part)[\x20:#.]*$"
LABELERS = ("valid", "gazetteer", "context", "against", "shape")


def located(text: Column, pattern: str, present: str, kind: str) -> Column:
    """Matches as ``array<struct<kind, start, end, value>>``. The pieces between matches give the positions."""
    out = f"array<struct<kind:string,start:int,end:int,value:string>>"
    found = let(
        F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")),
        lambda s: F.aggregate(
            F.arrays_zip(s["hits"].alias("hit"), F.slice(s["gaps"], 1, F.size(s["hits"])).alias("gap")),
            F.struct(F.lit(0).alias("pos"), F.array().cast(out).alias("spans")),
            lambda a, x: let(a["pos"] + F.length(x["gap"]), lambda p: F.struct(
                (p + F.length(x["hit"])).alias("pos"),
                F.concat(a["spans"], F.array(F.struct(
                    F.lit(kind).alias("kind"), p.alias("start"), (p + F.length(x["hit"])).alias("end"), x["hit"].alias("value"),
                ))).alias("spans"),
            )),
        )["spans"],
    )
    return F.when(text.rlike(present), found).otherwise(F.array().cast(out))


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(
        d.cast("int") * (F.lit(1) + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)
    ))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def account_check(value: Column) -> Column:
    """The check digits of a bank account: the number, country last and letters as 10 to 35, leaves 1 by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4))), "")
    digit = lambda c: c.cast("int")
    rest = F.aggregate(
        F.filter(signs, lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + digit(c)) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _valid(kind: str, value: Column) -> Column:
    """The kind's own test."""
    n = F.length(digits_of(value))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(digits_of(value))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "social_number":
        return ~value.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def candidates(text: Column) -> Column:
    """Base spans that pass their tests, and all candidates of the added kinds that touch none of them."""
    base = F.concat(
        located(text, EMAIL, "@", "email"),
        F.filter(located(text, IP, r"[0-9]\.[0-9]", "ip"), lambda s: _valid("ip", s["value"])),
        F.filter(located(text, CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "card"), lambda s: _valid("card", s["value"])),
        F.filter(located(text, PHONE, r"\+[0-9]", "phone"), lambda s: _valid("phone", s["value"])),
    )
    added = [located(text, pattern, present, kind) for kind, (pattern, present) in ADDED.items() if kind != "card_like"]
    added.append(F.filter(
        located(text, CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "card_like"), lambda s: ~_valid("card", s["value"])
    ))
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda b: F.filter(F.concat(*added), lambda a: ~F.exists(b, lambda x: touches(a, x)))
    return let(base, lambda b: F.concat(b, free(b)))


def _by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    """The column of the span's kind, null for a kind without one."""
    return reduce(lambda w, k: w.when(kind == k, cases[k]), cases, F.when(F.lit(False), F.lit(None)))


def features(text: Column, span: Column) -> Column:
    """The labelers' votes and the length class of one candidate."""
    kind, value = span["kind"], span["value"]
    before = F.lower(F.substring(text, F.greatest(span["start"] - 31, F.lit(1)), F.least(span["start"], F.lit(32))))
    n = F.length(digits_of(value))
    domain = F.element_at(F.split(F.lower(value), r"[.\x20\])]+"), -1)
    known = _by_kind(kind, {
        "email": domain.isin(TOP_DOMAINS), "masked_email": domain.isin(TOP_DOMAINS), "bank_account": F.left(value, F.lit(2)).isin(BANK_COUNTRIES),
        "card": value.rlike("^[3-6]"), "card_like": value.rlike("^[3-6]"), "phone": ~value.rlike(r"^\+0"), "ip": ~value.rlike(r"^(?:0|127|255)\."),
    })
    shaped = _by_kind(kind, {
        "card": n.isin(15, 16), "card_like": n.isin(15, 16), "phone": n.between(10, 13), "local_phone": ~value.rlike(r"^\(?[01]"),
        "bank_account": n >= 10, "ip": ~value.rlike(r"(?:^|\.)0[0-9]"), "email": value.rlike("^[A-Za-z0-9]"),
    })
    cue = _by_kind(kind, {k: before.rlike(rf"(?:^|[^a-z])(?:{cues})") for k, cues in CUES.items()})
    valid = F.when(kind == "card_like", False).when(kind == "social_number", _valid("social_number", value)).when(kind == "bank_account", account_check(value)).when(kind.isin("masked_email", *BASE), True)
    vote = lambda c: c.cast("int")
    return F.struct(
        kind.alias("kind"), vote(valid).alias("valid"), vote(known).alias("gazetteer"), vote(F.when(cue, True)).alias("context"),
        vote(F.when(before.rlike(AGAINST), False)).alias("against"), vote(shaped).alias("shape"),
        F.least(F.floor(F.length(value) / 4), F.lit(9)).cast("int").alias("size"),
    )


def expectation_maximisation(patterns: list[tuple[dict, float]], rounds: int = 25) -> tuple[dict, list[float]]:
    """Reliabilities of each labeler, ``P(vote | span)`` and ``P(vote | no span)`` by vote, and the posterior of every pattern.

    ``patterns``: votes by labeler (1, 0 or None) and their count. Starts from majority votes. A labeler that abstains says
    nothing, but how often it votes in either class counts: one that only ever votes 0 speaks against. No vote ever speaks
    for the other side.
    """
    belief = []
    for votes, _ in patterns:
        cast = [v for v in votes.values() if v is not None]
        belief.append((sum(cast) + 0.5) / (len(cast) + 1.0))
    rates: dict = {}
    for _ in range(rounds):
        yes = sum(b * n for b, (_, n) in zip(belief, patterns, strict=True))
        no = sum(n for _, n in patterns) - yes
        for name in LABELERS:
            for vote in (1, 0):
                said = [(b, n) for b, (v, n) in zip(belief, patterns, strict=True) if v[name] == vote]
                among = (1 + sum(b * n for b, n in said)) / (3 + yes), (1 + sum((1 - b) * n for b, n in said)) / (3 + no)
                rates[name, vote] = among if (among[0] > among[1]) == bool(vote) else (1.0, 1.0)
        belief = []
        for votes, _ in patterns:
            odds = math.log((1 + yes) / (1 + no))
            for name, x in votes.items():
                if x is not None:
                    right, wrong = rates[name, x]
                    odds += math.log(right / wrong)
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return rates, belief


def fit(docs: DataFrame, text: str = "text") -> dict:
    """The span classifier: ``bias`` and a weight for every (feature, value). One pass; only pattern counts leave it."""
    t = docs.select(text_of(text).alias("t")).filter(F.col("t").rlike(r"[0-9@]|(?i)[\[(]\x20?at"))
    spans = t.select("t", F.explode(candidates(F.col("t"))).alias("s")).select(features(F.col("t"), F.col("s")).alias("f"))
    columns = ["kind", *LABELERS, "size"]
    rows = spans.select("f.*").groupBy(*columns).agg(F.count("*").alias("n")).collect()  # at most 9 x 3^5 x 10 rows
    rows.sort(key=lambda r: tuple(str(r[c]) for c in columns))
    rates, belief = expectation_maximisation([({k: r[k] for k in LABELERS}, float(r["n"])) for r in rows])
    yes, no = 1 + sum(b * r["n"] for b, r in zip(belief, rows, strict=True)), 1 + sum((1 - b) * r["n"] for b, r in zip(belief, rows, strict=True))
    weights: dict = {}
    for c in columns:
        by: dict = {}
        for b, r in zip(belief, rows, strict=True):
            if r[c] is not None:
                p, q = by.get(r[c], (0.0, 0.0))
                by[r[c]] = (p + b * r["n"], q + (1 - b) * r["n"])
        for value, (p, q) in by.items():
            weights[c, value] = round(math.log((p + 1) / (yes + len(by))) - math.log((q + 1) / (no + len(by))), 9)
    return {"bias": round(math.log(yes / no), 9), "weights": weights, "rates": rates}


def probability(f: Column, model: dict) -> Column:
    odds = F.lit(model["bias"])
    for c in ("kind", *LABELERS, "size"):
        cases = {v: w for (name, v), w in model["weights"].items() if name == c}
        if cases:
            odds = odds + F.coalesce(reduce(lambda x, v: x.when(f[c] == v, F.lit(cases[v])), cases, F.when(F.lit(False), F.lit(0.0))), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def spans_of(text: Column, model: dict) -> Column:
    """All accepted spans, by kind as listed, then start; :data:`BASE` kinds first."""
    return F.filter(candidates(text), lambda s: s["kind"].isin(*BASE) | (probability(features(text, s), model) >= ACCEPT))


def find(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, spans``: one row per document, spans as ``array<struct<kind, start, end, value>>``."""
    return docs.select(F.col(key).alias("doc_id"), let(text_of(text), lambda t: spans_of(t, model)).alias("spans"))


def redact(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; overlapping spans become one."""

    def masked(t: Column) -> Column:
        ordered = F.array_sort(F.transform(spans_of(t, model), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
        start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
        done = F.aggregate(ordered, start, lambda a, s: F.when(-s["end"] <= a["pos"], a).otherwise(F.struct(
            (-s["end"]).alias("pos"),
            F.when(s["start"] < a["pos"], a["out"]).otherwise(
                F.concat(a["out"], F.substring(t, a["pos"] + 1, s["start"] - a["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            ).alias("out"),
        )))
        return let(done, lambda d: F.concat(d["out"], F.substring(t, d["pos"] + 1, F.length(t))))

    spotted = F.col(text).rlike(r"[0-9@]|(?i)[\[(]\x20?at")
    return docs.withColumn(text, F.when(spotted, let(F.col(text), masked)).otherwise(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rows = found.select("doc_id", let(F.col("spans"), lambda s: F.struct(
        *(of_kind(s, k) for k in BASE),
        F.sha2(joined(F.filter(s, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(s).alias("spans"),
    )).alias("r"))
    return rows.select("doc_id", "r.*")
