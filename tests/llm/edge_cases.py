"""Inputs every operator must take: nulls, empty and long texts, repeated rows, clashing column names, no rows."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, label int, ids string, hits int, "
    "items int, place int, score string, spans string, kept boolean, n int, file string, `a b` int"
)


def texts() -> list[str | None]:
    rng = random.Random(7)
    vocabulary = ["the", "of", "Edh", "über", "naïve", "日本", "x1", "re-do", "Token:", "a@b.example", "10.0.0.7", "***", "don't", "🎉"]
    prose = [" ".join(rng.choice(vocabulary) + str(rng.randint(0, 60)) for _ in range(rng.randint(5, 120))) for _ in range(24)]
    near = prose[3].split(" ")
    near[len(near) // 2] = "changed"
    long_text = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    return [
        None, "", " ", "\n\n", "word", "a b c", *prose, " ".join(near), prose[4], prose[4], prose[5].upper(), long_text, "y" * 40_000,
        "line one here\nline one here\nother", "aaaa " * 300, "\x1c\x85　", "<|endoftext|> x", "4111 1111 1111 1111 and +1 (555) 123-4567",
        'api_key = "deadbeef00deadbeef00deadbeef00"', "퟿�",
    ]


def rows() -> list[tuple]:
    rest = (None, 1, "k", None, "i", 2, 3, 4, "s", None, True, 5, "f", 6)
    out = [(i, t, None if i % 3 else "en", "src0", *rest) for i, t in enumerate(texts())]
    return [*out, out[9], out[9], (None, texts()[8], None, None, *rest)]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
