"""Periodic runs against a plain search of every start and period."""

import random
import re
import zlib

import brute
import edge_cases
import numpy as np
import pytest

from doclint.llm import periodic_runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w):
    """Every lag over all words: maximal stretches, those whose least period is the lag."""
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            part = w[i : j + q]
            if length >= max(6, 4 * q) and all(part[d:] != part[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc, text):
    w, h = words_of(text), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None, None, None, None)
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    return (doc, len(runs), *best, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(60))
def test_segments_and_lags_find_what_a_plain_search_finds(seed):
    rng = random.Random(seed)
    w: list[int] = []
    for _ in range(rng.randint(1, 8)):
        block = [rng.randint(0, rng.choice((1, 2, 5, 50))) for _ in range(rng.randint(1, 9))]
        w += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
    hashes = np.array([hash((x, 7)) & (2**63 - 1) for x in w], np.uint64)
    assert periodic_runs.runs_of(hashes, np.array([0, len(w)])) == plain_runs(w)


def test_texts_do_not_run_into_each_other():
    hashes = np.full(11, 5, np.uint64)
    assert periodic_runs.runs_of(hashes, np.array([0, 5, 11])) == [(5, 6, 1)]


def test_a_long_periodic_text_needs_few_comparisons():
    hashes = np.arange(400_000, dtype=np.uint64) % 7 + 1
    assert periodic_runs.runs_of(hashes, np.array([0, len(hashes)])) == [(0, 400_000, 7)]


def documents():
    rng = random.Random(11)
    loops = [" ".join((" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) + " ") * rng.randint(3, 9) for _ in range(4)) for _ in range(120)]
    return [(i, t) for i, t in enumerate([*(t for t in edge_cases.texts() if t is None or len(t) < 40_000), *loops])]


def test_query_equals_the_plain_version(spark, tmp_path):
    rows = [*documents(), (3, "x y x y x y x y x y"), (None, "a " * 9), (None, None)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    frame = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic_runs.query(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(map(tuple, found.collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_no_rows(spark):
    assert periodic_runs.find_runs(edge_cases.frame(spark, [])).collect() == []
