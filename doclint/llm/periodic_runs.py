"""Periodic runs of words: stretches in which the same words come again every ``period`` words, four times or more.

Method, recursive frequency splitting: in a run of at least ``REPEATS`` periods every word occurs ``REPEATS`` times or more, so
a word met less often in its segment is in no run and splits the segment there. Words are counted again in what is left, until
nothing splits. Only surviving segments are scanned lag by lag: at lag q the segment is cut into blocks of q words, and a run of
four periods holds three whole blocks in a row, which are equal. Such places are extended word by word to both sides. Lags go up,
and three blocks inside a run that is already known belong to a multiple of its period, so they are passed over. A segment of
n words takes n / 1 + n / 2 + ... block comparisons, never n for each lag.

A run is a stretch of consecutive words with least period q that no neighbouring word extends, of ``max(LEAST, REPEATS * q)``
words at least. Words are compared as 64-bit hashes inside one text.

Defined results: a null or empty text, or one of white space only, has no words and no runs. Repeated rows are texts of their
own. Of runs with the greatest length/period the first one, then the one of the least period is the strongest. A null doc_id stays
null, and its text is never looped. Other columns are neither read nor returned, so their names cannot clash. Texts are
independent: nothing is shuffled, and memory holds one slice of texts or one long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import let, slices, table, text_of, utf8

LEAST, REPEATS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
INVERSE = np.uint64(pow(int(words.BASE), -1, 1 << 64))


def surviving(ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """The segments that frequency splitting leaves, of all texts at once. ``ids``: small numbers, equal for equal words."""
    out: list[tuple[int, int]] = []
    low, high = offsets[:-1], offsets[1:]
    span = int(ids.max()) + 1 if len(ids) else 1
    while True:
        long_enough = high - low >= LEAST
        low, size = low[long_enough], (high - low)[long_enough]
        if not len(low):
            return out
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(segment)) + np.repeat(low - first, size)
        _, of, counts = np.unique(segment * span + ids[at], return_inverse=True, return_counts=True)
        rare = counts[of] < REPEATS
        splits = np.logical_or.reduceat(rare, first)
        out += zip(low[~splits].tolist(), (low + size)[~splits].tolist(), strict=True)
        stays = ~rare & splits[segment]
        begins, ends = stays.copy(), stays.copy()
        begins[1:] &= ~stays[:-1] | (segment[1:] != segment[:-1])
        ends[:-1] &= ~stays[1:] | (segment[1:] != segment[:-1])
        low, high = at[begins], at[ends] + 1


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values are equal; looks further in doubling steps."""
    done, step, n = 0, 32, min(len(a), len(b))
    while done < n:
        differ = a[done : min(n, done + step)] != b[done : min(n, done + step)]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + step, 2 * step
    return n


def lag_scan(values: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run in one segment of word hashes."""
    n = len(values)
    one = np.ones(1, np.uint64)
    up = np.multiply.accumulate(np.concatenate((one, np.full(n, words.BASE, np.uint64))))
    down = np.multiply.accumulate(np.concatenate((one, np.full(n, INVERSE, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1])))
    reach = np.zeros(n, np.int64)  # the furthest end of a known run that holds the place
    found = []
    for q in range(1, n // REPEATS + 1):
        cuts = sums[::q]
        blocks = (cuts[1:] - cuts[:-1]) * down[: q * (len(cuts) - 1) : q]
        same = blocks[1:] == blocks[:-1]
        for at in (np.flatnonzero(same[1:] & same[:-1]) * q).tolist():
            if reach[at] >= at + 3 * q:
                continue
            left = _matching(values[:at][::-1], values[: at + q][::-1])
            right = _matching(values[at:], values[at + q :])
            start, length = at - left, left + right + q
            if length >= max(LEAST, REPEATS * q):
                found.append((start, length, q))
                np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
    return found


def runs_of(hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of all texts, by start and then period; starts count over all words."""
    ids = np.unique(hashes, return_inverse=True)[1]
    return sorted((low + s, n, q) for low, high in surviving(ids, offsets) for s, n, q in lag_scan(hashes[low:high]))


def looped(text: Column, doc_id: Column) -> Column:
    """Every tenth text, by the checksum h of its id, with a tail that repeats: words from ``a = g % n`` on go round in
    ``p = 1 + (n - a) // (3 + g % 8)`` words, where ``g = h // 10``; its words are joined by one space. Native."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def loop(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        place = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")).otherwise("")

    each = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(each, loop)).otherwise(text)


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: runs by start and then period, and the words without repetitions.

    ``collapsed`` holds the text's words joined by one space, without those that a run contains after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, bounds = utf8(b.column(1))
            for i, j in slices(bounds):
                own, edges = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                starts, ends, offsets = words.word_spans(own, edges, words.SPACE)
                found = runs_of(words.word_hashes(own, starts, ends), offsets)
                depth = np.zeros(len(starts) + 1, np.int64)
                for s, n, q in found:
                    depth[s + q] += 1
                    depth[s + n] -= 1
                keep = np.cumsum(depth[:-1]) == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(offsets), pa.int64()), _lists(found, offsets), _joined(own, starts, ends, keep, offsets)],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    chosen = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def _lists(found: list[tuple[int, int, int]], offsets: np.ndarray) -> pa.Array:
    """The runs of each text, starts counted in the text."""
    flat = np.array(found, np.int64).reshape(-1, 3)
    of = np.searchsorted(offsets, flat[:, 0], "right") - 1
    columns = [pa.array(x) for x in (flat[:, 0] - offsets[of], flat[:, 1], flat[:, 2])]
    fields = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(offsets))), pa.int32()), fields)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = (ends - starts)[keep] + 1
    first = np.cumsum(size) - size
    source = np.arange(int(size.sum())) + np.repeat(starts[keep] - first, size)
    out = raw[np.minimum(source, len(raw) - 1)] if len(source) else np.zeros(0, np.uint8)
    out[first + size - 1] = 0x20
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    edges = np.concatenate((first, [len(out)]))[kept]
    flat = out.tobytes()
    return pa.array([flat[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())


def strongest(runs: Column) -> Column:
    """The run of the greatest length/period; of equals the first in the list. Null for an empty list."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text").cast("string"), F.col("doc_id")).alias("text"))
    found = find_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
