"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits, or runs of other signs; features are words and pairs of neighbours, hashed to
``2 ** BITS`` places, with their share of all n-grams of the text as value (a word after itself counts as one special pair).
Training rows are a sample of labelled rows, ``MAX_TRAIN`` at most in expectation, chosen by a hash of doc_id. They are
dealt to ``SHARDS`` tasks; each runs per-coordinate FTRL-proximal over its rows and the weights are averaged. Weights are
one array of fixed size, so scoring is a sparse dot product per text, without a shuffle.

Defined results: a text without words (null, empty) scores by the bias alone. Labels that are null, or whose doc_id is
null, teach nothing; a doc_id labelled twice counts once, with its least label, and one with several rows teaches with its
least text alone. Without any labels every score is 0.5.
Repeated rows are scored alike. Labels, lang, source and doc_id are no inputs of a score; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import slices, table, text_of, utf8

BITS = 18
MAX_TRAIN = 40_000
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-6
SCALE = 16.0
ACCEPT = 0.3
#: 0: space, 1: letters, digits and all bytes beyond ASCII, 2: other signs.
KINDS = np.where(words.SPACE, 0, 2).astype(np.uint8)
KINDS[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = 1
TWICE = np.uint64(0x5851F42D4C957F2D)


def ngrams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all n-grams, and the text of each, texts in order."""
    starts, ends, offsets = words.word_spans(raw, bounds, KINDS)
    h = words.word_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
    same = doc[1:] == doc[:-1]
    pair = np.where(h[1:] == h[:-1], TWICE, words.mix(h[:-1] * words.BASE + h[1:]))[same]
    places = (np.concatenate((h, pair)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    of = np.concatenate((doc, doc[1:][same]))
    order = np.argsort(of, kind="stable")
    return places[order], of[order]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over ``(places, values, label)``; the last place is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def _examples(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    raw, bounds = utf8(batch.column(0))
    labels = batch.column(1).to_numpy(zero_copy_only=False)
    for i, j in slices(bounds):
        places, of = ngrams(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        edges = np.searchsorted(of, np.arange(j - i + 1))
        for k in range(j - i):
            at, count = np.unique(places[edges[k] : edges[k + 1]], return_counts=True)
            x = count * (SCALE / max(1, count.sum()))
            yield np.append(at, 1 << BITS), np.append(x, 1.0), float(labels[i + k])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", may_learn: Column | None = None) -> np.ndarray:
    """Averaged weights, ``2 ** BITS`` and the bias."""
    known = labels.select(F.col("doc_id").alias("key"), F.col(label).cast("int").alias("y")).dropna()
    if may_learn is not None:
        known = known.filter(may_learn)
    known = known.groupBy("key").agg(F.min("y").alias("y"))
    share = min(1.0, MAX_TRAIN / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col("doc_id").alias("key"), text_of().alias("text")).join(F.broadcast(chosen), "key")  # MAX_TRAIN bounds it
    rows = rows.groupBy("key", "y").agg(F.min("text").alias("text"))  # and these rows, however often a document is repeated
    dealt = rows.select("key", "text", "y").repartition(SHARDS, "key").sortWithinPartitions(F.xxhash64(F.col("key").cast("string")), "text").select("text", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [e for b in batches for e in _examples(b)]
        if rows:
            w = ftrl(rows)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), len(rows)))], ["place", "w", "n"])

    parts = dealt.mapInArrow(learn, "place long, w double, n long")
    mean = parts.groupBy("place").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n")).collect()  # 2 ** BITS + 1 rows at most
    total = sum(r["n"] for r in mean if r["place"] == 1 << BITS)
    out = np.zeros((1 << BITS) + 1)
    for r in mean:
        out[r["place"]] = r["w"] / max(1, total)
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            raw, bounds = utf8(b.column(1))
            out = np.zeros(len(bounds) - 1)
            for i, j in slices(bounds):
                places, of = ngrams(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                total = np.bincount(of, weights=w[places], minlength=j - i)
                out[i:j] = total * (SCALE / np.maximum(1, np.bincount(of, minlength=j - i)))
            out = 1 / (1 + np.exp(-np.clip(out + float(w[-1]), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    chosen = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double")


def fold(key: Column) -> Column:
    """The fold of a doc_id; fold 0 is held out."""
    return F.crc32(key.cast("string")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"), may_learn=fold(F.col("key")) != 0)
    scored = score(docs, weights)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
