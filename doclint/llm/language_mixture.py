"""Languages of a text as a mixture inferred from its n-grams.

:func:`fit` counts letter trigrams (hashed, of lower-cased bytes, whatever is no letter being one space) per language over every
teaching row; a language is the smoothed distribution of its trigrams. :func:`identify` takes a text as a mixture of languages:
expectation-maximisation estimates the proportions of all languages from the likelihoods of its trigrams. In the order of these
proportions languages then enter the text's set one by one, each time with proportions estimated anew, as long as the penalised
likelihood rises: every further language costs ``RATE`` a trigram and half the logarithm of their number. Many texts are worked on
at once as arrays; a text comes as counts of distinct trigrams, so memory does not grow with its length.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and no languages; so is every text if nothing was
learned. ``score`` is the proportion of the predicted language in the chosen set; of equal proportions the language first by name
wins. Repeated rows are judged, and teach, one by one. Other columns are neither read nor returned. A label column with more than
``LANGUAGES`` values is refused; with many values there are fewer trigram places, so that the model stays below ``MODEL`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import slices, table, text_of, utf8

ORDER, BITS, PARTS = 3, 16, 64
LANGUAGES, MODEL = 4096, 1 << 26
SMOOTHING, RATE = 0.5, 0.02
ROUNDS, CLOSE = 20, 1e-4
UNKNOWN = "und"
#: Letters as they count: A-Z as a-z, all bytes from 128 on; everything else is a space.
LETTER = np.where(words.NOT_WORD[words.LOWER] | ((np.arange(256) >= 0x30) & (np.arange(256) <= 0x39)), 0x20, words.LOWER).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    """``shares[place, language]``: trigram probabilities over the largest of their place; ``tops``: the logarithm of that one."""

    languages: list[str]
    bits: int
    shares: np.ndarray
    tops: np.ndarray


def trigrams(raw: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all trigrams with a letter, and the text of each; no trigram crosses texts, which begin and end with a space."""
    size = np.diff(bounds) + 2
    edges = np.concatenate(([0], np.cumsum(size)))
    flat = np.full(int(edges[-1]), 0x20, np.uint8)
    of = np.repeat(np.arange(len(size)), size)
    inner = np.ones(len(flat), bool)
    inner[edges[:-1]] = inner[edges[1:] - 1] = False
    flat[inner] = LETTER[raw]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0x20) | (flat[:-1] != 0x20) | (of[1:] != of[:-1])
    flat, of = flat[keep].astype(np.uint32), of[keep]
    if len(flat) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (flat[:-2] << np.uint32(16)) | (flat[1:-1] << np.uint32(8)) | flat[2:]
    whole = (of[2:] == of[:-2]) & (flat[1:-1] != 0x20)  # a space in the middle tells little
    place = (gram[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return place.astype(np.int64), of[:-2][whole]


def counted(raw: np.ndarray, bounds: np.ndarray, bits: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and count of the distinct trigrams of each text, by text. A text beyond ``most`` bytes is counted in pieces."""
    if len(bounds) == 2 and len(raw) > most:
        total = np.zeros(1 << bits, np.int64)
        for i in range(0, len(raw), most):
            piece = raw[max(0, i - ORDER + 1) : i + most]  # a trigram over the cut is met in the later piece
            total += np.bincount(trigrams(piece, np.array([0, len(piece)]), bits)[0], minlength=1 << bits)
        at = np.flatnonzero(total)
        return np.zeros(len(at), np.int64), at, total[at]
    place, of = trigrams(raw, bounds, bits)
    both, n = np.unique((of << bits) | place, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), n


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", may_learn: Column | None = None) -> Model:
    """Trigram distributions from all rows with a label and a text; only a table of ``2 ** bits`` counts a language is collected."""
    rows = docs if may_learn is None else docs.filter(may_learn)
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    known = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values in {lang}: not a language column")
    bits = min(BITS, (MODEL // (8 * max(1, len(known)))).bit_length() - 1)
    number = {x: i for i, x in enumerate(known)}
    width = (1 << bits) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(known), 1 << bits), np.int64)
        for b in batches:
            raw, bounds = utf8(b.column(0))
            label = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for i, j in slices(bounds):
                of, place, n = counted(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], bits)
                np.add.at(total, (label[i:j][of], place), n)
        for x in np.flatnonzero(total.any(axis=1)).tolist():
            parts = [total[x, p * width : (p + 1) * width].tobytes() for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([x] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["language", "part", "counts"])

    def add(key, parts):
        total = np.zeros(width, np.int64)
        for x in parts.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"language": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(count, "language int, part int, counts binary").groupBy("language", "part").applyInArrow(add, "language int, part int, counts binary")
    counts = np.zeros((len(known), 1 << bits))
    for r in sums.collect():  # MODEL bytes at most
        counts[r["language"], r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    taught = counts.any(axis=1)
    counts = counts[taught] + SMOOTHING
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).T if taught.any() else np.zeros((1 << bits, 0))
    tops = logs.max(axis=1, initial=-np.inf) if taught.any() else np.zeros(1 << bits)
    return Model([x for x, on in zip(known, taught, strict=True) if on], bits, np.exp(logs - tops[:, None]).astype(np.float32), tops)


def proportions(shares: np.ndarray, n: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts at once: proportions of the columns, and the logarithm of the likelihood.

    ``shares``: a row per distinct trigram, sorted by text ``of``; ``n``: its count; ``first``: where each text begins.
    """
    total = np.add.reduceat(n, first)
    theta = np.full((len(first), shares.shape[1]), 1 / shares.shape[1])
    for _ in range(ROUNDS if shares.shape[1] > 1 else 0):
        part = shares * theta[of].astype(np.float32)
        part *= (n / part.sum(axis=1))[:, None].astype(np.float32)
        new = np.add.reduceat(part, first, axis=0, dtype=np.float64) / total[:, None]
        moved = np.abs(new - theta).max()
        theta = new
        if moved < CLOSE:
            break
    likelihood = np.add.reduceat(n * np.log((shares * theta[of].astype(np.float32)).sum(axis=1, dtype=np.float64)), first)
    return theta, likelihood


def mixtures(of: np.ndarray, place: np.ndarray, n: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have trigrams, and for each the proportions of all languages, 0 outside the chosen set."""
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    texts, shares, n = of[first], model.shares[place], n.astype(np.float64)
    at = np.cumsum(np.concatenate(([0], of[1:] != of[:-1])))
    rough, _ = proportions(shares, n, first, at)
    order = np.argsort(-rough, axis=1, kind="stable")
    total = np.add.reduceat(n, first)
    price = RATE * total + 0.5 * np.log(total + 1)
    best = np.full(len(texts), -np.inf)
    out = np.zeros_like(rough)
    open_texts = np.arange(len(texts))
    for k in range(1, rough.shape[1] + 1):
        rows = np.isin(at, open_texts) if len(open_texts) < len(texts) else np.ones(len(at), bool)
        own = np.searchsorted(open_texts, at[rows])
        begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        chosen = order[open_texts, :k]
        theta, likelihood = proportions(np.take_along_axis(shares[rows], chosen[own], axis=1), n[rows], begins, own)
        value = likelihood - (k - 1) * price[open_texts]
        better = value > best[open_texts]
        open_texts, chosen, theta = open_texts[better], chosen[better], theta[better]
        best[open_texts] = value[better]
        out[open_texts] = 0
        out[open_texts[:, None], chosen] = theta
        if not len(open_texts):
            break
    return texts, out


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for every row; ``languages`` maps the chosen set to proportions. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # below MODEL bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        most = max(1 << 16, (1 << 23) // max(4, len(m.languages)))
        for b in batches:
            raw, bounds = utf8(b.column(1))
            letters = b.column(2).to_pylist()
            for i, j in slices(bounds, most):
                predicted, score, sets = [UNKNOWN] * (j - i), [0.0] * (j - i), [{}] * (j - i)
                of, place, n = counted(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], m.bits)
                if len(of) and m.languages:
                    texts, found = mixtures(of, place, n, m)
                    top = found.argmax(axis=1)
                    for x, best, row in zip(texts.tolist(), top.tolist(), found.tolist(), strict=True):
                        if letters[i + x]:
                            predicted[x], score[x] = m.languages[best], min(1.0, row[best])
                            sets[x] = {m.languages[y]: v for y, v in enumerate(row) if v > 0}
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(predicted), pa.array(score), pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    chosen = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages map<string,double>")


def held_out(key: Column) -> Column:
    """Whether a document is kept out of learning; a null key is neither held out nor does it teach."""
    return F.crc32(key.cast("string")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, may_learn=~held_out(F.col("doc_id"))))
    parts = F.array_sort(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"], 3).cast("string"))))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", F.array_join(parts, ",").alias("languages"))
