"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window). A window's tokens
are its ``SHINGLE``-word shingles, ordered by rarity, that is by how often each occurs in all documents, counted first.
A document can contain a window only if it contains every token of it, so joining the first token in that order, the
rarest, misses nothing. The place of the token in the window fixes where the window would have to start: windows that would
leave the document are dropped by length and position, the words of the rest are compared, and their bytes last.

The benchmark is split by a hash of item_id and text into blocks of about ``BLOCK`` bytes of text, after rows that are equal
in both are made one. One block's index is broadcast at
a time and documents pass all blocks, so a larger benchmark costs more passes, never more memory. Documents do not shuffle.

Defined results: a null or empty text, or one of separators only, has no words and no hits; such an item has no window.
Items that share an id are one item; a null id is the empty string. Windows that occur in several items name them all.
Repeated documents are judged alike. An empty benchmark hits nothing. Other columns are carried along or not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import slices, table, text_of, utf8

WINDOW, SHINGLE = 10, 3
BLOCK = 16 << 20


class Words:
    """The words of several texts: byte spans, hashes and the n + 1 word offsets of the texts."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray) -> None:
        self.raw = words.LOWER[raw]
        self.starts, self.ends, self.offsets = words.word_spans(self.raw, bounds, words.NOT_WORD)
        self.hashes = words.word_hashes(self.raw, self.starts, self.ends)

    def spelled(self, first: int, n: int) -> bytes:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True))


def windows_of(items: list[tuple[str, str]]) -> dict[bytes, tuple[np.ndarray, set[str]]]:
    """Distinct windows by spelling: word hashes and the ids of the items that hold them."""
    out: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    for item, text in items:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        w = Words(raw, np.array([0, len(raw)]))
        n = len(w.hashes)
        for i in range(max(1, n - WINDOW + 1) if n else 0):
            size = min(n, WINDOW)
            out.setdefault(w.spelled(i, size), (w.hashes[i : i + size], set()))[1].add(item)
    return out


def tokens_of(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The shingles of one window, and their number of words."""
    size = min(SHINGLE, len(hashes))
    return size, words.runs_of(hashes, np.array([0, len(hashes)]), size)[0]


def document_frequency(docs: DataFrame, wanted: dict[int, np.ndarray], text: str) -> dict[tuple[int, int], int]:
    """How often each wanted token occurs in all documents; counts are summed in tasks first, the result is the index's size."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {size: np.zeros(len(t), np.int64) for size, t in shared.value.items()}
        for b in batches:
            raw, bounds = utf8(b.column(0))
            for i, j in slices(bounds):
                w = Words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                for size, tokens in shared.value.items():
                    run, whole = words.runs_of(w.hashes, w.offsets, size)
                    at = np.searchsorted(tokens, run[whole])
                    at[at == len(tokens)] = 0
                    totals[size] += np.bincount(at[tokens[at] == run[whole]], minlength=len(tokens))
        for size, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), size, np.int32)), pa.array(seen), pa.array(n[seen])], ["size", "at", "n"])

    counted = docs.select(text_of(text).alias("text")).mapInArrow(run, "size int, at long, n long")
    return {(r["size"], r["at"]): r["n"] for r in counted.groupBy("size", "at").agg(F.sum("n").alias("n")).collect()}


def build_index(docs: DataFrame, items: list[tuple[str, str]], text: str) -> dict:
    """Prefix tokens by size, each with the windows they lead to and their place there; windows as hashes, spelling, ids."""
    found = windows_of(items)
    spelled = list(found)
    tokens = [tokens_of(found[s][0]) for s in spelled]
    by_size: dict[int, list[np.ndarray]] = defaultdict(list)
    for size, t in tokens:
        by_size[size].append(t)
    wanted = {size: np.unique(np.concatenate(ts)) for size, ts in by_size.items()}
    count = document_frequency(docs, wanted, text)
    entries: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for window, (size, t) in enumerate(tokens):
        at = np.searchsorted(wanted[size], t).tolist()
        place = min(range(len(at)), key=lambda k: (count.get((size, at[k]), 0), int(t[k]), k))
        entries[size].append((int(t[place]), window, place))
    prefix = {}
    for size, rows in entries.items():
        rows.sort()
        key = np.array([r[0] for r in rows], np.uint64)
        distinct, first = np.unique(key, return_index=True)
        prefix[size] = (distinct, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    grid = np.zeros((len(spelled), WINDOW), np.uint64)
    for i, s in enumerate(spelled):
        grid[i, : len(found[s][0])] = found[s][0]
    return {"prefix": prefix, "hashes": grid, "lengths": np.array([len(found[s][0]) for s in spelled]), "spelled": spelled, "items": [sorted(found[s][1]) for s in spelled]}


def occurrences(w: Words, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence."""
    text = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    starts, windows = [], []
    for size, (tokens, edges, window, place) in index["prefix"].items():
        run, whole = words.runs_of(w.hashes, w.offsets, size)
        at = np.searchsorted(tokens, run)
        at[at == len(tokens)] = 0
        hits = np.flatnonzero((tokens[at] == run) & whole)
        n = np.diff(edges)[at[hits]]
        entry = np.arange(int(n.sum())) + np.repeat(edges[at[hits]] - (np.cumsum(n) - n), n)
        first, win, doc = np.repeat(hits, n) - place[entry], window[entry], text[np.repeat(hits, n)]
        ok = (first >= w.offsets[doc]) & (first + index["lengths"][win] <= w.offsets[doc + 1])
        first, win = first[ok], win[ok]
        for j in range(WINDOW):
            short = index["lengths"][win] <= j
            ok = short | (w.hashes[np.where(short, 0, first + j)] == index["hashes"][win, j])
            first, win = first[ok], win[ok]
        starts.append(first)
        windows.append(win)
    first, win = (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64),) * 2
    same = [w.spelled(f, n) == index["spelled"][k] for f, k, n in zip(first.tolist(), win.tolist(), index["lengths"][win].tolist(), strict=True)]
    same = np.array(same, bool)
    return first[same], win[same]


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """The documents with all their columns, and ``n_words``, ``hits`` (places of hit words) and ``items`` (ids, sorted), the new names after ``prefix``."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of("text").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // BLOCK))
    out = docs.withColumns({
        f"{prefix}n_words": F.lit(0).cast("long"), f"{prefix}hits": F.array().cast("array<int>"), f"{prefix}items": F.array().cast("array<string>"),
    })
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK bytes
        index = build_index(docs, [(r["item_id"], r["text"]) for r in mine], text)
        out = _join(out, spark.sparkContext.broadcast(index), text, prefix)
    return out


def _join(docs: DataFrame, shared, text: str, prefix: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            names = b.schema.names
            at, hit_at, item_at = names.index(text), names.index(f"{prefix}hits"), names.index(f"{prefix}items")
            raw, bounds = utf8(b.column(at))
            hits, items = b.column(hit_at).to_pylist(), b.column(item_at).to_pylist()
            n_words = np.zeros(len(hits), np.int64)
            for i, j in slices(bounds):
                w = Words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                n_words[i:j] = np.diff(w.offsets)
                first, window = occurrences(w, index)
                if not len(first):
                    continue
                cover = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + index["lengths"][window], -1)
                hit = np.cumsum(cover[:-1]) > 0
                doc = np.searchsorted(w.offsets, first, "right") - 1
                for d in np.unique(doc).tolist():
                    found = np.flatnonzero(hit[w.offsets[d] : w.offsets[d + 1]]).tolist()
                    names_of = {x for k in set(window[doc == d].tolist()) for x in index["items"][k]}
                    hits[i + d] = sorted({*hits[i + d], *found})
                    items[i + d] = sorted({*items[i + d], *names_of})
            columns = list(b.columns)
            columns[names.index(f"{prefix}n_words")] = pa.array(n_words)
            columns[hit_at], columns[item_at] = pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with their own columns."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return flag(docs, benchmark, prefix=prefix).filter(F.size(f"{prefix}hits") == 0).select(*(f"`{c}`" for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    flagged = flag(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return flagged.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
