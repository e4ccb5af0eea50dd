"""Removal of repeated byte strings by fingerprints of strings at content-chosen anchors.

This takes the place of suffix arrays: no suffix is ordered, only equality of long strings is decided.

Every ``length``-byte string holds one anchor: the place of its least ``GRAM``-byte hash, leftmost first. Equal strings have
their anchor at the same place, so strings at anchors, about one in 180 bytes, see every repeat. The strings around one
anchor whose starts lie in one stretch of ``STRETCH`` places form a cell. All of them contain its core (the bytes common to
the whole stretch); together they cover its full extent. A level holds the cells of a batch as fingerprints (core, full), with
the number of times each occurs.

New batches become level 0; two levels of equal rank are added up into one of the next rank, and after the last batch so are
the remaining levels. There are ``BATCHES`` batches at every size. Then a cell whose extent occurs twice is repeated as a whole;
where one core has several extents, the ``length``-byte strings of one cell for each extent are compared one by one; all other
cells are unique.

Fingerprints are 64 bits; deciding takes two of them (core and extent, or core and string), 128 bits in all.

Defined results: a null or empty text has no bytes. Matches never cross texts; a text shorter than ``length`` keeps all its
bytes. Repeated rows are texts of their own, so each is removed as a copy of the other. What is kept is bytes, as a cut may
split a character. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import words
from .common import cut, placed, slices, table, text_of, utf8

GRAM, STRETCH, PART, BATCHES = 32, 256, 32, 2
PLACE = np.uint64((1 << 28) - 1)
INVERSE = np.uint64(pow(int(words.BASE), -1, 1 << 64))


class Bytes:
    """Fingerprints of any substrings of a buffer of at most 2 ** 28 bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, words.BASE, np.uint64))))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.BYTE_VALUES[raw] * up[:-1], out=self.sums[1:])
        self.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, INVERSE, np.uint64))))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return words.mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def anchors(hashes: Bytes, n: int, length: int) -> np.ndarray:
    """The anchor of the string at each start, over the buffer as if it were one text."""
    span = length - GRAM + 1
    at = np.arange(n - GRAM + 1)
    least = (hashes.of(at, at + GRAM) & ~PLACE) | at.astype(np.uint64)
    wide = 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    return (least & PLACE).astype(np.int64)


def cells(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[Bytes, dict[str, np.ndarray]] | None:
    """All cells of several texts: text, first and last string start (in the buffer), core and full fingerprint."""
    sizes = np.diff(bounds)
    if not (sizes >= length).any():
        return None
    hashes = Bytes(raw)
    anchor = anchors(hashes, len(raw), length)
    starts = np.arange(len(anchor))
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    inside = starts + length <= bounds[text + 1]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    stretch = (anchor - starts) // STRETCH
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin = anchor[first] - stretch[first] * STRETCH
    common = length - min(STRETCH, length - GRAM + 1) + 1
    core = hashes.of(begin, begin + common) + stretch[first].astype(np.uint64)
    return hashes, {"text": text[first], "first": starts[first], "last": starts[last], "anchor": anchor[first], "core": core, "full": hashes.of(starts[first], starts[last] + length)}


def with_row_ids(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``file, row, doc_id, text``: file and row name a row for good."""
    named, place = placed(docs.select(F.col(key), F.col(text)))
    return named.select(place.alias("at"), F.col(key).alias("doc_id"), text_of(text).alias("text")).select("at.file", "at.row", "doc_id", "text")


def _level(entries: DataFrame) -> DataFrame:
    """A level as a table: entries added up, with the number of extents of each core."""
    summed = entries.repartition("core").groupBy("core", "full").agg(F.sum("n").alias("n"))
    own = W.partitionBy("core")
    return cut(summed.select("core", "full", "n", F.count("*").over(own).alias("extents")).sortWithinPartitions("core", "full"))


class Family:
    """The levels, by rank."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, entries: DataFrame) -> None:
        rank, level = 0, _level(entries)
        while rank in self.levels:
            level = self.merge_scan(self.levels.pop(rank), level)
            rank += 1
        self.levels[rank] = level

    @staticmethod
    def merge_scan(older: DataFrame, newer: DataFrame) -> DataFrame:
        return _level(older.select("core", "full", "n").unionByName(newer.select("core", "full", "n")))

    def merged(self) -> DataFrame:
        """One level with everything; the family is empty afterwards."""
        out = None
        for rank in sorted(self.levels):
            out = self.levels[rank] if out is None else self.merge_scan(self.levels[rank], out)
        self.levels.clear()
        return out


def entries_of(rows: DataFrame, length: int) -> DataFrame:
    """``core, full, n`` of all cells; equal cells of a slice are added up at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, bounds = utf8(b.column(0))
            for i, j in slices(bounds):
                found = cells(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], length)
                if found:
                    core, full = found[1]["core"], found[1]["full"]
                    order = np.lexsort((full, core))
                    core, full = core[order], full[order]
                    first = np.flatnonzero(np.concatenate(([True], (core[1:] != core[:-1]) | (full[1:] != full[:-1]))))
                    n = np.diff(np.append(first, len(core)))
                    yield pa.RecordBatch.from_arrays([pa.array(core[first].view(np.int64)), pa.array(full[first].view(np.int64)), pa.array(n)], ["core", "full", "n"])

    return rows.select("text").mapInArrow(run, "core long, full long, n long")


def placed_cells(rows: DataFrame, length: int) -> DataFrame:
    """``core, full, file, row, first, last, anchor``: all cells with their place in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, bounds = utf8(b.column(2))
            for i, j in slices(bounds):
                own = bounds[i : j + 1] - bounds[i]
                found = cells(raw[bounds[i] : bounds[j]], own, length)
                if found:
                    c = found[1]
                    at = pa.array(c["text"])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c["core"].view(np.int64)), pa.array(c["full"].view(np.int64)), b.column(0).slice(i, j - i).take(at), b.column(1).slice(i, j - i).take(at),
                        *(pa.array(c[x] - own[c["text"]], pa.int32()) for x in ("first", "last", "anchor")),
                    ], ["core", "full", "file", "row", "first", "last", "anchor"])

    return rows.select("file", "row", "text").mapInArrow(run, "core long, full long, file long, row long, first int, last int, anchor int")


def cell_parts(rows: DataFrame, undecided: DataFrame, length: int) -> DataFrame:
    """``core, full, file, row, first, last, strings``: undecided cells cut into parts of ``PART`` string starts.

    Parts are counted from the anchor, so equal strings fall into parts of the same place; the strings come as fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, bounds = utf8(b.column(2))
            for x in range(b.num_rows):
                hashes = Bytes(raw[bounds[x] : bounds[x + 1]])
                first, last, anchor = (b.column(3)[x].values.field(c).to_numpy() for c in ("first", "last", "anchor"))
                cell = np.repeat(np.arange(len(first)), last - first + 1)
                at = np.arange(len(cell)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[cell]
                part = (anchor[cell] - at) // PART
                new = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
                end = np.append(new[1:], len(at)) - 1
                begin = anchor[cell[new]] - part[new] * PART
                core = hashes.of(begin, begin + length - PART + 1) + part[new].astype(np.uint64)
                full = hashes.of(at[new], at[end] + length)
                strings = hashes.of(at, at + length).astype("<u8")
                same = pa.array(np.full(len(new), x))
                yield pa.RecordBatch.from_arrays([
                    pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), b.column(0).take(same), b.column(1).take(same), pa.array(at[new], pa.int32()),
                    pa.array(at[end], pa.int32()), pa.array([strings[i : j + 1].tobytes() for i, j in zip(new, end, strict=True)], pa.binary()),
                ], ["core", "full", "file", "row", "first", "last", "strings"])

    lists = undecided.groupBy("file", "row").agg(F.collect_list(F.struct("first", "last", "anchor")).alias("cells"))  # at most a text's own
    joined = rows.select("file", "row", "text").join(lists, ["file", "row"])
    return joined.mapInArrow(run, "core long, full long, file long, row long, first int, last int, strings binary")


def repeated_strings(rows: DataFrame, undecided: DataFrame, length: int) -> DataFrame:
    """``file, row, first, last`` of runs of string starts in undecided cells whose strings occur in another extent of the core.

    Parts are decided as cells are, by core and extent; only strings of a part with an extent of its own and a core that
    others share are compared one by one.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = (b.column(4).to_numpy() - b.column(3).to_numpy() + 1).astype(np.int64)
            of = pa.array(np.repeat(np.arange(b.num_rows), n))
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.column(3).to_numpy(), n)
            strings = np.frombuffer(b"".join(b.column(5).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(strings), b.column(1).take(of), b.column(2).take(of), pa.array(at, pa.int32())], ["core", "string", "file", "row", "at"])

    same_core, same_full = W.partitionBy("core"), W.partitionBy("core", "full")
    # one cell stands for each extent, so an extent met twice here is a part that several extents of the cell share
    parts = cell_parts(rows, undecided, length).withColumns({"low": F.min("full").over(same_core), "high": F.max("full").over(same_core)})
    parts = cut(parts.withColumn("n", F.count("*").over(same_full)).filter("low != high OR n > 1").drop("low", "high"))
    mixed = parts.select("core", "full", "n").groupBy("core").agg(F.min("full").alias("low"), F.max("full").alias("high")).filter("low != high").select("core")
    singles = parts.join(mixed, "core", "left_semi").select("core", "file", "row", "first", "last", "strings")
    each = cut(singles.mapInArrow(unpacked, "core long, string long, file long, row long, at int"))
    twice = each.groupBy("core", "string").agg(F.count("*").alias("c")).filter("c > 1").select("core", "string")
    # every holder of a string that several extents share is removed, however many there are
    ends = each.join(twice, ["core", "string"], "left_semi").select("file", "row", F.col("at").alias("first"), F.col("at").alias("last"))
    return parts.filter("n > 1").select("file", "row", "first", "last").unionByName(ends)


def remove_repeats(docs: DataFrame, length: int = 400, batches: int = BATCHES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, kept, n_removed, n_spans`` for every row; ``kept`` is the remaining bytes."""
    rows = with_row_ids(docs, text, key)
    long_rows = rows.filter(F.octet_length("text") >= length)
    family = Family()
    for batch in range(batches):
        family.add(entries_of(long_rows.filter(F.pmod(F.xxhash64("file", "row"), F.lit(batches)) == batch), length))
    index = family.merged()
    open_cells = index.filter("n > 1 OR extents > 1")
    met = cut(placed_cells(long_rows, length).join(open_cells, ["core", "full"]))
    whole = met.filter("n > 1").select("file", "row", "first", "last")
    one_each = met.filter("extents > 1").groupBy("core", "full").agg(F.min(F.struct("file", "row", "first", "last", "anchor")).alias("c"))
    parts = repeated_strings(long_rows, one_each.select("c.*"), length)
    runs = whole.unionByName(parts).groupBy("file", "row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # at most a text's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, bounds = utf8(b.column(1))
            kept, removed, spans = [], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            lists = b.column(2)
            edges, flat = lists.offsets.to_numpy(), lists.values
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            for x in range(b.num_rows):
                own = raw[bounds[x] : bounds[x + 1]]
                if edges[x + 1] > edges[x]:
                    delta = np.zeros(len(own) + 1, np.int32)
                    np.add.at(delta, first[edges[x] : edges[x + 1]], 1)
                    np.add.at(delta, last[edges[x] : edges[x + 1]] + length, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    removed[x] = int(gone.sum())
                    spans[x] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(bounds)), pa.array(kept, pa.binary()), pa.array(removed), pa.array(spans)], ["doc_id", "n_bytes", "kept", "n_removed", "n_spans"]
            )

    none = F.array().cast("array<struct<first:int,last:int>>")
    joined = rows.join(runs, ["file", "row"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return joined.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, kept binary, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
