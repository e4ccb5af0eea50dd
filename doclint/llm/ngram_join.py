"""N-gram Jaccard join: which documents link by equal word shingles, and the components of the links.

A document is its set of ``k``-word shingles as 64-bit hashes. Documents with equal sets are one class, so copies cost
nothing further. Two classes link when ``100 * |A & B| >= threshold * |A | B|``, found without comparing all pairs:

1. Shingles are ordered by how full their hash bucket is over the whole corpus (``2 ** BUCKETS`` counters), so common
   shingles come last. Linked sets must share a shingle among the first ``n - ceil(threshold * n) + 1`` of each; only
   these are shuffled, and only shingles met in two classes or more stay.
2. Star rounds compare each class with one leader per shared shingle, so a large group of near copies is joined up in as
   many comparisons as it has members.
3. Only classes that share such a shingle and are still in different components are compared with each other, in tiles of
   one shingle and one size band (sizes of linked sets differ by the threshold at most, hence lie in the same or the next
   band), with bounds by size, by position (as at the first shared shingle) and by parity sketch before a pair leaves the tile.
   A class carries the shingles that come before the tile's own in its prefix (``EARLIER`` at most): two classes that share
   one of these have met there already, so a pair leaves one tile, however many shingles it shares.
4. Of the pairs of each component the ``CLOSEST`` by sketch are compared first; most of the others then lie inside one
   component. What is left between components is compared whole.

A comparison first takes hashed bitmap signatures, as wide as the size band asks for: bits set in one and not in the other
bound the overlap from above. Pairs that pass are intersected exactly as sorted arrays. No pair that could link is skipped
unless its two classes are already in one component, so components are exact.

Defined results: a null or empty text, or one of white space only, has no shingles and links with nothing; with fewer than
``k`` words the whole sequence is one shingle. Repeated rows are copies. A component's id is its least doc_id; null doc_ids
do not count, unless all are null. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import cut, placed, shared_folder, slices, table, text_of, utf8
from .components import components

BUCKETS = 18
SKETCH = 4
STARS = 1
EARLIER = 32
CLOSEST = 4
SLICES = 64


def sets_of(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the n + 1 offsets of the texts."""
    raw = words.LOWER[raw]
    starts, ends, offsets = words.word_spans(raw, bounds, words.SPACE)
    runs, of = words.shingles(words.word_hashes(raw, starts, ends), offsets, k)
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    runs, of = runs[first], of[first]
    return runs, np.searchsorted(of, np.arange(len(bounds)))


def keys_of(runs: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; None for an empty one."""
    a, b = np.cumsum(words.mix(runs ^ words.BASE)), np.cumsum(words.mix(runs * words.BASE + np.uint64(1)))
    a, b = (np.diff(np.concatenate((np.zeros(1, np.uint64), x))[offsets]) for x in (a, b))
    both = np.stack((a, b), 1).astype("<u8").tobytes()
    return [both[16 * i : 16 * i + 16] if n else None for i, n in enumerate(np.diff(offsets).tolist())]


def sketches(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs for each set: every member flips one bit, so bits that differ between two sets bound their difference from below."""
    bits = SKETCH * 64
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    flips = np.bincount(of * bits + (words.mix(runs) & np.uint64(bits - 1)).astype(np.int64), minlength=(len(offsets) - 1) * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view("<i8")


def need(n: np.ndarray | int, threshold: int):
    """The least overlap of a set of n with any set it links with."""
    return (threshold * n + 99) // 100


def bucket_fill(texts: DataFrame, k: int) -> np.ndarray:
    """The logarithm of how many shingles each bucket holds in the corpus: one pass, counters of fixed size."""
    width = (1 << BUCKETS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for b in batches:
            raw, bounds = utf8(b.column(0))
            for i, j in slices(bounds):
                runs, _ = sets_of(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k)
                total += np.bincount((runs >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=len(total))
        if total.any():
            parts = [total[s * width : (s + 1) * width].tobytes() for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(key, parts):
        total = np.zeros(width, np.int64)
        for x in parts.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        level = np.floor(4 * np.log2(total + 1)).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    counted = texts.mapInArrow(count, "slice int, counts binary")
    rows = counted.groupBy("slice").applyInArrow(add, "slice int, levels binary").collect()  # 2 ** BUCKETS bytes
    out = np.zeros(1 << BUCKETS, np.uint8)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


def signatures(rows: DataFrame, levels: np.ndarray, k: int, threshold: int) -> DataFrame:
    """``doc_id, key, n, sketch, prefix``: class key, set size, parity sketch, and the shingles of the prefix, rarest first."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = shared.value
        for b in batches:
            raw, bounds = utf8(b.column(1))
            for i, j in slices(bounds):
                runs, offsets = sets_of(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k)
                n = np.diff(offsets)
                order = np.lexsort((runs, fill[(runs >> np.uint64(64 - BUCKETS)).astype(np.int64)], np.repeat(np.arange(len(n)), n)))
                ranked = runs[order]
                length = np.where(n > 0, n - need(n, threshold) + 1, 0)
                place = np.arange(int(length.sum())) + np.repeat(offsets[:-1] - (np.cumsum(length) - length), length)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(ranked[place].view(np.int64)))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * SKETCH, pa.int32()), pa.array(sketches(runs, offsets).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(keys_of(runs, offsets), pa.binary()), pa.array(n, pa.int64()), sketch, lists], ["doc_id", "key", "n", "sketch", "prefix"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, n long, sketch array<long>, prefix array<long>")


def shared_tokens(signed: DataFrame) -> DataFrame:
    """``token, key, n, at``: prefix shingles met in two classes or more. One sorted stream; memory holds one batch."""
    tokens = signed.filter("n > 0").select("key", "n", F.posexplode("prefix").alias("at", "token"))

    def only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last token's first row, held back while its class may be alone
        shown = False
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            token = b.column(0).to_numpy()
            fixed = b.column(1).cast(pa.binary(16))
            key = np.frombuffer(fixed.buffers()[1], "V16")[fixed.offset : fixed.offset + b.num_rows]
            new_token = np.ones(b.num_rows, bool)
            new_token[1:] = token[1:] != token[:-1]
            new_key = new_token.copy()
            new_key[1:] |= key[1:] != key[:-1]
            group = np.cumsum(new_token) - 1
            classes = np.bincount(group[new_key])
            show = classes[group] > 1
            if rest is not None and shown:
                show |= group == 0
            keep = show & new_key
            if rest is not None and shown:
                keep[0] = False
            last = int(group[-1])
            at_end = np.flatnonzero((group == last) & new_key)[-1]
            shown = bool(show[-1])
            if not shown:
                keep[group == last] = False
            rest = b.slice(int(at_end), 1)
            if keep.any():
                yield b.filter(pa.array(keep))

    dealt = tokens.select("token", "key", "n", "at").repartition("token").sortWithinPartitions("token", "key")
    return dealt.mapInArrow(only_shared, "token long, key binary, n long, at int")


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    place = (values & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return out


def width(n: int) -> int:
    """Bits of a signature: four for each member of the size band's largest set, as a power of two."""
    return max(64, 1 << (4 * n - 1).bit_length())


def class_table(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``key, n, bits, text`` of the wanted classes as a table bucketed by key, so comparisons never shuffle it again.

    Each task sends a class once, so copies do not pile up.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            raw, bounds = utf8(b.column(0))
            for i, j in slices(bounds):
                runs, offsets = sets_of(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k)
                keep, keys, bits = [], [], []
                for at, key in enumerate(keys_of(runs, offsets)):
                    if key is not None and key not in seen:
                        seen.add(key)
                        keep.append(at)
                        keys.append(key)
                        own = runs[offsets[at] : offsets[at + 1]]
                        bits.append(bitmap(own, width(len(own))).tobytes())
                if keep:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, pa.binary()), pa.array(np.diff(offsets)[keep], pa.int64()), pa.array(bits, pa.binary()),
                        b.column(0).slice(i, j - i).take(pa.array(keep)),
                    ], ["key", "n", "bits", "text"])

    spark = rows.sparkSession
    found = rows.select("text").mapInArrow(texts, "key binary, n long, bits binary, text string").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"doclint_classes_{uuid.uuid4().hex}"
    found.repartition(buckets, "key").write.bucketBy(buckets, "key").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def least_overlap(n: int, threshold: int) -> int:
    """The least overlap of two linked sets with n members in all."""
    return -(-threshold * n // (100 + threshold))


def may_link(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """The signatures' bound: a bit set in one alone is a member of that one alone. Wider signatures are folded first."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    bound = min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))
    return bound >= least_overlap(n_a + n_b, threshold)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """The exact overlap of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= least_overlap(len(both), threshold)


def verified(pairs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs ``a, b`` that link: signatures are compared first, and only what passes has its texts read."""

    def sides(df: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("b", "a"):
            df = df.join(classes.select(F.col("key").alias(side), *(F.col(c).alias(side + c) for c in columns)), side)
        return df

    def by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            ok = [
                may_link(n, m, np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8), threshold)
                for n, m, x, y in zip(at["an"].to_pylist(), at["bn"].to_pylist(), at["abits"], at["bbits"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([at["a"], at["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def by_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            ok = []
            for x, y in zip(at["atext"], at["btext"], strict=True):
                raw, bounds = utf8(pa.array([x.as_py(), y.as_py()], pa.string()))
                runs, offsets = sets_of(raw, bounds, k)
                ok.append(linked(runs[: offsets[1]], runs[offsets[1] :], threshold))
            yield pa.RecordBatch.from_arrays([at["a"], at["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    schema = "a binary, b binary"
    left = cut(sides(pairs, ["n", "bits"]).mapInArrow(by_signature, schema))
    return cut(sides(left, ["text"]).mapInArrow(by_members, schema))


def _size_ok(threshold: int):
    return 100 * F.least("an", "bn") >= threshold * F.greatest("an", "bn")


def _still_open(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens that join different components; ``label`` is the component so far."""
    named = cut(tokens.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    open_tokens = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("token")
    return named.join(open_tokens, "token", "left_semi")


def links(rows: DataFrame, signed: DataFrame, k: int, threshold: int) -> DataFrame:
    """``key, label`` for all classes that link with another one."""
    tokens = cut(shared_tokens(signed))
    classes = class_table(rows, tokens.select("key").distinct(), k)
    edges, labels, tried = None, None, None
    at_hand = tokens.withColumn("label", F.col("key"))
    for r in range(STARS):
        order = F.struct(F.xxhash64("key", F.lit(r)).alias("h"), F.col("key").alias("leader"), F.col("n").alias("an"), F.col("label").alias("al"))
        leaders = at_hand.groupBy("token").agg(F.min(order).alias("first")).select("token", "first.leader", "first.an", "first.al")
        pairs = at_hand.join(leaders, "token").filter(F.col("al") != F.col("label")).withColumn("bn", F.col("n")).filter(_size_ok(threshold))
        pairs = cut(pairs.select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct())
        found = verified(pairs, classes, k, threshold)
        tried = pairs if tried is None else tried.union(pairs)
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
        at_hand = cut(_still_open(tokens, labels))
    sketch = signed.filter("n > 0").select("key", *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH))).dropDuplicates(["key"])
    # a class has at most its own prefix of tokens
    own = at_hand.groupBy("key").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("at", "token"))).alias("met"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold)).cast("int")
    placed = own.join(sketch, "key").select("*", F.col("met.token").alias("tokens"), F.posexplode("met").alias("i", "m"))
    earlier = F.slice("tokens", F.lit(1), F.least(F.col("i"), F.lit(EARLIER)))
    tiled = placed.select("key", "n", "label", *(f"s{i}" for i in range(SKETCH)), "m.at", "m.token", earlier.alias("earlier"), band.alias("band"))
    side = lambda x: [F.col(c).alias(x + c) for c in ("key", "n", "at", "label", "earlier", *(f"s{i}" for i in range(SKETCH)))]
    short = tiled.filter((100 + threshold) * (F.col("n") - F.col("at")) >= 2 * threshold * F.col("n"))  # the smaller set needs a shorter prefix
    left = short.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("tile"), *side("a"))  # the smaller set meets its own and the next band
    right = tiled.select("token", F.col("band").alias("tile"), *side("b"))
    both = F.col("an") + F.col("bn")
    ordered = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("akey") < F.col("bkey")))
    # at the first shingle that two linked sets share, each still has as many members to come as they must share
    enough = lambda n, at: (100 + threshold) * (F.col(n) - F.col(at)) >= threshold * both
    differ = sum((F.bit_count(F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}"))) for i in range(SKETCH)), F.lit(0))
    possible = _size_ok(threshold) & enough("an", "aat") & enough("bn", "bat") & ((100 + threshold) * differ <= (100 - threshold) * both)
    possible = possible & ~F.arrays_overlap("aearlier", "bearlier")
    crossed = left.join(right, ["token", "tile"]).filter(ordered & (F.col("alabel") != F.col("blabel")) & possible)
    crossed = crossed.select(F.least("akey", "bkey").alias("a"), F.greatest("akey", "bkey").alias("b"), differ.alias("differ")).distinct()
    crossed = cut(crossed.join(tried, ["a", "b"], "left_anti"))
    # of each component the pairs that look closest go first: most of the others are inside one component afterwards
    apart = _apart(crossed, labels)
    ends = apart.select("a", "b", "differ", F.explode(F.array("alabel", "blabel")).alias("label"))
    lots = ends.groupBy("label", F.pmod(F.xxhash64("a", "b"), F.lit(CLOSEST))).agg(F.min(F.struct("differ", "a", "b")).alias("p"))
    closest = cut(lots.select("p.a", "p.b").distinct())
    edges = cut(edges.union(verified(closest, classes, k, threshold)))
    rest = _apart(crossed, components(edges)).select("a", "b").join(closest, ["a", "b"], "left_anti")
    return components(edges.union(verified(cut(rest), classes, k, threshold)))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components, with both labels."""
    for side in ("a", "b"):
        named = labels.select(F.col("key").alias(side), F.col("label").alias(f"{side}label"))
        pairs = pairs.join(named, side, "left").withColumn(f"{side}label", F.coalesce(f"{side}label", side))
    return pairs.filter("alabel != blabel")


def join(docs: DataFrame, k: int = 4, threshold: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n, component_id`` for every row; links from ``threshold`` per cent of the union on."""
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    signed = cut(signatures(rows, bucket_fill(rows.select("text"), k), k, threshold))
    classes = signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    labelled = classes.join(links(rows, signed, k, threshold), "key", "left").withColumn("label", F.coalesce("label", "key"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.select("key", "label").join(ids, "label").select("key", "component_id")
    out = signed.select("doc_id", "key", "n").join(named, "key", "left")
    return out.select("doc_id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents without near duplicates, with their own columns: of each component the row of the least doc_id stays.

    Rows without words stay. Rows are told apart by their place in their file, so of repeated rows one stays.
    """
    named, place = placed(docs)
    ident = F.struct(F.col("doc_id").alias("doc_id"), place.alias("place"))
    found = join(named.select(ident.alias("doc_id"), "text"), k, threshold)
    dropped = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.place").alias("_dropped"))
    return named.join(dropped, place == F.col("_dropped"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
