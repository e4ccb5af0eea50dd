"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words (whole-word tokens of the vocabulary, and words whose share of the corpus is at least 1 / ``WORDS``) are
compiled into an acyclic automaton with shared suffixes. Every edge carries how many words it skips, so the walk of a word
sums up to its number, which indexes its ids: a minimal transducer from words to id lists. The driver writes it once as one
file, Spark hands it to the executors, and tasks map it into memory. Words that it lacks are merged exactly: all unseen
words of a slice at once, lowest rank first, leftmost first. Each task keeps a bounded cache of the words it has met.

Any tokenizer file of this kind works: BPE with an end-of-word suffix, NFC, lower case, white space dropped, words split as
``PIECES`` says, special tokens found in the raw text. Its path is read by the driver alone.

Defined results: a null or empty text has no ids, and no ids decode to the empty text. Repeated rows are encoded alike. A
word of any length is merged exactly. Other columns are not read; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Unicode white space, and how the tokenizer cuts words.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: At most so many corpus words enter the lexicon.
WORDS = 200_000
CACHED = 500_000
SLICE = 1 << 20
NEVER = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file as arrays: first symbols of bytes, merges sorted by pair, token strings, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        characters = byte_characters()
        self.inner = np.array([ids[c] for c in characters], np.int64)
        self.final = np.array([ids[c + suffix] for c in characters], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        made = {m: i for i, m in reversed(list(enumerate(self.merged.tolist())))}
        if any(made.get(ids[x], -1) >= i for i, p in enumerate(pairs) for x in p):
            raise ValueError("a merge uses a token that is only made later; merging by rounds would not be exact")
        self.tokens = [""] * self.size
        for token, i in chain(ids.items(), self.special.items()):
            self.tokens[i] = token
        #: Words that are one token of the vocabulary.
        back = {c: b for b, c in enumerate(characters)}
        self.whole = [bytes(back[c] for c in t[: -len(suffix)]) for t in ids if suffix and t.endswith(suffix) and len(t) > len(suffix)]

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From the attributes of another one; plain values travel by broadcast wherever the package is not installed."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their n + 1 offsets."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(lengths) - 1
        symbols = self.inner[raw]
        symbols[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), NEVER, np.int32)
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NEVER
            if over.any():
                done.append((word[over], symbols[over]))
                on = ~over
                symbols, word, rank, least = symbols[on], word[on], rank[on], least[on]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == least)
            # of neighbouring choices (a pair of equal tokens in a row) every second one counts, from the left
            run = np.concatenate(([True], (np.diff(chosen) != 1) | (word[chosen[1:]] != word[chosen[:-1]])))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - begin) % 2 == 0]
            symbols[chosen] = self.merged[rank[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        owner, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))


def compile_words(words: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transducer of sorted distinct words as one array of numbers, ready to be written and mapped.

    Words come in order, so states off the current word's path never change again and are folded into equal ones at once.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[tuple[list, list]] = [([False], [])]  # per depth: final flag, edges (byte, state)

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            state = (final[0], tuple(edges))
            number = register.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            parent = path[-1][1]
            parent[-1] = (parent[-1][0], number)

    before = b""
    for w in words:
        common = 0
        while common < min(len(w), len(before)) and w[common] == before[common]:
            common += 1
        fold(common)
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append(([False], []))
        path[-1][0][0] = True
        before = w
    fold(0)
    root = len(states)
    states.append((path[0][0][0], tuple(path[0][1])))
    reached: list[int] = []
    keys, to, skip = [], [], []
    for number, (final, edges) in enumerate(states):
        total = int(final)
        for b, target in edges:
            keys.append(number * 256 + b)
            to.append(target)
            skip.append(total)
            total += reached[target]
        reached.append(total)
    parts = [keys, to, skip, [int(f) for f, _ in states], ids.tolist(), offsets.tolist()]
    return np.concatenate([np.array([root, *map(len, parts)], np.int64), *(np.array(p, np.int64) for p in parts)])


class Lexicon:
    """Look-ups in a mapped transducer, many words at once."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.root = int(numbers[0])
        ends = 7 + np.cumsum(numbers[1:7])
        parts = [numbers[a:b] for a, b in zip([7, *ends[:-1]], ends, strict=True)]
        self.keys, self.to, self.skip, self.final, self.ids, self.offsets = parts

    def numbers_of(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it."""
        state = np.full(len(words), self.root)
        out = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return out - 1
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        active = np.flatnonzero(lengths > 0)
        step = 0
        while len(active):
            key = state[active] * 256 + raw[first[active] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[active] = np.where(ok, self.to[at], -1)
            out[active] += self.skip[at]
            step += 1
            active = active[ok]
            active = active[lengths[active] > step]
        found = (state >= 0) & (lengths > 0)
        found[found] = self.final[state[found]] == 1
        return np.where(found, out, -1)


class Encoder:
    """Encodes texts slice by slice; keeps the ids of the chunks (between white space) it has met."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.white = regex.compile(f"[{WHITE}]+")
        self.odd = regex.compile(r"[\x1c-\x1f]")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The text between white space. Python's own split also cuts at four control characters that are no white space."""
        if self.odd.search(text):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def _pieces(self, chunk: str) -> list[str | int]:
        """Words of one chunk, normalised; special tokens as their ids."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
        elif not unicodedata.is_normalized("NFC", chunk):
            return self._odd_pieces(chunk)
        if self.special and "<" in chunk and self.special.search(chunk):
            return self._odd_pieces(chunk)
        return PIECES.findall(self._lower(chunk))

    def _odd_pieces(self, chunk: str) -> list[str | int]:
        out: list[str | int] = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.vocabulary.special:
                out.append(self.vocabulary.special[part])
            else:
                out.extend(PIECES.findall(self._lower(unicodedata.normalize("NFC", part))))
        return out

    @staticmethod
    def _lower(text: str) -> str:
        """Each character by itself: a final sigma stays as any other."""
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks not met before, by lexicon or merging."""
        pieces = list(map(self._pieces, new))
        words = dict.fromkeys(p for ps in pieces for p in ps if isinstance(p, str))
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        number = self.lexicon.numbers_of(coded)
        unseen = np.flatnonzero(number < 0)
        ids, offsets = self.vocabulary.merge([coded[i] for i in unseen]) if len(unseen) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        flat = np.concatenate((self.lexicon.ids.astype(np.int32), ids, np.arange(self.vocabulary.size, dtype=np.int32)))
        start, size = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
        seen = np.flatnonzero(number >= 0)
        start[seen], size[seen] = self.lexicon.offsets[number[seen]], np.diff(self.lexicon.offsets)[number[seen]]
        start[unseen], size[unseen] = offsets[:-1] + len(self.lexicon.ids), np.diff(offsets)
        place = {w: i for i, w in enumerate(words)}
        alone = len(self.lexicon.ids) + len(ids)
        starts, sizes = start.tolist(), size.tolist()
        s = [alone + p if isinstance(p, int) else starts[place[p]] for ps in pieces for p in ps]
        z = [1 if isinstance(p, int) else sizes[place[p]] for ps in pieces for p in ps]
        per = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts, total = gather(flat, np.array(s, np.int64), np.array(z, np.int64))
        ends = np.concatenate(([0], np.cumsum(np.array(z, np.int64))))
        edge = np.concatenate(([0], np.cumsum(per)))
        begin = len(self.known)
        self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, ends[edge[:-1]] + len(self.ids)))
        self.sizes = np.concatenate((self.sizes, ends[edge[1:]] - ends[edge[:-1]]))
        self.ids = np.concatenate((self.ids, parts))

    def places(self, chunks: list[str]) -> np.ndarray:
        """The cache entry of every chunk."""
        if len(self.known) > CACHED:
            self._clear()
        got = list(map(self.known.get, chunks))
        if None in got:
            self._learn(list(dict.fromkeys(c for c, k in zip(chunks, got, strict=True) if k is None)))
            got = list(map(self.known.get, chunks))
        return np.array(got, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their n + 1 offsets."""
        split = list(map(self.chunks, texts))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = self.places(list(chain.from_iterable(split)))
        ids, _ = gather(self.ids, self.starts[at], self.sizes[at])
        ends = np.concatenate(([0], np.cumsum(self.sizes[at])))
        return ids, ends[np.concatenate(([0], np.cumsum(counts)))]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """The runs ``flat[start : start + size]`` one after the other, and their total length."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return flat[np.arange(total) + np.repeat(starts - first, sizes)], total


def frequent_words(docs: DataFrame, text: str = "text") -> list[bytes]:
    """Alphabetic words with at least 1 / WORDS of the corpus, from counts over every document.

    An occurrence takes two characters or more, with the space after it, so WORDS bounds the list.
    """
    t = docs.select(text_of(text).alias("t"))
    total = t.agg(F.sum(F.length("t"))).first()[0] or 0
    words = t.select(F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).filter(F.col("w") != "")
    rows = words.groupBy("w").count().filter(F.col("count") >= max(2, total / (2 * WORDS))).select("w").collect()
    return [unicodedata.normalize("NFC", r["w"]).encode() for r in rows]


def build_lexicon(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    chosen = sorted({*vocabulary.whole, *words} - {b""})
    return compile_words(chosen, *vocabulary.merge(chosen))


def publish(spark: SparkSession, numbers: np.ndarray) -> str:
    """Hands the transducer to all executors as a file; returns its name for :func:`mapped`."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(tempfile.mkdtemp(prefix="doclint-"), name)  # the driver serves it from here
    np.save(path, numbers)
    spark.sparkContext.addFile(path)
    return name


def mapped(name: str) -> Lexicon:
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


class Tokenizer:
    """A tokenizer file made ready for a session: tables broadcast (their size is the vocabulary's), lexicon published."""

    def __init__(self, spark: SparkSession, path: str, words: list[bytes] = ()) -> None:
        vocabulary = Vocabulary(path)
        self.state = spark.sparkContext.broadcast(vars(vocabulary))
        self.lexicon = publish(spark, build_lexicon(vocabulary, list(words)))

    def encoder(self) -> Encoder:
        """For use in tasks."""
        return Encoder(Vocabulary.of(self.state.value), mapped(self.lexicon))


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", key: str = "doc_id", round_trip: bool = False) -> DataFrame:
    """``doc_id, ids`` for every document; ``round_trip`` adds ``decoded`` in the same pass, as :func:`decode` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        tokens = pa.array(encoder.vocabulary.tokens, pa.string())
        for b in batches:
            for part in parts_of(b, 1):
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                more = [joined_tokens(lists, tokens)] if round_trip else []
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *more], ["doc_id", "ids", "decoded"][: 2 + len(more)])

    chosen = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<int>" + (", decoded string" if round_trip else ""))


def parts_of(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes (or list entries) in a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)) if pa.types.is_string(batch.column(column).type) else pc.list_value_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def joined_tokens(lists: pa.Array, tokens: pa.Array) -> pa.Array:
    """Token strings of each list of ids, joined by a space, as a tokenizer file without a decoder asks for."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    flat = lists.flatten()
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
    strings = tokens.take(flat) if pc.all(inside).as_py() in (True, None) else tokens.take(pc.if_else(inside, flat, None)).fill_null("")
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings), " ")


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """The input with ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(tokenizer.state.value["tokens"], pa.string())
        for b in batches:
            at = b.schema.get_field_index("ids")
            for part in parts_of(b, at):
                yield pa.RecordBatch.from_arrays([*part.columns, joined_tokens(part.column(at), tokens)], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokenizer = Tokenizer(spark, path or public_path(), frequent_words(docs))
    return encode(docs, tokenizer, round_trip=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
