"""Token counts by overlap resynchronisation, with the tokenizer's own library.

A text of at most ``CHUNK`` characters is counted at once. A longer one is encoded in overlapping chunks with offsets, and
neighbours are spliced where both have a token start that is proven stable: for tokenizers that drop white space, right
after white space; for others, at a single space between two words. What lies left of such a place cannot change the tokens
right of it, nor the other way round. Where the overlap holds no such place it is widened, doubling, and where it would reach
back to the last splice the chunk itself grows, so a text without any white space ends as one chunk.

If the tokenizer drops white space, texts of one chunk are counted by their words, each distinct word encoded once per task
while a bounded cache holds it: the same stable places, all of them.

Defined results: a null or empty text has 0 tokens. Special strings in a text count as the library has it by default, and
no begin, end or added tokens, truncation or padding apply. Repeated rows are counted alike. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE, parts_of, public_path
from .common import table, text_of, utf8

CHUNK, OVERLAP = 1 << 15, 256
CACHED = 400_000
LIMIT = 2048
#: Places right after white space; places at a single space between two words.
AFTER_WHITE = regex.compile(rf"(?<=[{WHITE}])[^{WHITE}]")
AT_SPACE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
CONTROLS = regex.compile(r"[\x1c-\x1f]")


class Counter:
    """Counts with a library tokenizer, from the bytes of its file."""

    def __init__(self, data: bytes, suffix: str) -> None:
        self.words_apart = False
        self.known: dict[str, int] = {}
        if suffix == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(data.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            steps = (json.loads(data).get("pre_tokenizer") or {}).get("pretokenizers", [])
            self.words_apart = any(s.get("behavior") == "Removed" and s.get("invert") for s in steps)
            self.starts = lambda t: [a for a, _ in self.tokenizer.encode(t, add_special_tokens=False).offsets]
            self.counts = lambda ts: [len(e) for e in self.tokenizer.encode_batch_fast(ts, add_special_tokens=False)]
        else:
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.counts = lambda ts: [len(x) for x in self.tokenizer.encode(ts, num_threads=1)]
        # a sentencepiece model rewrites white space, so no place is proven and its texts are encoded whole
        self.stable = AFTER_WHITE if self.words_apart else AT_SPACE if suffix == ".json" else None

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text."""
        total = base = begin = 0  # tokens before base are counted; begin, end: the chunk at hand
        end, size = min(len(text), chunk), chunk
        left = self.starts(text[:end])
        while end < len(text):
            wide, place = overlap, None
            while end - wide > base:
                start = end - wide
                stop = min(len(text), end + chunk)
                right = self.starts(text[start:stop])
                ours, theirs = {a + begin for a in left}, {a + start for a in right}
                place = next((m.start() for m in self.stable.finditer(text, start + 1, end) if m.start() > base and m.start() in ours and m.start() in theirs), None)
                if place is not None:
                    break
                wide *= 2
            if place is None:  # no stable place since the last splice: a larger chunk
                size *= 2
                begin, end = base, min(len(text), base + size)
                left = self.starts(text[begin:end])
                continue
            total += bisect_left(left, place - begin) - bisect_left(left, base - begin)
            base, begin, end, left, size = place, start, stop, right, chunk
        return total + len(left) - bisect_left(left, base - begin)

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK or not self.stable]
        plain = [i for i in short if self.words_apart and not CONTROLS.search(texts[i])]
        split = [texts[i].split() for i in plain]
        for i, n in zip(plain, self._by_words(split), strict=True):
            out[i] = n
        rest = [i for i in short if i not in set(plain)] if len(plain) < len(short) else []
        for i, n in zip(rest, self.counts([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > CHUNK and self.stable:
                out[i] = self.spliced(t)
        return out

    def _by_words(self, split: list[list[str]]) -> list[int]:
        flat = list(chain.from_iterable(split))
        if len(self.known) > CACHED:
            self.known.clear()
        got = list(map(self.known.get, flat))
        if None in got:
            new = list(dict.fromkeys(w for w, n in zip(flat, got, strict=True) if n is None))
            self.known.update(zip(new, self.counts(new), strict=True))
            got = list(map(self.known.get, flat))
        ends = np.concatenate(([0], np.cumsum(np.array(got, np.int64))))
        return np.diff(ends[np.concatenate(([0], np.cumsum([len(s) for s in split]))).astype(np.int64)]).tolist()


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every document. The driver reads the tokenizer's file; its size is the vocabulary's."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), os.path.splitext(path)[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            for part in parts_of(b, 1):
                n = counter.count(part.column(1).to_pylist())
                size = np.diff(utf8(part.column(1))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
