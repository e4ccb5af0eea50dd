"""Secret scans by grammar inference.

One scan finds the base spans of every text and other tokens of six characters or more with a letter and a digit, dots included. All distinct
values of the base spans are the labelled credentials. Tasks count, over every value of a kind, which character class follows
each place and class before it (places past ``PLACES`` are one); these counts, of a size that does not grow with the input,
are an acyclic automaton but for its last place. States whose outgoing frequencies agree within Hoeffding's bound, there and
at all states reached from them, are merged. Every candidate is then scored by its log-likelihood for each character, under
each automaton, against uniform characters; a token is added when its score, in thousandths, reaches the lowest hundredth of
what the automaton gives all labelled values of its kind. Base spans always stay.

Defined results: a null or empty text has no spans. Positions are code points, ends exclusive. Repeated rows are handled one
by one. Without labelled values nothing is added. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
BASE = ("assign", "access", "hex")
LEARNED = "learned"
#: Other tokens worth a score: of the labelled values' alphabet and least length, with a letter and a digit. A full stop at the end is none's.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[+/_.=A-Za-z-]*[0-9])(?=[+/_.=0-9-]*[A-Za-z])[A-Za-z0-9+/_.=-]{5,}[A-Za-z0-9+/_=-]")
PLACES = 128
ALPHA = 0.01
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Base spans by start, then kind as listed. Guards before a pattern only skip texts that cannot match."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def other_tokens(text: str, taken: list) -> list[tuple[str, int, int, str]]:
    """Tokens outside every base span."""
    found = [(LEARNED, m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    return [t for t in found if all(t[2] <= s[1] or t[1] >= s[2] for s in taken)] if found else found


def classes(value: str) -> list[int]:
    """Character classes: digit, a-f, g-z, A-F, G-Z, and each sign by itself."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(0)
        elif "a" <= c <= "z":
            out.append(1 if c <= "f" else 2)
        elif "A" <= c <= "Z":
            out.append(3 if c <= "F" else 4)
        else:
            out.append(5 + "+/_=-.".find(c))
    return out


CLASS_SIZES = (10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1)


def steps(value: str) -> Iterator[tuple[int, int, int]]:
    """Place, class before it (-1 at the start) and class there, for each character; the end's class is -1."""
    last = -1
    for place, symbol in enumerate([*classes(value), -1]):
        yield min(place, PLACES), last, symbol
        last = symbol


class Automaton:
    """A probabilistic automaton from counted :func:`steps`: per state the visits, the ending count and, per symbol, count and next state."""

    def __init__(self, counts: dict[tuple[int, int, int], int], alpha: float = ALPHA) -> None:
        named = {name: i for i, name in enumerate(sorted({(place, last) for place, last, _ in counts}))}  # the start comes first
        self.ends = [0] * len(named)
        self.moves: list[dict[int, list[int]]] = [{} for _ in named]
        for (place, last, symbol), n in sorted(counts.items()):
            state = named[place, last]
            if symbol < 0:
                self.ends[state] = n
            else:
                self.moves[state][symbol] = [n, named[min(place + 1, PLACES), symbol]]
        self.visits = [e + sum(n for n, _ in m.values()) for e, m in zip(self.ends, self.moves, strict=True)]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._into = list(range(len(named)))
        self._merge()

    def _find(self, state: int) -> int:
        while self._into[state] != state:
            self._into[state] = state = self._into[self._into[state]]
        return state

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self._bound * (n**-0.5 + m**-0.5)

    def _compatible(self, red: int, blue: int) -> bool:
        """Hoeffding's test for the ending and each symbol, at this pair and all pairs reached from it."""
        waiting, seen = [(red, blue)], {(red, blue)}
        while waiting:
            a, b = waiting.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for symbol in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(symbol), self.moves[b].get(symbol)
                if self._differ(x[0] if x else 0, n, y[0] if y else 0, m):
                    return False
                if x and y:
                    pair = self._find(x[1]), self._find(y[1])
                    if pair[0] != pair[1] and pair not in seen:
                        seen.add(pair)
                        waiting.append(pair)
        return True

    def _fold(self, red: int, blue: int, known: set[int]) -> None:
        waiting = [(red, blue)]
        while waiting:
            a, b = (self._find(x) for x in waiting.pop())
            if a == b:
                continue
            if b in known and a not in known:
                a, b = b, a
            self._into[b] = a
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for symbol, (n, to) in self.moves[b].items():
                if symbol in self.moves[a]:
                    self.moves[a][symbol][0] += n
                    waiting.append((self.moves[a][symbol][1], to))
                else:
                    self.moves[a][symbol] = [n, to]

    def _merge(self) -> None:
        """Red states are final; each blue successor, most visited first, joins a compatible red state or turns red."""
        red = [0]
        while True:
            known = {self._find(r) for r in red}
            red = [r for r in red if r in known]
            blue = {self._find(to) for r in red for _, to in self.moves[r].values()} - known
            if not blue:
                break
            to = max(blue, key=lambda x: (self.visits[x], -x))
            for r in red:
                if self._compatible(r, to):
                    self._fold(r, to, known)
                    break
            else:
                red.append(to)
        self.states = red
        for r in red:
            for move in self.moves[r].values():
                move[1] = self._find(move[1])

    def score(self, value: str) -> float:
        """Log-likelihood for each character, less that of uniform characters; minus infinity for an unknown format."""
        total, state = 0.0, 0
        for symbol in classes(value):
            move = self.moves[state].get(symbol)
            if move is None:
                return -math.inf
            total += math.log(move[0] / self.visits[state] / CLASS_SIZES[symbol]) + math.log(sum(CLASS_SIZES))
            state = move[1]
        return total / max(1, len(value)) if self.ends[state] else -math.inf


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, base, tokens``: base spans and other tokens of every text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, tokens = [], []
            for x in b.column(1):
                t = x.as_py()
                found = base_spans(t)
                base.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in found])
                tokens.append([dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in other_tokens(t, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, ARROW_SPAN), pa.array(tokens, ARROW_SPAN)], ["doc_id", "base", "tokens"])

    chosen = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, base {SPAN}, tokens {SPAN}")


def thousandths(score: float) -> float:
    """A score rounded down, so that the scores of any number of values are few; minus infinity stays."""
    return math.floor(1000 * score) if score > -math.inf else score


def learn(scanned: DataFrame) -> dict[str, tuple[Automaton, int]]:
    """An automaton and its least score, in thousandths, for each kind, from all distinct labelled values."""
    values = cut(scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            for kind, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update((kind, *step) for step in steps(value))
        names = ["kind", "place", "last", "symbol", "n"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, n), strict=True)) for k, n in total.items()], pa.schema(
            [("kind", pa.string()), ("place", pa.int32()), ("last", pa.int32()), ("symbol", pa.int32()), ("n", pa.int64())]))

    counted = values.mapInArrow(count, "kind string, place int, last int, symbol int, n long")
    rows = counted.groupBy("kind", "place", "last", "symbol").agg(F.sum("n").alias("n")).collect()  # (PLACES + 1) * 12 * 12 for each kind at most
    automata = {kind: Automaton(found) for kind in BASE if (found := {(r["place"], r["last"], r["symbol"]): r["n"] for r in rows if r["kind"] == kind})}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for b in batches:
            total.update((k, thousandths(automata[k].score(v))) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pylist([{"kind": k, "score": x, "n": n} for (k, x), n in total.items()], pa.schema(
            [("kind", pa.string()), ("score", pa.int32()), ("n", pa.int64())]))

    met = values.mapInArrow(scores, "kind string, score int, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    model = {}
    for kind, automaton in automata.items():
        of_kind = [(r["score"], r["n"]) for r in met if r["kind"] == kind]
        below = sum(n for _, n in of_kind) // 100
        for least, n in of_kind:
            below -= n
            if below < 0:
                model[kind] = automaton, least
                break
    return model


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, base, spans``: base spans, and all spans by start, then kind as listed (learned ones last)."""
    scanned = cut(scan(docs, text, key))
    model = learn(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for base, tokens in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                more = [t for t in tokens if any(thousandths(a.score(t["value"])) >= least for a, least in model.values())]
                spans.append(sorted(base + more, key=lambda s: (s["start"], (*BASE, LEARNED).index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, ARROW_SPAN)], ["doc_id", "base", "spans"])

    return scanned.mapInArrow(run, f"doc_id {scanned.schema['doc_id'].dataType.simpleString()}, base {SPAN}, spans {SPAN}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k) for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
