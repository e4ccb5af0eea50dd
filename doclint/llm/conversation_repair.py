"""Repair of conversations whose rows were lost, emptied, cut, repeated or given a wrong role.

The roles of a sound conversation, as initials, read ``(s?(ua)+)?``. Edits turn a conversation into one: Keep costs 0, Rerole to
user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; blank and duplicate rows must be deleted, and a truncated
row that stays costs 1 more. Of the cheapest edit lists the one with the ASCII-least initials is taken.

Method, iterative-deepening A*: a depth-first search tries edits in ASCII order (D, I, K, R) under a cost bound that grows to the
least estimate beyond it; a table of failed states keeps the largest budget each failed with; the first accepting path is the
answer. The estimate adds up forced deletions, truncated rows and two for each of the neighbouring rows, taken apart, that cannot
both stay as they are, so it never exceeds the true cost.

On Spark no conversation is gathered into a group: rows without their texts are dealt by ranges of (conversation, turn, role,
text digest), so a huge conversation covers many tasks, in segments of at most ``SEGMENT`` rows. A conversation inside one segment is
searched as it is. Others are searched for every state before and after the segment; a pass over 16 costs and ranks per segment picks
the states. Only the digest of the repaired text, which is sequential by nature, streams the sorted rows of a conversation
through one task, in memory of one batch and the edits.

Defined results: a null role or text is one space, a null conversation is one of its own. Rows come by turn (nulls first), then
role, then MD5 of the text. An empty role has no initial, so it cannot be kept. Repeated rows are duplicates. A conversation without
rows has zeros, an empty audit and the digest of the empty string. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SEGMENT = 256
WHITE = " \t\n\x0b\f\r"
#: States: nothing kept yet, after system, after user, after assistant. A row's kind is its initial's place here, or 0.
INITIALS = "?sua"
KEEP = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
#: The state after an inserted or reroled row.
NEXT = (2, 2, 3, 2)
ROLES = ("", "system", "user", "assistant")
#: Inserts that make a conversation end well in each state.
TAIL = (0, 2, 1, 0)
ACCEPT = -1
NEVER = 1 << 60


class Search:
    """One list of rows. ``rows``: ``(kind, truncated, dead)``; ``dead`` counts rows that must be deleted, 0 for a row that may stay."""

    def __init__(self, rows: list[tuple[int, int, int]], goal: int) -> None:
        if goal != ACCEPT and rows and rows[-1][2] > 1:  # inserts may stand before the very last deletion, not after it
            rows = [*rows[:-1], (0, 0, rows[-1][2] - 1), (0, 0, 1)]
        self.rows, self.goal = rows, goal
        n = len(rows)
        self.forced, self.left, self.last_system = [0] * (n + 1), [0] * (n + 1), [NEVER] * (n + 1)
        self.live: list[int | None] = [None] * (n + 1)  # the kind of the next row that may stay
        self.free = [False] * (n + 1)  # whether no clash of that row is counted yet
        for i in range(n - 1, -1, -1):
            kind, truncated, dead = rows[i]
            self.left[i] = self.left[i + 1] + (dead or 1)
            self.last_system[i] = min(self.last_system[i + 1], truncated - 3 if kind == 1 and not dead else NEVER)
            after, free = self.live[i + 1], self.free[i + 1]
            if dead:
                self.forced[i], self.live[i], self.free[i] = self.forced[i + 1] + 3 * dead, after, free
                continue
            clash = kind == 0 or (not self._may_end(kind) if after is None else free and KEEP[kind][after] is None)
            self.forced[i] = self.forced[i + 1] + truncated + 2 * clash
            self.live[i], self.free[i] = kind, not clash

    def _may_end(self, kind: int) -> bool:
        return kind == 3 if self.goal == ACCEPT else kind == self.goal

    def estimate(self, i: int, state: int) -> int:
        """At most the cost from here to the goal."""
        if 0 <= self.goal < 2:  # nothing, or only a system row, stays
            if state == self.goal:
                return 3 * self.left[i]
            return 3 * self.left[i] + self.last_system[i] if state == 0 and self.last_system[i] < NEVER else NEVER
        if self.live[i] is None:
            return self.forced[i] + (2 * TAIL[state] if self.goal == ACCEPT else 2 * (state != self.goal))
        return self.forced[i] + 2 * (self.free[i] and KEEP[state][self.live[i]] is None)

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Initials, cost and the state after each edit, in ASCII order."""
        here = i < len(self.rows)
        if here:
            kind, truncated, dead = self.rows[i]
            yield "D" * (dead or 1), 3 * (dead or 1), i + 1, state
        if here or self.goal == ACCEPT:
            yield "I", 2, i, NEXT[state]
        if here and not dead:
            if KEEP[state][kind] is not None:
                yield "K", truncated, i + 1, KEEP[state][kind]
            yield "R", 2 + truncated, i + 1, NEXT[state]

    def cheapest(self, entry: int) -> tuple[int, str]:
        """Cost and initials from a state; ``NEVER`` and nothing if the goal cannot be reached."""
        n, bound, failed = len(self.rows), self.estimate(0, entry), {}
        while bound < NEVER:
            beyond, path = NEVER, []
            stack = [(0, entry, 0, self.edits(0, entry))]
            while stack:
                i, state, spent, rest = stack[-1]
                if i == n and (state == self.goal or (self.goal == ACCEPT and TAIL[state] == 0)):
                    return spent, "".join(path)
                for letters, cost, j, after in rest:
                    reached = spent + cost
                    total = reached + self.estimate(j, after)
                    if total > bound:
                        beyond = min(beyond, total)
                    elif failed.get((j, after), -1) < bound - reached:
                        path.append(letters)
                        stack.append((j, after, reached, self.edits(j, after)))
                        break
                else:
                    failed[i, state] = bound - spent
                    stack.pop()
                    if path:
                        path.pop()
            bound = beyond
        return NEVER, ""


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the damage that the checksum of ``conv_id:turn`` modulo 20 asks for."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.filter("fate != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


KEYS = ["conv_id", "turn", "role", "digest"]


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows once, without their text: the keys, ``n`` copies, blank, truncated, and whether the first copy is a duplicate."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    flags = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    light = cut(flags.groupBy(*KEYS, "blank", "truncated").agg(F.count("*").alias("n")))
    # a text said often in one conversation is added up in the tasks first, and its join may be split by row counts
    first = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("r").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return light.join(first, same, "left").select(*KEYS, "n", "blank", "truncated", later.alias("later"))


COUNTS = "n_blank long, n_duplicate long, n_truncated long, n_illegal long, first string, last string, low long, high long, n_turns long"
STATES = [(a, b) for a in range(4) for b in range(4)]


def _measure(rows: list[dict]) -> list:
    """What COUNTS names, of one segment's rows in order."""
    blank = duplicate = truncated = illegal = 0
    low = high = last = None
    turns = 0
    for r in rows:
        n, initial = r["n"], r["role"][:1]
        if r["blank"]:
            blank += n
        else:
            duplicate += n - 1 + r["later"]
            truncated += r["truncated"] and not r["later"]
        illegal += n - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
        last = initial
        if r["turn"] is not None:
            turns += high != r["turn"]
            low, high = r["turn"] if low is None else low, r["turn"]
    return [blank, duplicate, truncated, illegal, rows[0]["role"][:1], last, low, high, turns]


def _search_rows(rows: list[dict]) -> list[tuple[int, int, int]]:
    """Rows as the search takes them; neighbouring rows that must go are one."""
    out: list[tuple[int, int, int]] = []

    def dead(n: int) -> None:
        if out and out[-1][2]:
            out[-1] = (0, 0, out[-1][2] + n)
        else:
            out.append((0, 0, n))

    for r in rows:
        stays = not (r["blank"] or r["later"])
        if stays:
            out.append((max(0, INITIALS.find(r["role"][:1] or "?")), int(r["truncated"]), 0))
        if r["n"] > stays:
            dead(r["n"] - stays)
    return out


def segments(light: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per segment: place, first keys, counts, and the audit (``whole``) or costs, ranks and audits for all states."""
    kind = light.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turn long, role string, digest binary, place long, {COUNTS}, whole boolean, cost long, audit string, costs array<long>, ranks array<int>, audits array<string>"
    names = [f.split()[0] for f in schema.split(", ")]

    def solved(rows: list[dict], place: int, whole: bool) -> list:
        plain = _search_rows(rows)
        out = [*(rows[0][k] for k in KEYS), place, *_measure(rows), whole]
        if whole:
            return [*out, *Search(plain, ACCEPT).cheapest(0), None, None, None]
        goals = [Search(plain, goal) for goal in range(4)]
        found = [goals[b].cheapest(a) for a, b in STATES]
        order = [sorted(found[4 * a + b][1] for b in range(4)) for a in range(4)]
        ranks = [order[a].index(found[4 * a + b][1]) for a, b in STATES]
        return [*out, None, None, [c for c, _ in found], ranks, [s for _, s in found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        out: list[list] = []
        held: list[dict] = []
        started, first = False, True  # does the conversation at hand have earlier segments; is it the task's first one

        def close(whole: bool) -> None:
            nonlocal made
            if held:
                out.append(solved(held, base + made, whole))
                made += 1
                held.clear()

        def batch() -> pa.RecordBatch:
            made_rows = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)
            out.clear()
            return made_rows

        arrow = None
        for b in batches:
            arrow = arrow or _arrow_schema(b.schema.field("conv_id").type)
            for r in b.to_pylist():
                if held and held[-1]["conv_id"] != r["conv_id"]:
                    close(not started and not first)
                    started = first = False
                elif len(held) == size:
                    close(False)
                    started = True
                held.append(r)
            if out:
                yield batch()
        if held:
            close(False)  # the next task may go on with it
            yield batch()

    dealt = light.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(run, schema)


def _arrow_schema(key: pa.DataType) -> pa.Schema:
    whole = pa.int64()
    counts = [(f.split()[0], whole if f.endswith("long") else pa.string()) for f in COUNTS.split(", ")]
    return pa.schema([
        ("conv_id", key), ("turn", whole), ("role", pa.string()), ("digest", pa.binary()), ("place", whole), *counts, ("whole", pa.bool_()), ("cost", whole),
        ("audit", pa.string()), ("costs", pa.list_(whole)), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())),
    ])


def chosen_states(parts: DataFrame) -> DataFrame:
    """``place, entry, leave`` for the segments of conversations with several: 16 costs and ranks a segment are all that is grouped."""

    def choose(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["place"])
        togo = [[2 * x for x in TAIL]]
        for r in reversed(rows):
            togo.append([min(r["costs"][4 * a + b] + togo[-1][b] for b in range(4)) for a in range(4)])
        togo.reverse()
        state, out = 0, []
        for i, r in enumerate(rows):
            best = min((r["costs"][4 * state + b] + togo[i + 1][b], r["ranks"][4 * state + b], b) for b in range(4))[2]
            out.append({"place": r["place"], "entry": state, "leave": best})
            state = best
        return pa.Table.from_pylist(out, pa.schema([("place", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())]))

    return parts.select("conv_id", "place", "costs", "ranks").groupBy("conv_id").applyInArrow(choose, "place long, entry int, leave int")


class _Conversation:
    """Edits and measures of one conversation while its rows stream by."""

    def __init__(self) -> None:
        self.state = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.audits: list[str] = []
        self.at, self.any = 0, False
        self.hash = hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.say(ROLES[self.state], "")

    def finish_segment(self) -> None:
        for _ in range(len(self.audits[-1]) - self.at if self.audits else 0):
            self.insert()

    def segment(self, r: dict) -> None:
        self.finish_segment()
        self.audits.append(r["audit"])
        self.at = 0
        self.cost += r["cost"]
        self.blank, self.duplicate, self.truncated = self.blank + r["n_blank"], self.duplicate + r["n_duplicate"], self.truncated + r["n_truncated"]
        self.illegal += r["n_illegal"] + (self.last is not None and self.last + r["first"] not in ("su", "ua", "au"))
        self.last = r["last"]
        if r["low"] is not None:
            self.turns += r["n_turns"] - (self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def row(self, role: str, text: str) -> None:
        audit = self.audits[-1]
        while audit[self.at] == "I":
            self.insert()
            self.at += 1
        edit, self.at = audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEEP[self.state][INITIALS.index(role[0])]
            self.say(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.say(ROLES[self.state], text)

    def result(self) -> dict:
        self.finish_segment()
        tail = TAIL[self.state]
        for _ in range(tail):
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": self.cost + 2 * tail, "audit": "".join(self.audits) + "I" * tail, "repaired_sha256": self.hash.hexdigest(),
        }


def repair(rows: DataFrame, conv_ids: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every row of ``conv_ids``, once each.

    ``rows``: ``conv_id, turn, role, text`` without nulls in role and text, a subset of these conversations.
    """
    found = cut(segments(cut(judged(rows)), size))
    counts = [f.split()[0] for f in COUNTS.split(", ")]
    parts = found.filter("NOT whole")
    picked = chosen_states(parts).withColumn("pick", 4 * F.col("entry") + F.col("leave")).select("place", "pick")
    at = lambda c: F.get(F.col(c), F.col("pick"))
    settled = parts.join(picked, "place").select(*KEYS, *counts, at("costs").alias("cost"), at("audits").alias("audit"))
    plans = found.filter("whole").select(*KEYS, *counts, "cost", "audit").unionByName(settled).withColumn("step", F.lit(1))
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text", F.lit(2).alias("step"))
    marks = conv_ids.select("conv_id").distinct().withColumn("step", F.lit(0))  # before all rows: turn and role are null
    stream = marks.unionByName(plans, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "step").select("conv_id", "step", "role", "text", "audit", "cost", *counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, kind, out = None, None, None, []
        schema = lambda: pa.schema([("conv_id", kind), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for b in batches:
            kind = b.schema.field("conv_id").type
            ids, step, role, text = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if step[i] == 0:
                    if now:
                        out.append({"conv_id": key, **now.result()})
                    now, key = _Conversation(), ids[i]
                elif step[i] == 1:
                    now.segment(b.slice(i, 1).to_pylist()[0])
                else:
                    now.row(role[i], text[i])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema())
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, **now.result()}], schema())

    kind = conv_ids.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return stream.mapInArrow(run, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair(damaged(given), given.select("conv_id"))


def oracle_sql() -> str:
    """The same in DuckDB: a shortest path over every conversation's rows, folded from left to right.

    The fold keeps, for each of the four states, the least (cost, initials) and the text repaired so far; two possible inserts
    stand before each row and at the end.
    """
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    sep = "CASE WHEN {0}.t = '' THEN '' ELSE chr(10) END"

    def edit(x: str, letter: str, cost: str, said: str | None) -> str:
        text = f"{x}.t || {sep.format(x)} || {said}" if said else f"{x}.t"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {text}}}"

    best = lambda *options: f"list_min([{', '.join(options)}])"
    state = [f"acc[{i + 1}]" for i in range(4)]
    to_user, to_assistant = (0, 1, 3), (2,)
    inserts = [
        state[0], state[1], best(state[2], *(edit(state[i], "I", "2", "'user:'") for i in to_user)),
        best(state[3], *(edit(state[i], "I", "2", "'assistant:'") for i in to_assistant)),
    ]
    gone = [edit(x, "D", "3", None) for x in state]
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    kept = lambda i, initial: f"CASE WHEN r.i = '{initial}' THEN {edit(state[i], 'K', 'r.e', 'r.said')} ELSE {never} END"
    stays = [
        gone[0], best(gone[1], kept(0, "s")),
        best(gone[2], *(edit(state[i], "R", "2 + r.e", "'user:' || r.text") for i in to_user), *(kept(i, "u") for i in to_user)),
        best(gone[3], *(edit(state[i], "R", "2 + r.e", "'assistant:' || r.text") for i in to_assistant), *(kept(i, "a") for i in to_assistant)),
    ]
    as_list = lambda options: f"[{', '.join(options)}]"
    insert = "{'k': 'I', 'i': '', 'e': 0, 'said': '', 'text': ''}"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), fated AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 20 AS fate FROM given, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n, rtrim(text, {white}) AS body FROM damaged
), judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
         WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         COALESCE(LAG(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS jars FROM placed
), gathered AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
         COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated, COUNT(*) FILTER (WHERE jars) AS illegal,
         flatten(list([{insert}, {insert}, {{'k': CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' ELSE 'K' END, 'i': left(role, 1),
           'e': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'said': role || ':' || text, 'text': text}}] ORDER BY n)) AS steps
  FROM judged GROUP BY conv_id
), folded AS (
  SELECT *, list_reduce(list_concat(steps, [{insert}, {insert}]), lambda acc, r: CASE r.k WHEN 'I' THEN {as_list(inserts)} WHEN 'D' THEN {as_list(gone)} ELSE {as_list(stays)} END,
         [{{'c': 0, 'a': '', 't': ''}}, {never}, {never}, {never}]) AS ends FROM gathered
)
SELECT c.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, CAST(COALESCE(e.c, 0) AS BIGINT) AS cost, COALESCE(e.a, '') AS audit, sha256(COALESCE(e.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT *, list_min([ends[1], ends[4]]) AS e FROM folded) f ON f.conv_id IS NOT DISTINCT FROM c.conv_id"""
