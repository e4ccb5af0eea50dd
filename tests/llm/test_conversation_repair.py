"""Conversation repair against a plain shortest path over whole conversations."""

import random
import re
import zlib

import brute
import pytest

from doclint.llm import conversation_repair as cr

SOUND = {"": "su", "s": "u", "u": "a", "a": "u"}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows, start="", ends=None):
    """Cost and initials of the cheapest edit list, least initials first; relaxes (row, last initial) until nothing falls.

    ``rows``: (initial, truncated, must go); ``ends``: last initials to arrive at without inserts after the last row.
    """
    best = {start: (0, "")}
    add = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        changed = True
        while changed:
            changed = False
            for last, (cost, audit) in list(best.items()):
                new = (cost + 2, audit + "I")
                if add[last] not in best or new < best[add[last]]:
                    best[add[last]], changed = new, True
        return best

    for initial, truncated, dead in rows:
        after = {}
        for last, (cost, audit) in inserted(best).items():
            options = [(last, 3, "D")]
            if not dead:
                options.append((add[last], 2 + truncated, "R"))
                if initial and initial in SOUND[last]:
                    options.append((initial, int(truncated), "K"))
            for state, more, letter in options:
                new = (cost + more, audit + letter)
                if state not in after or new < after[state]:
                    after[state] = new
        best = after
    if ends is not None:
        return best.get(ends)
    best = inserted(best)
    return min(best[x] for x in ("", "a") if x in best)


def plain(rows):
    """The contract, on all rows of a table: one result per conversation."""
    one = lambda x: " " if x is None else str(x)
    kept: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        kept[conv] += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), brute_md5(r[2])))
        seen, found, faults = set(), [], []
        for _, role, text in own:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            found.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = cheapest(found)
        state, at, said = "", 0, []
        for letter in audit:
            if letter in "IR":
                state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                said.append(f"{'user' if state == 'u' else 'assistant'}:{own[at][2] if letter == 'R' else ''}")
            elif letter == "K":
                state = own[at][1][0]
                said.append(f"{own[at][1]}:{own[at][2]}")
            at += letter != "I"
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, brute.sha("\n".join(said))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def brute_md5(text):
    import hashlib

    return hashlib.md5(text.encode()).digest()


def random_rows(rng, n):
    return [(rng.choice((0, 1, 2, 2, 3, 3)), int(rng.random() < 0.3), 0) if rng.random() < 0.8 else (0, 0, rng.randint(1, 2)) for _ in range(n)]


def spelled(rows):
    return [x for kind, truncated, dead in rows for x in [("?sua"[kind] if kind else "x", bool(truncated), bool(dead))] * (dead or 1)]


@pytest.mark.parametrize("seed", range(150))
def test_search_finds_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(0, 14))
    assert cr.Search(rows, cr.ACCEPT).cheapest(0) == cheapest(spelled(rows))
    for goal, name in enumerate(("", "s", "u", "a")):
        for entry, start in enumerate(("", "s", "u", "a")):
            want = cheapest(spelled(rows), start, name)
            got = cr.Search(rows, goal).cheapest(entry)
            assert got == (want or (cr.NEVER, "")), (rows, start, name)


def test_long_lists_stay_quick():
    rng = random.Random(3)
    rows = random_rows(rng, cr.SEGMENT)
    assert cr.Search(rows, cr.ACCEPT).cheapest(0) == cheapest(spelled(rows))


def conversations():
    rng = random.Random(5)
    say = lambda: rng.choice(("Yes.", "No", "", " \n", "What is it?", "It is so! ", None, "a b", "Well..."))
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(("user", "assistant", "system", "assistant", "user", "tool", None, "")), say()))
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}{'.' if t % 7 else ''}") for t in range(300)]
    rows += [(101, t // 3, ("user", "assistant", "user")[t % 3], f"{t % 5}.") for t in range(90)]
    rows += [(102, None, "user", "Hello.")] * 40 + [(102, t, "assistant", "Hello.") for t in range(30)]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (103, None, None, None)]
    return rows


@pytest.mark.parametrize("size", [cr.SEGMENT, 7])
def test_repair_equals_the_plain_version(spark, size):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string, digest string").repartition(3)
    found = cr.repair(cr.damaged(frame), frame.select("conv_id"), size)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r[0] or 0)) == plain(rows)


def test_query_equals_the_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, cr.query(spark, folder).collect())) == plain(rows)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cr.repair(cr.damaged(frame), frame.select("conv_id")).collect() == []
