"""Page runs against a plain reading of each page, and the shape of the plan."""

import random

from doclint.operators import page_runs as pr


def plain_lines(runs, width):
    """Row number, line and right start of each row of a page."""
    runs = sorted((r for r in runs if r["str"].strip()), key=lambda r: (-r["y"], r["x"], r["run_no"]))
    rows = []
    for r in runs:
        if rows and abs(rows[-1][0]["y"] - r["y"]) <= max(2, 0.5 * max(r["height"] or 10, rows[-1][0]["height"] or 10)):
            rows[-1].append(r)
        else:
            rows.append([r])
    out = []
    for n, row in enumerate(rows):
        row.sort(key=lambda r: r["x"])
        segments, text, kept = [], "", None
        for r in row:
            if kept and r["str"] == kept["str"] and abs(r["x"] - kept["x"]) < 2:
                continue
            if kept:
                gap = r["x"] - (kept["x"] + kept["width"])
                if gap > width * 0.06:
                    segments.append(text)
                    text = ""
                elif gap > kept["width"] / max(1, len(kept["str"])) * 0.2 and not text.endswith(" ") and not r["str"].startswith(" "):
                    text += " "
            text, kept = text + r["str"], r
        segments.append(text)
        start, stop = row[0]["x"], max(r["x"] + r["width"] for r in row)
        right = start > width * 0.4 and not abs((start + stop) / 2 - width / 2) < width * 0.08
        out.append((n, "\t".join(s.strip() for s in segments if s.strip()), right))
    return out


def page(rng, doc, no, n):
    return [{
        "doc_id": doc, "page_no": no, "page_width": 600.0, "run_no": i, "str": rng.choice(("ab", "ab", " c", "d ", " ", "e f", "g\th", "12")), "x": rng.randrange(0, 1200) / 2,
        "y": 700 - rng.randrange(0, 160) / 4, "width": rng.choice((0.0, 4.0, 12.5, 40.0)), "height": rng.choice((0.0, 4.0, 10.0, 18.0)),
    } for i in range(n)]


def test_lines_equal_a_plain_reading(spark):
    rng = random.Random(4)
    pages = {(d, p): page(rng, d, p, rng.randint(1, 40)) for d in range(30) for p in (1, 2)} | {(99, 1): page(rng, 99, 1, 700)}
    frame = spark.createDataFrame([r for p in pages.values() for r in p], "doc_id long, page_no int, page_width double, run_no int, str string, x double, y double, width double, height double")
    lines = pr.page_lines(frame.repartition(5))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan and "Window" not in plan
    got = {}
    for r in lines.collect():
        got.setdefault((r.doc_id, r.page_no), []).append((r.row_no, r.line, r.right_start))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_lines(p, 600.0) for k, p in pages.items() if plain_lines(p, 600.0)}


def test_a_row_is_measured_from_its_first_run(spark):
    drift = [(1, 1, 600.0, i, f"w{i}", 20.0 * i, 700.0 - 3.0 * i, 18.0, 10.0) for i in range(6)]
    lines = pr.page_lines(spark.createDataFrame(drift, "doc_id long, page_no int, page_width double, run_no int, str string, x double, y double, width double, height double"))
    assert sorted((r.row_no, r.line) for r in lines.collect()) == [(0, "w0 w1"), (1, "w2 w3"), (2, "w4 w5")]


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, page_no int, page_width double, run_no int, str string, x double, y double, width double, height double")
    assert pr.page_lines(empty).collect() == [] and pr.run_documents(empty).collect() == []
