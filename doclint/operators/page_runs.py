"""Positioned page runs to lines, layout flags and text.

Input is ``runs(doc_id, page_no, page_width, run_no, str, x, y, width, height)``.  One shuffle gathers
the runs of a page into one sorted array; everything else happens inside that row.  A first fold moves
down the page with the row's anchor (its first run) and numbers the rows, a second one goes along
the rows and puts segments together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import is_date_like
from ..functions.folds import fold_in_blocks
from ..functions.text import let, trim_all

ROWS = "array<struct<row_no:int,segments:array<string>,start:double,stop:double>>"


def all_pages(runs: DataFrame) -> DataFrame:
    """Every page and run, with the default width where a page has none."""
    width = F.when(F.coalesce("page_width", F.lit(0.0)) == 0, fv.DEFAULT_PAGE_WIDTH).otherwise(F.abs("page_width"))
    return runs.withColumn("page_width", width)


def _typed_runs(runs: DataFrame) -> DataFrame:
    """``(doc_id, page_no, page_width, run)``; ``run`` is NULL without any ink, its numbers are doubles."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    run = F.struct((-number("y")).alias("down"), number("x"), F.col("run_no").cast("int").alias("run_no"), "str", number("width"), number("height"))
    return all_pages(runs).select(
        "doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("page_width").cast("double").alias("page_width"),
        F.when(trim_all(F.col("str")) != "", run).alias("run"),
    )


def number_rows(runs: Column) -> Column:
    """Row numbers of runs sorted down the page and to the right.

    A run belongs to the row while it is close enough to that row's first run; half of the taller of the two counts, two
    units at least, and runs without a height count as ten high.
    """
    tall = lambda h: F.when(h == 0, 10.0).otherwise(h)

    def step(state: Column, run: Column) -> Column:
        reach = F.greatest(F.lit(2.0), F.greatest(tall(run["height"]), tall(state["height"])) * 0.5)
        stays = (state["row_no"] >= 0) & (F.abs(state["down"] - run["down"]) <= reach)
        return let(stays, lambda same: F.struct(
            F.when(same, state).otherwise(F.struct((state["row_no"] + 1).alias("row_no"), run["down"].alias("down"), run["height"].alias("height"))).alias("state"),
            F.array(F.when(same, state["row_no"]).otherwise(state["row_no"] + 1)).alias("out"),
        ))

    begin = F.struct(F.lit(-1).alias("row_no"), F.lit(0.0).alias("down"), F.lit(0.0).alias("height"))
    return fold_in_blocks(runs, begin, "array<int>", step)["out"]


def _row_parts(runs: Column, page_width: Column) -> Column:
    """One entry per row, ``struct<row_no, segments, start, stop>``, from runs sorted by row and x.

    The same text less than two units right of the run kept before it is that run drawn twice.  A gap over 6 % of the
    page ends a segment, one over a fifth of a character is a space.
    """
    nothing = F.array().cast("array<string>")

    def finished(state: Column) -> Column:
        return F.struct(state["row_no"].alias("row_no"), F.concat(state["segments"], F.array(state["text"])).alias("segments"), state["start"].alias("start"), state["stop"].alias("stop"))

    def moved(state: Column, run: Column, segments: Column, text: Column) -> Column:
        return F.struct(
            run["row_no"].alias("row_no"), segments.alias("segments"), text.alias("text"), run["str"].alias("str"), run["x"].alias("x"), run["width"].alias("width"),
            state["start"].alias("start"), F.greatest(state["stop"], run["x"] + run["width"]).alias("stop"),
        )

    def along(state: Column, run: Column) -> Column:
        gap = run["x"] - (state["x"] + state["width"])
        character = state["width"] / F.greatest(F.length(state["str"]), F.lit(1))
        spaced = (gap > character * 0.2) & ~state["text"].endswith(" ") & ~run["str"].startswith(" ")
        return (
            F.when((run["str"] == state["str"]) & (F.abs(run["x"] - state["x"]) < 2), state.withField("stop", F.greatest(state["stop"], run["x"] + run["width"])))
            .when(gap > page_width * 0.06, moved(state, run, F.concat(state["segments"], F.array(state["text"])), run["str"]))
            .otherwise(moved(state, run, state["segments"], F.concat(state["text"], F.when(spaced, " ").otherwise(""), run["str"])))
        )

    def fresh(run: Column) -> Column:
        return F.struct(
            run["row_no"].alias("row_no"), nothing.alias("segments"), run["str"].alias("text"), run["str"].alias("str"), run["x"].alias("x"), run["width"].alias("width"),
            run["x"].alias("start"), (run["x"] + run["width"]).alias("stop"),
        )

    def step(state: Column, run: Column) -> Column:
        same = state["row_no"] == run["row_no"]
        ended = F.when(same | (state["row_no"] < 0), F.array().cast(ROWS)).otherwise(F.array(finished(state)))
        return F.struct(F.when(same, along(state, run)).otherwise(fresh(run)).alias("state"), ended.alias("out"))

    none = F.struct(F.lit(-1).alias("row_no"), F.lit("").alias("str"), F.lit(0.0).alias("x"), F.lit(0.0).alias("width"))
    return let(fold_in_blocks(runs, fresh(none), ROWS, step), lambda r: F.concat(r["out"], F.array(finished(r["state"]))))


def _line(row: Column, page_width: Column) -> Column:
    """A row's line and flags."""
    clean = F.filter(F.transform(row["segments"], trim_all), lambda t: t != "")

    def flags(segs: Column) -> Column:
        first, last = F.get(segs, F.lit(0)), F.get(segs, F.size(segs) - 1)
        split_line = (F.size(segs) >= 2) & (_word_count(first) >= 3) & (_word_count(last) >= 3) & ~is_date_like(last)
        middle = F.abs((row["start"] + row["stop"]) / 2 - page_width / 2)
        right = (row["start"] > page_width * 0.4) & ~(middle < page_width * 0.08)
        return F.struct(
            row["row_no"].alias("row_no"), F.array_join(segs, "\t").alias("line"),
            F.coalesce(split_line, F.lit(False)).alias("split_line"), right.alias("right_start"),
        )

    return let(clean, flags)


def page_table(runs: DataFrame) -> DataFrame:
    """``(doc_id, page_no, lines)``, one row per page; one shuffle, of the runs by page."""
    pages = _typed_runs(runs).groupBy("doc_id", "page_no").agg(F.max("page_width").alias("page_width"), F.array_sort(F.collect_list("run")).alias("runs"))
    numbered = F.zip_with("runs", number_rows(F.col("runs")), lambda r, n: F.struct(n.alias("row_no"), r["x"].alias("x"), r["down"].alias("down"), r["run_no"].alias("run_no"), r["str"].alias("str"), r["width"].alias("width")))
    rows = F.when(F.size("runs") > 0, _row_parts(F.array_sort(numbered), F.col("page_width"))).otherwise(F.array().cast(ROWS))
    return pages.select("doc_id", "page_no", "page_width", rows.alias("rows")).select(
        "doc_id", "page_no", F.transform("rows", lambda r: _line(r, F.col("page_width"))).alias("lines")
    )


def page_lines(runs: DataFrame) -> DataFrame:
    """``(doc_id, page_no, row_no, line, split_line, right_start)``."""
    return page_table(runs).select("doc_id", "page_no", F.inline("lines"))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def multi_column(lines: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, split_lines, right_lines, columns)``."""
    agg = lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("split_line").alias("split_lines"), F.count_if("right_start").alias("right_lines")
    )
    return agg.withColumn("columns", _columns())


def _columns() -> Column:
    many = lambda n: (F.col(n) >= 5) & (F.col(n) / F.col("n_lines") >= 0.25)
    return (F.col("n_lines") >= 8) & (many("split_lines") | many("right_lines"))


def run_documents(runs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per document in the document schema.

    ``pages(doc_id, page_count)`` gives true page counts; by default the highest page number seen.
    """
    many = lambda flag: F.size(F.filter("lines", lambda l: l[flag]))
    page = F.when(F.size("lines") > 0, F.struct("page_no", F.array_join(F.transform("lines", lambda l: l["line"]), "\n").alias("text")))
    read = page_table(runs).select(
        "doc_id", "page_no", page.alias("page"), F.size("lines").alias("n_lines"), many("split_line").alias("split_lines"), many("right_start").alias("right_lines")
    )
    full = read.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p["text"]), "\n\n").alias("text"),
        F.max("page_no").alias("page_count"), *(F.sum(c).alias(c) for c in ("n_lines", "split_lines", "right_lines")),
    ).withColumn("columns", _columns())
    if pages is not None:
        full = pages.join(full.drop("page_count"), "doc_id", "left")
    return full.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("header_footer_text"),
        F.struct(
            F.lit(0).alias("tables"), F.lit(0).alias("text_boxes"), F.lit(0).alias("images"),
            F.coalesce("columns", F.lit(False)).alias("columns"), F.col("page_count").cast("int").alias("page_count"),
        ).alias("layout"),
        (F.col("page_count") > fv.LONG_PAGES).alias("truncated"), F.lit(None).cast("string").alias("error_code"),
    )
