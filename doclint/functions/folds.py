"""Folds over the items of one row that emit values on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import let

BLOCK = 256


def fold_in_blocks(items: Column, state: Column, out_type: str, step: Callable[[Column, Column], Column]) -> Column:
    """``struct<state, out>`` after all items; ``step(state, item)`` gives ``struct<state, out>``: the next
    state and an array of values to append.

    A fold copies its accumulator at every item, so values are gathered block by block: within a block only that block's
    values are copied, and the whole output once per block.  ``out_type`` is the array type of the output.
    """
    nothing = F.array().cast(out_type)

    def block_fold(block: Column, begin: Column) -> Column:
        def merge(acc: Column, item: Column) -> Column:
            joined = lambda made: F.when(F.size(made) > 0, F.concat(acc["out"], made)).otherwise(acc["out"])
            return let(step(acc["state"], item), lambda s: F.struct(s["state"].alias("state"), joined(s["out"]).alias("out")))

        return F.aggregate(block, F.struct(begin.alias("state"), nothing.alias("out")), merge)

    def over(all_items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_items) - 1, F.lit(0)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(all_items, i + 1, F.lit(BLOCK)))
        return F.aggregate(
            blocks, F.struct(state.alias("state"), nothing.alias("out")),
            lambda acc, block: let(block_fold(block, acc["state"]), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out"))),
        )

    return let(items, over)
