"""Sequential folds over a sorted array, for recurrences that windows can't express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _in_blocks(log: Column, start: Column, kind: str, one: Callable[[Column, Column], Column]) -> Column:
    """The outputs of a fold with one(state and outputs, element).

    Spark copies an array whenever it grows, so outputs are gathered in blocks of the root of
    log's size.
    """

    def block(acc: Column, part: Column) -> Column:
        first = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return let(F.aggregate(part, first, one), lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    n = F.greatest(F.ceil(F.sqrt(F.size(log))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(log, k * n + 1, n))
    return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda acc: acc["out"]))


def outputs(log: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<kind>: the output at each element of log of a fold from the state start.

    step(state, element) gives the next state and the output.
    """

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    return _in_blocks(log, start, kind, one)


def states(log: Column, start: Column, kind: str, step: Callable[[Column, Column], Column], out: Callable[[Column], Column]) -> Column:
    """array<kind>: out(state) after each element of log; step(state, element) is computed once."""

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda s: F.struct(s.alias("state"), F.concat(acc["out"], F.array(out(s))).alias("out")))

    return _in_blocks(log, start, kind, one)
