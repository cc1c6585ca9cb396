"""Folds over arrays that put out items as they go, in time linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An item added to an array copies the array, so items gather in short arrays first.
BLOCK = 256


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where use may name the value several times: it is bound by a lambda, so that it is made once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(items: Column, kind: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[Column, dict[str, Column]]]) -> Column:
    """A struct of `out` (all items put out, of the SQL type kind) and the last state.

    step takes the state and an item and gives an array of what it puts out, and the next state.
    """

    def inner(acc: Column, item: Column) -> Column:
        emitted, after = step(acc, item)
        return F.struct(F.when(F.size(emitted) > 0, F.concat(acc["out"], emitted)).otherwise(acc["out"]).alias("out"), *[after[k].alias(k) for k in state])

    def outer(acc: Column, block: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), *[acc[k].alias(k) for k in state])
        return F.aggregate(block, start, inner, lambda own: F.struct(F.concat(acc["outs"], F.array(own["out"])).alias("outs"), *[own[k].alias(k) for k in state]))

    def whole(bound: Column) -> Column:
        last = F.floor((F.size(bound) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.when(F.size(bound) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(bound, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("outs"), *[v.alias(k) for k, v in state.items()])
        return F.aggregate(blocks, start, outer, lambda acc: F.struct(F.flatten(acc["outs"]).alias("out"), *[acc[k].alias(k) for k in state]))

    return computed_once(items, whole)
