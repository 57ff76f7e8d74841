"""Greedy rules that take the best first, settled together: rounds, groups small enough for one task, chains by doubling pointers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

ROUNDS = 2  # before what is left is counted
SMALL = 200_000  # rows of a group that one task settles


def settle_small(left: DataFrame, keys: list[str], rule: Callable[[pa.Table], pa.Table], schema: str, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """What ``rule`` makes of each group of at most ``small`` rows, as a table, and the rows of larger groups (None if there are none)."""
    sizes = cut(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")), "sizes")
    large = sizes.filter(F.col("__size") > small)
    if large.isEmpty():
        return cut(left.groupBy(*keys).applyInArrow(rule, schema), "settled"), None
    some = left.join(sizes.filter(F.col("__size") <= small).select(keys), keys, "left_semi")
    return cut(some.groupBy(*keys).applyInArrow(rule, schema), "settled"), cut(left.join(large.select(keys), keys, "left_semi"), "large")


def taken_along_chains(nodes: DataFrame, keys: list[str], node: str, only: str, roots: Column) -> DataFrame:
    """Of nodes (keys, node, only: the one better node that stands against it, or null) those that a chain joins to one of
    ``roots``, which are taken: keys, node, taken. Along a chain every other node is taken.

    Pointers are doubled twice a table, so a chain of a million takes ten."""
    start = nodes.filter(F.col(only).isNotNull()).select(*keys, node, F.col(only).alias("__to"), F.lit(True).alias("__odd"))
    state = cut(start, "chains")
    step = lambda a, b: a.join(b.select(*keys, F.col(node).alias("__to"), F.col("__to").alias("__to2"), F.col("__odd").alias("__odd2")), [*keys, "__to"], "left").select(*keys, node, F.coalesce("__to2", "__to").alias("__to"), (F.col("__odd") != F.coalesce("__odd2", F.lit(False))).alias("__odd"), F.col("__to2").isNotNull().alias("__moved"))
    while True:
        once = step(state, state)
        twice = cut(step(once.drop("__moved"), once.drop("__moved")), "chains")
        state = twice.drop("__moved")
        if twice.filter("__moved").isEmpty():
            break
    ends = nodes.filter(roots).select(*keys, F.col(node).alias("__to"))
    return state.join(ends, [*keys, "__to"]).select(*keys, node, (~F.col("__odd")).alias("taken"))

