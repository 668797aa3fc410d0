"""Column functions over hierarchy keys, paths and neighbour sets.

A key is an ``array<bigint>`` with one cluster id per level; ``-1`` marks a level that
is not assigned. All functions are built-in expressions and stay inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNASSIGNED = -1


def key_level(key: Column) -> Column:
    """How many levels the key really uses: 1 plus its adjacent unequal pairs."""
    n = F.size(key)
    changes = F.zip_with(
        F.slice(key, F.lit(1), n - 1), F.slice(key, F.lit(2), n - 1), lambda a, b: a != b
    )
    return F.lit(1) + F.size(F.filter(changes, lambda changed: changed))


def key_merge(parent: Column, own: Column) -> Column:
    """``own`` with its leading slots replaced by the levels ``parent`` really uses."""
    n = F.size(own)
    level = key_level(parent)
    merged = F.concat(F.slice(parent, F.lit(1), level), F.slice(own, level + 1, n - level))
    return F.when(level <= n, merged).otherwise(own)


def was_clustered(key: Column) -> Column:
    """True when a key holds at least two different values."""
    return F.size(F.array_distinct(key)) > 1


def state_update(a: Column, b: Column) -> Column:
    """Merge two ``struct<degree, flag, key>`` states; an unassigned one yields to the other."""
    merged = F.struct(
        a["degree"].alias("degree"),
        b["flag"].alias("flag"),
        key_merge(b["key"], a["key"]).alias("key"),
    )
    return (
        F.when(F.get(a["key"], F.lit(0)) == UNASSIGNED, b)
        .when(F.get(b["key"], F.lit(0)) == UNASSIGNED, a)
        .otherwise(merged)
    )


def slot_update(own: Column, other: Column) -> Column:
    """Slot by slot: keep what is assigned, else take the other's slot."""
    return F.zip_with(own, other, lambda x, y: F.when(x != UNASSIGNED, x).otherwise(y))


def slot_merge(a: Column, b: Column) -> Column:
    """Slot by slot: the assigned one; where both are, the smaller (a fixed choice)."""
    return F.zip_with(
        a,
        b,
        lambda x, y: F.when(x == UNASSIGNED, y).when(y == UNASSIGNED, x).otherwise(F.least(x, y)),
    )


def seed_slot(vertex_id: Column, levels: int, level_size: int) -> Column:
    """The level a vertex seeds: its id range of ``level_size`` ids, NULL beyond the last."""
    slot = F.floor(vertex_id / F.lit(level_size)).cast("int")
    return F.when(vertex_id < levels * level_size, F.greatest(slot, F.lit(0)))


def jaccard_two_sided(
    out_a: Column, in_a: Column, out_b: Column, in_b: Column, mode: str = "plain"
) -> Column:
    """Jaccard of the out-sets plus Jaccard of the in-sets, 0 to 2.

    A side on which both sets are empty counts 1. ``mode='subset'`` asks for the first
    vertex's sets to lie inside the second's, and gives -1 otherwise or when all four
    sets are empty.
    """

    def side(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, F.lit(1.0)).otherwise(
            F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), union.cast("double"))
        )

    total = side(out_a, out_b) + side(in_a, in_b)
    if mode == "plain":
        return total
    if mode != "subset":
        raise ValueError(f"unknown mode {mode!r}")
    inside = (F.size(F.array_except(out_a, out_b)) == 0) & (F.size(F.array_except(in_a, in_b)) == 0)
    empty = F.size(out_a) + F.size(in_a) + F.size(out_b) + F.size(in_b) == 0
    return F.when(inside & ~empty, total).otherwise(F.lit(-1.0))


def path_prepend(vertex_id: Column, path: Column) -> Column:
    return F.concat(F.array(vertex_id), path)


def shorter_path(a: Column, b: Column) -> Column:
    """The shorter of two paths, the second on a tie; NULL stands for no path."""
    return F.when(a.isNotNull() & (b.isNull() | (F.size(a) < F.size(b))), a).otherwise(b)


def larger_second(a: Column, b: Column) -> Column:
    """Of two ``struct<id, degree>`` the one of larger degree, the second on a tie."""
    return F.when(a["degree"] > b["degree"], a).otherwise(b)
