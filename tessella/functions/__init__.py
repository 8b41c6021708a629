"""Column functions with the array semantics of numerical libraries where SQL differs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Quotient of integers rounded toward zero, exact in 64 bits; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.when(b != 0, F.call_function("div", a, b))


def _turned(r: Column, b: Column) -> Column:
    """Whether a remainder has the other sign than its divisor, so that rounding down goes one further."""
    return (r != 0) & ((r < 0) != (b < 0))


def floor_mod(a: Column, b: Column | int) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    r = F.try_mod(a, b)
    return F.when(_turned(r, b), r + b).otherwise(r)


def floor_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded down, for integers, exact in 64 bits; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    return (int_div(a, b) - _turned(F.try_mod(a, b), b).cast("int")).cast("long")


def true_div(a: Column, b: Column) -> Column:
    """Quotient as double: infinities and NaN for a zero divisor, as IEEE 754 has it."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def shift_left(a: Column, n: int) -> Column:
    """64-bit shift; all bits are gone from 64 on."""
    return F.lit(0).cast("long") if n >= 64 else F.shiftleft(a.cast("long"), n)


def shift_right(a: Column, n: int) -> Column:
    """Arithmetic 64-bit shift; the sign is left from 63 on."""
    return F.shiftright(a.cast("long"), min(n, 63))


def compare(a: Column, op: str, b: Column) -> Column:
    """Floating comparison in which NaN differs from everything, itself included."""
    nan = F.isnan(a) | F.isnan(b)
    found = {"<": a < b, "<=": a <= b, "==": a == b, "!=": a != b, ">": a > b, ">=": a >= b}[op]
    return (nan | found) if op == "!=" else (~nan & found)


def slice_index(i: Column, start: int, stop: int, step: int = 1) -> tuple[Column, Column]:
    """For a strided slice: which positions of ``i`` it holds, and where they go."""
    if step > 0:
        return (i >= start) & (i < stop) & ((i - start) % step == 0), int_div(i - start, step)
    return (i <= start) & (i > stop) & ((start - i) % -step == 0), int_div(start - i, -step)


def shard_of(i: Column, n: int | Column, shards: int) -> Column:
    """The shard of row i of n where shard g has rows [g*n/shards, (g+1)*n/shards), rounded down."""
    return int_div((i.cast("long") + 1) * shards - 1, n).cast("int")


def share_of(i: Column, n: int | Column, shards: int) -> Column:
    """The shard of row i of n where row i belongs to its share i*shards/n, rounded down."""
    return int_div(i.cast("long") * shards, n).cast("int")


def shard_of_cell(axes: list[Column], shape: tuple[int, ...], grid: tuple[int, ...], split: Callable[..., Column] = shard_of) -> Column:
    """The shard, numbered row by row, of a cell of an array that is split along each axis into ``grid`` parts."""
    found = F.lit(0)
    for i, n, g in zip(axes, shape, grid, strict=True):
        found = found * g + split(i, n, g)
    return found.cast("int")


def ravelled(axes: list[Column], shape: tuple[int, ...]) -> Column:
    """The row-major position of a cell."""
    found = F.lit(0).cast("long")
    for i, n in zip(axes, shape, strict=True):
        found = found * n + i
    return found


def unravelled(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    """The cell at a row-major position."""
    out = []
    for n in reversed(shape):
        out.append(floor_mod(flat, n).cast("long"))
        flat = floor_div(flat, n)
    return out[::-1]


def block_of(i: Column, size: int) -> Column:
    return floor_div(i, size)


def task_name(space: Column, index: Column) -> Column:
    """``space_i_j`` for an array of integers."""
    return F.concat_ws("_", space, F.transform(index, lambda x: x.cast("string")))


def task_parts(name: Column) -> tuple[Column, Column]:
    """Space and index of ``space_i_j``; the index is empty where no numbers follow, and the space the whole name."""
    numbers = F.regexp_extract(name, r"((?:_-?\d+)+)$", 1)
    space = F.substring(name, F.lit(1), F.length(name) - F.length(numbers))
    index = F.filter(F.split(numbers, "_"), lambda x: x != "")
    return space, F.transform(index, lambda x: x.cast("long"))


def strided_local(start: Column, stop: Column, step: Column, of_start: Column, of_stop: Column, of_step: Column) -> tuple[Column, Column, Column, Column]:
    """Of a slice with positive steps: whether the slice ``of`` holds all its places, and its start, stop and step there."""
    last = start + int_div(stop - 1 - start, step) * step
    inside = (start >= of_start) & (last < of_stop) & ((start - of_start) % of_step == 0) & ((step % of_step == 0) | (last == start))
    return inside, int_div(start - of_start, of_step), int_div(last - of_start, of_step) + 1, F.greatest(int_div(step, of_step), F.lit(1))
