"""n-dimensional arrays as DataFrames: a row for each element, with its indices ``i0``, ``i1``, ... and value ``v``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import block_of, compare, floor_div, floor_mod, slice_index, true_div

from .positions import with_position

_BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": true_div,
    "//": floor_div,
    "%": floor_mod,
    "**": lambda a, b: F.pow(a, b),
}

#: Of booleans as logic, of integers bit by bit.
_LOGIC = {
    "&": (lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)),
    "|": (lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)),
    "^": (lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)),
}
#: Indices of a list up to which it is a literal in the plan; a longer one is joined.
LITERAL_INDICES = 1000


@dataclass(frozen=True)
class GridArray:
    """An immutable array. ``source`` holds the rows and ``v`` the value as an expression over them.

    Arrays with one ``source`` combine in one projection; others meet in an equi-join on their indices.
    """

    source: DataFrame
    shape: tuple[int, ...]
    v: Column
    version: int = 0

    @staticmethod
    def of(frame: DataFrame, shape: Sequence[int], value: str = "v", index: Sequence[str] = ()) -> GridArray:
        names = index or [f"i{k}" for k in range(len(shape))]
        source = frame.select(*[F.col(n).cast("long").alias(f"i{k}") for k, n in enumerate(names)], F.col(value).alias("v"))
        return GridArray(source, tuple(shape), F.col("v"))

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    def frame(self) -> DataFrame:
        return self.source.select(*self.axes, self.v.alias("v"))

    def __getitem__(self, key) -> GridArray:
        """Integers drop an axis, slices keep it, lists gather; the filters reach the scan. Views of views fuse."""
        keys = key if isinstance(key, tuple) else (key,)
        if len(keys) > len(self.shape):
            raise IndexError(f"{len(keys)} indices for {len(self.shape)} axes")
        frame, shape, kept = self.frame(), [], []
        for k, size in enumerate(self.shape):
            at, i = keys[k] if k < len(keys) else slice(None), F.col(f"i{k}")
            if isinstance(at, slice):
                start, stop, step = at.indices(size)
                inside, index = slice_index(i, start, stop, step)
                frame = frame.filter(inside)
                kept.append(index)
                shape.append(len(range(start, stop, step)))
            elif isinstance(at, (list, tuple)):
                if any(not -size <= x < size for x in at):
                    raise IndexError(f"index of axis {k} with size {size}")
                if len(at) > LITERAL_INDICES:
                    rows = frame.sparkSession.createDataFrame([(p, x % size) for p, x in enumerate(at)], f"g{k} long, x{k} long")
                    frame = frame.join(rows, i == F.col(f"x{k}")).drop(f"x{k}")
                    kept.append(F.col(f"g{k}"))
                    shape.append(len(at))
                    continue
                places: dict[int, list[int]] = {}
                for place, x in enumerate(at):
                    places.setdefault(x % size, []).append(place)
                lookup = F.create_map(*[F.lit(y) for x, p in places.items() for y in (x, p)])
                frame = frame.filter(i.isin(list(places))).withColumn(f"g{k}", F.explode(F.get(F.array(lookup), F.lit(0))[i.cast("int")]))
                kept.append(F.col(f"g{k}").cast("long"))
                shape.append(len(at))
            else:
                if not -size <= at < size:
                    raise IndexError(f"index {at} of axis {k} with size {size}")
                frame = frame.filter(i == at % size)
        columns = [c.alias(f"i{n}") for n, c in enumerate(kept)]
        return GridArray(frame.select(*columns, "v"), tuple(shape), F.col("v"), self.version)

    def _with(self, other: GridArray | float | int, op) -> GridArray:
        if not isinstance(other, GridArray):
            return replace(self, v=op(self.v, F.lit(other)))
        if other.source is self.source:
            return replace(self, v=op(self.v, other.v))
        if len(other.shape) < len(self.shape):  # broadcast along the leading axes
            skip = len(self.shape) - len(other.shape)
            on = [f"i{k}" for k in range(skip, len(self.shape))]
            right = other.frame().select(*[F.col(f"i{k}").alias(f"i{k + skip}") for k in range(len(other.shape))], F.col("v").alias("w"))
        elif other.shape != self.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape}")
        else:
            on, right = self.axes, other.frame().withColumnRenamed("v", "w")
        both = self.frame().join(right, on).select(*self.axes, op(F.col("v"), F.col("w")).alias("v"))
        return GridArray(both, self.shape, F.col("v"))

    def take(self, index: GridArray, axis: int = 0) -> GridArray:
        """The elements at the places that a one-dimensional array of integers names along an axis, by a join.

        Negative places count from the end; those outside the axis name nothing.
        """
        at, size = f"i{axis}", self.shape[axis]
        rows = index.frame().select(F.col("i0").alias("_to"), F.when(F.col("v") < 0, F.col("v") + size).otherwise(F.col("v")).alias("_at"))
        found = self.frame().join(rows, F.col(at) == F.col("_at"))
        columns = [F.col("_to").alias(at) if a == at else F.col(a) for a in self.axes]
        shape = tuple(index.shape[0] if k == axis else n for k, n in enumerate(self.shape))
        return GridArray(found.select(*columns, "v"), shape, F.col("v"), self.version)

    def _kind(self) -> str:
        return self.source.select(self.v.alias("v")).schema["v"].dataType.typeName()

    def apply(self, op: str, other: GridArray | float | int | bool) -> GridArray:
        if op in _LOGIC:
            logic, bits = _LOGIC[op]
            return self._with(other, logic if self._kind() == "boolean" else bits)
        return self._with(other, _BINARY[op])

    def changed(self, op: str, other: GridArray | float | int | bool) -> GridArray:
        """``apply`` as an assignment to the array itself: the next version of it."""
        return replace(self.apply(op, other), version=self.version + 1)

    def update(self, value: GridArray) -> GridArray:
        """The next version, with all elements and the shape of another array."""
        return replace(value, version=self.version + 1)

    def __len__(self) -> int:
        return self.shape[0]

    def __iter__(self):
        """The sub-arrays along the first axis, each a lazy view."""
        return (self[k] for k in range(self.shape[0]))

    def __add__(self, other):
        return self.apply("+", other)

    def __sub__(self, other):
        return self.apply("-", other)

    def __mul__(self, other):
        return self.apply("*", other)

    def __truediv__(self, other):
        return self.apply("/", other)

    def __floordiv__(self, other):
        return self.apply("//", other)

    def __mod__(self, other):
        return self.apply("%", other)

    def __pow__(self, other):
        return self.apply("**", other)

    def __and__(self, other):
        return self.apply("&", other)

    def __or__(self, other):
        return self.apply("|", other)

    def __xor__(self, other):
        return self.apply("^", other)

    __radd__, __rmul__, __rand__, __ror__, __rxor__ = __add__, __mul__, __and__, __or__, __xor__

    def __rsub__(self, other):
        return self._with(other, lambda a, b: b - a)

    def __rtruediv__(self, other):
        return self._with(other, lambda a, b: true_div(b, a))

    def __rfloordiv__(self, other):
        return self._with(other, lambda a, b: floor_div(b, a))

    def __rmod__(self, other):
        return self._with(other, lambda a, b: floor_mod(b, a))

    def __rpow__(self, other):
        return self._with(other, lambda a, b: F.pow(b, a))

    def __neg__(self) -> GridArray:
        return self.map(lambda v: -v)

    def __abs__(self) -> GridArray:
        return self.map(F.abs)

    def __invert__(self) -> GridArray:
        return self.map((lambda v: ~v) if self._kind() == "boolean" else F.bitwise_not)

    def min(self, axis: int | None = None) -> DataFrame:
        """NaN where one of the elements is NaN, as in numerical libraries; Spark's own order has it last."""
        return self.reduce(lambda v: F.when(F.bool_or(self._nan(v)), F.lit(float("nan"))).otherwise(F.min(v)) if self._floats() else F.min(v), axis)

    def max(self, axis: int | None = None) -> DataFrame:
        return self.reduce(F.max, axis)

    def mean(self, axis: int | None = None) -> DataFrame:
        return self.reduce(lambda v: F.avg(v.cast("double")), axis)

    def sum(self, axis: int | None = None) -> DataFrame:
        return self.reduce(F.sum, axis)

    def argsort(self) -> GridArray:
        """Of a one-dimensional array: the places of its elements in rising order, NaN last, equal ones in place order."""
        placed = with_position(self.frame(), "v", "i0", name="p")
        return GridArray(placed.select(F.col("p").alias("i0"), F.col("i0").alias("v")), self.shape, F.col("v"))

    def sort(self) -> GridArray:
        placed = with_position(self.frame(), "v", "i0", name="p")
        return GridArray(placed.select(F.col("p").alias("i0"), "v"), self.shape, F.col("v"), self.version + 1)

    def _floats(self) -> bool:
        return self._kind() in ("double", "float")

    def _nan(self, v: Column) -> Column:
        return F.isnan(v) if self._floats() else F.lit(False)

    def compare(self, op: str, other: GridArray | float | int) -> GridArray:
        return self._with(other, lambda a, b: compare(a.cast("double"), op, b.cast("double")))

    def map(self, f) -> GridArray:
        return replace(self, v=f(self.v))

    def assign(self, key, value: GridArray | float | int) -> GridArray:
        """A new version in which the slice has other values."""
        keys = key if isinstance(key, tuple) else (key,)
        tests, back = [], []
        for k, size in enumerate(self.shape):
            at = keys[k] if k < len(keys) else slice(None)
            start, stop, step = (slice(at, at + 1) if isinstance(at, int) else at).indices(size)
            inside, index = slice_index(F.col(f"i{k}"), start, stop, step)
            tests.append(inside)
            back += [] if isinstance(at, int) else [index]
        inside = reduce(and_, tests)
        if not isinstance(value, GridArray):
            return replace(self, v=F.when(inside, F.lit(value)).otherwise(self.v), version=self.version + 1)
        patch = value.frame().select(*[F.col(f"i{k}").alias(f"p{k}") for k in range(len(value.shape))], F.col("v").alias("w"), F.lit(True).alias("_hit"))
        on = [index == F.col(f"p{k}") for k, index in enumerate(back)]
        joined = self.frame().join(patch, reduce(and_, on, inside), "left")
        v = F.when(F.col("_hit"), F.col("w")).otherwise(F.col("v")).alias("v")
        return GridArray(joined.select(*self.axes, v), self.shape, F.col("v"), self.version + 1)

    def compress(self, mask: Column) -> DataFrame:
        """The elements of a one-dimensional array that satisfy ``mask``, numbered anew as ``pos``."""
        return with_position(self.frame().filter(mask), "i0")

    def reduce(self, how, axis: int | None = None) -> DataFrame:
        """``how(value)`` over all elements, or over one axis for each index of the others."""
        keep = [a for k, a in enumerate(self.axes) if axis is not None and k != axis]
        return self.frame().groupBy(*keep).agg(how(F.col("v")).alias("v"))

    def argmin(self, axis: int) -> DataFrame:
        """The first index of the least value along an axis, or of the first NaN if there is one."""
        keep = [a for k, a in enumerate(self.axes) if k != axis]
        least = F.min(F.struct((~self._nan(F.col("v"))).alias("n"), "v", f"i{axis}"))
        return self.frame().groupBy(*keep).agg(least[f"i{axis}"].alias("arg"), least["v"].alias("v"))

    def transpose(self) -> GridArray:
        swapped = self.frame().select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")
        return GridArray(swapped, self.shape[::-1], F.col("v"))

    def tril(self) -> GridArray:
        return replace(self, v=F.when(F.col("i0") >= F.col("i1"), self.v).otherwise(F.lit(0)))

    def reshape(self, rows: int, columns: int) -> GridArray:
        flat = F.col("i0") * self.shape[1] + F.col("i1")
        moved = self.frame().select(floor_div(flat, columns).alias("i0"), (flat % columns).alias("i1"), "v")
        return GridArray(moved, (rows, columns), F.col("v"))

    def matmul(self, other: GridArray) -> GridArray:
        """Joins on the inner index and sums; partial sums are formed before they are shuffled."""
        right = other.frame().select(F.col("i0").alias("k"), F.col("i1").alias("j"), F.col("v").alias("w"))
        joined = self.frame().join(right, F.col("i1") == F.col("k"))
        product = joined.groupBy("i0", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return GridArray(product.withColumnRenamed("j", "i1"), (self.shape[0], other.shape[1]), F.col("v"))

    def tiles(self, size: int) -> DataFrame:
        """``bi``, ``bj``, ``nr``, ``nc`` and the row-major ``data`` of square tiles; a tile is bounded by its size."""
        cell = F.struct((F.col("i0") % size).alias("r"), (F.col("i1") % size).alias("c"), F.col("v").cast("double").alias("v"))
        grouped = self.frame().groupBy(block_of(F.col("i0"), size).alias("bi"), block_of(F.col("i1"), size).alias("bj"))
        packed = grouped.agg(F.array_sort(F.collect_list(cell)).alias("t"))
        return packed.select(
            "bi", "bj", (F.array_max("t.r") + 1).cast("int").alias("nr"), (F.array_max("t.c") + 1).cast("int").alias("nc"), F.col("t.v").alias("data")
        )
