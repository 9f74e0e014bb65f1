"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def share(found: Column, total: Column, empty: float) -> Column:
    """size(found) / size(total), ``empty`` for an empty total."""
    return F.when(F.size(total) > 0, F.size(found) / F.size(total)).otherwise(F.lit(empty))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision, 0 if either has no length."""
    def double(x):
        return F.transform(x, lambda v: v.cast("double"))

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def body(p):
        dot = total(F.zip_with(p["a"], p["b"], lambda x, y: x * y))
        norm = F.sqrt(total(F.transform(p["a"], lambda x: x * x))) * F.sqrt(total(F.transform(p["b"], lambda x: x * x)))
        return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)

    return bind(F.struct(double(a).alias("a"), double(b).alias("b")), body)


def totals_before(a: Column, block: int = 256) -> Column:
    """For each of an array's whole numbers the sum of those before it; blocks are summed first, so a long array is not copied at every step."""
    def fold(x: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))

    def both(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda i: fold(F.slice(x, i * block + 1, F.lit(block))))
        return bind(parts, lambda p: bind(fold(F.transform(p, lambda y: y["sum"]))["out"], lambda ahead: F.flatten(F.transform(p, lambda y, i: F.transform(y["out"], lambda v: v + F.get(ahead, i))))))

    return F.when(F.size(a) > 0, bind(a, both)).otherwise(F.array().cast("array<bigint>"))
