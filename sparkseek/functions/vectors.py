"""Vectors: length, similarity, codes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SeekError


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: a lambda computes what it
    holds from outside for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Scaled to length 1 in double, kept in float; a zero vector stays zero."""
    # The length beside each element: it is computed once, and no lambda lies in another, below
    # which Spark does not find a Python function's argument again.
    lengths = F.array_repeat(magnitude(a), F.size(a))
    return F.zip_with(a, lengths, lambda x, m: F.when(m == 0, F.lit(0.0)).otherwise(x.cast("double") / m).cast("float"))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def unit(v: list[float], size: int | None = None) -> list[float] | None:
    """A query's vector scaled to length 1; None for a zero vector."""
    if not v or any(not isinstance(x, (int, float)) for x in v):
        raise SeekError("INVALID_VECTOR_INPUT", v)
    if size is not None and len(v) != size:
        raise SeekError("INVALID_VECTOR_SIZE", f"{len(v)}, not {size}")
    m = math.sqrt(sum(x * x for x in v))
    return [x / m for x in v] if m else None


def clamped(s: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def sign_words(v: Column, size: int) -> Column:
    """One bit a dimension (above 0), packed into longs."""

    def word(at: int) -> Column:
        # From the last dimension to the first, which is the lowest bit; v is read once.
        part = F.reverse(F.slice(v, 64 * at + 1, min(64, size - 64 * at)))
        return F.aggregate(part, F.lit(0).cast("long"), lambda bits, x: F.shiftleft(bits, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(0).cast("long")))

    return F.array(*[word(w) for w in range(-(-size // 64))])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def binary_score(distance: Column, size: int) -> Column:
    return F.cos(F.lit(math.pi) * distance / size)


def int8_code(v: Column) -> Column:
    """struct(code array<tinyint>, step, shift): an affine code of each vector's own range."""

    def coded(low: Column, high: Column) -> Column:
        step = F.when(high > low, (high - low) / 255).otherwise(F.lit(0.0))
        code = lambda step: F.transform(v, lambda x: (F.when(step > 0, F.round((x.cast("double") - low) / step)).otherwise(0) - 128).cast("tinyint"))
        return let(step, lambda step: F.struct(code(step).alias("code"), step.cast("float").alias("step"), (low + 128 * step).cast("float").alias("shift")))

    return let(F.array_min(v).cast("double"), lambda low: let(F.array_max(v).cast("double"), lambda high: coded(low, high)))


def int8_score(query: Column, code: Column, query_sum: Column) -> Column:
    """Dot product of an exact query with a coded vector."""
    return clamped(query_sum * code["shift"].cast("double") + code["step"].cast("double") * dot(query, code["code"]))
