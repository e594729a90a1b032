"""Vector expressions over array columns, folded in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector over its norm, in double; null for a zero vector.

    The norm is the element of an array of one, so that it is made once a vector: named in the lambda below it would be made
    again for every element.
    """
    scaled = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))
    return F.transform(F.array(norm(a)), scaled)[0]


def minus(a: Column, b: Column) -> Column:
    """Element-wise difference."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def is_sound(a: Column, size: int | None = None) -> Column:
    """Whether a vector has the wanted size, is finite throughout and is not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = F.lit(True) if size is None else F.size(a) == size
    return a.isNotNull() & sized & finite & (norm(a) > 0)
