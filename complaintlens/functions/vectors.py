"""Vector expressions on ``array<float>`` or ``array<double>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two vectors of one width."""
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    """Euclidean length."""
    total = F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(total)


def l2_normalize(vector: Column) -> Column:
    """The vector at length one; a zero vector stays as it is.

    The length is bound to the variable of an outer one-element ``transform``. Written into
    the inner function, it would be computed again for every component.
    """

    def at_length_one(length: Column) -> Column:
        doubles = as_doubles(vector)
        return F.when(length > 0, F.transform(doubles, lambda x: x / length)).otherwise(doubles)

    return F.get(F.transform(F.array(norm(vector)), at_length_one), F.lit(0))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 if either vector has length 0."""
    return F.coalesce(F.try_divide(dot(left, right), norm(left) * norm(right)), F.lit(0.0))


def is_finite(vector: Column) -> Column:
    """True if no component is null, NaN or infinite."""
    return F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def check_finite(vector: Column) -> Column:
    """The vector itself; the job fails on the first one with a component that is null, NaN or infinite."""
    return F.when(is_finite(vector), vector).otherwise(F.raise_error(F.lit("vector is not finite")).cast("array<float>"))


def check_width(vector: Column, width: int) -> Column:
    """The vector itself; the job fails on the first one of another width.

    Use the result as the column that is kept: a check in a column that is dropped later
    would be optimised away.
    """
    found = F.coalesce(F.size(vector).cast("string"), F.lit("no"))
    message = F.concat(F.lit(f"expected vectors of width {width}, found width "), found)
    return F.when(F.coalesce(F.size(vector), F.lit(-1)) == width, vector).otherwise(
        F.raise_error(message).cast("array<float>")
    )
