"""Vector columns: unit length, dot products, text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def parse_vector(text: Column) -> Column:
    """``[a, b, c]`` or ``a, b, c`` to an array of floats."""
    body = F.regexp_replace(text, r"^\s*\[?|\]?\s*\z", "")
    return F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def is_valid(v: Column) -> Column:
    """Non-empty and not all zero, of any width."""
    return F.coalesce((F.size(v) > 0) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """The vector at length one; null where it has none. Padding is not needed: it never changes a cosine."""
    # the norm is bound once, outside the inner function, where it would be computed for every element
    norms = F.array(F.sqrt(dot(v, v)))
    scaled = F.transform(norms, lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return F.when(is_valid(v), F.get(scaled, F.lit(0)))
