"""Expressions on embeddings as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprov.functions.text import trimmed
from docprov.functions.watermark import stripped


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_to(vector: list[float], a: Column) -> Column:
    """Cosine with a constant vector, whose norm is worked out once."""
    size = sum(x * x for x in vector) ** 0.5
    return F.try_divide(dot(a, F.array(*[F.lit(float(x)) for x in vector])), norm(a) * F.lit(size))


def input_text(title: Column, content: Column) -> Column:
    """What is embedded of a chunk: its title and its content without a mark."""
    return trimmed(F.concat(title, F.lit("\n\n"), stripped(content)))


def literal(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
