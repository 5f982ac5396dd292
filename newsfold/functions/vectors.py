"""Vector columns: arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: What the three code points of a trigram are multiplied by, and the prime that takes the sum before the vector's size does.
HASH, PRIME = (919_393, 4_057, 31), 1_000_003


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Counts of the text's character trigrams by hash: a stand-in where no encoder is given. Null text is zero.

    A trigram's place is (sum of ``HASH`` times its code points) mod ``PRIME`` mod size.
    """
    points = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))

    def vector(c: Column) -> Column:
        x, y, z = (F.slice(c, k + 1, F.greatest(F.size(c) - 2, F.lit(0))) for k in range(3))
        mixed = F.zip_with(F.zip_with(x, y, lambda a, b: a * HASH[0] + b * HASH[1]), z, lambda ab, d: ab + d * HASH[2])
        places = F.transform(mixed, lambda h: (h % PRIME % size).cast("int"))
        # sorted together with each place once: the next place begins behind the hits of this one
        both = F.array_sort(F.concat(places, F.sequence(F.lit(0), F.lit(size))))
        return F.transform(F.array(both), lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.array_position(b, k + 1) - F.array_position(b, k) - 1).cast("double")))[0]

    return F.transform(F.array(points), vector)[0]
