"""Distance expressions. All of them accumulate in float32, in ascending dimension order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Dimensions up to which the sum is written out term by term, so that it compiles with the plan around it.
WRITTEN_OUT = 128


def l2sq(q: str, x: str, d: int) -> Column:
    """Squared Euclidean distance of two float array columns of length d, as float; no square root.

    Longer vectors take higher-order functions, which Spark interprets: the same sum, several times slower.
    """
    if d > WRITTEN_OUT:
        return F.aggregate(F.zip_with(q, x, lambda a, b: a - b), F.lit(0).cast("float"), lambda acc, v: acc + v * v)
    terms = [f"(get({q}, {j}) - get({x}, {j})) * (get({q}, {j}) - get({x}, {j}))" for j in range(d)]
    return F.expr(" + ".join(["cast(0 as float)", *terms]))


def checked_vector(vec: Column | str, d: int) -> Column:
    """vec as array<float>, or an error if it is null, holds a null or is not d long.

    zip_with pads the shorter side with nulls, and a null distance would rank first: so ragged input
    must fail rather than win.
    """
    vec = F.col(vec) if isinstance(vec, str) else vec
    bad = vec.isNull() | (F.size(vec) != d) | F.exists(vec, lambda v: v.isNull())
    return F.when(bad, F.raise_error(F.lit(f"vectors must have {d} non-null elements"))).otherwise(vec).cast("array<float>")
