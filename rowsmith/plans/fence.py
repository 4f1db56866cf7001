"""A point in a plan that filters are not moved below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the columns ``names`` computed here and not again.

    A filter above a projection is moved below it and repeats the expressions it reads,
    level by level, which multiplies long chains of them. It is not moved below an
    explode, so the columns pass through one of a single element each.
    """
    packed = F.struct(*[F.col(f"`{n}`").alias(n) for n in names])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    out = df.select(*rest, F.explode_outer(F.array(packed)).alias("_fenced"))
    return out.select(*rest, *[F.col(f"_fenced.`{n}`").alias(n) for n in names])
