"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 if a vector is zero."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def known(x: Column) -> Column:
    """The number, with NaN as null."""
    return F.when(~F.isnan(x), x)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Each column's exact median over its known values; 0 where there is none."""
    from sieveline.functions.percentiles import exact

    return {c: v if (v := exact(df.select(known(F.col(c).cast("double")).alias(c)), c, [0.5])[0]) is not None else 0.0 for c in columns}


def filled(rows: DataFrame, vector_col: str = "v") -> DataFrame:
    """The rows, with missing components of the vector filled with their column's median, or 0 in a column without any."""
    v = F.col(vector_col)
    size = rows.agg(F.max(F.size(v)).alias("d")).collect()[0].d or 0
    gap = [F.count_if(v[i].isNull() | F.isnan(v[i])) for i in range(size)]
    found = rows.agg(*(g.alias(str(i)) for i, g in enumerate(gap))).collect()[0] if size else []
    gaps = [i for i, n in enumerate(found) if n]
    if not gaps:
        return rows
    fill = medians(rows.select(*(v[i].alias(f"c{i}") for i in gaps)), [f"c{i}" for i in gaps])
    defaults = F.array(*(F.lit(float(fill.get(f"c{i}", 0.0))) for i in range(size)))
    return rows.withColumn(vector_col, F.transform(v, lambda x, i: F.coalesce(known(x), defaults[i])))


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers filled with their column's median, or 0 in a column without any."""
    fill = medians(df, columns)
    return df.withColumns({c: F.coalesce(known(F.col(c).cast("double")), F.lit(fill[c])) for c in columns})
