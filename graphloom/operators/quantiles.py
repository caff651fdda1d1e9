"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

#: Ranks that a sketch may be off by are n / ACCURACY; groups of no more values are ranked whole.
ACCURACY = 10_000
#: How many times that the bounds stand off, so that they hold the rank for certain.
MARGIN = 4


def quantiles(rows: DataFrame, value: str, wanted: dict[str, float], by: list[str]) -> DataFrame:
    """(by, n, one column a quantile), exact and interpolated; nulls do not count, and the columns ``by`` hold none.

    A sketch gives bounds around each quantile; one more pass counts the values below and takes those between, about
    2 * MARGIN / ACCURACY of all, and only these are ranked. ``rows`` is read three times.
    """
    v = F.col(value).cast("double")
    points = [min(1.0, max(0.0, q + side * MARGIN / ACCURACY)) for q in wanted.values() for side in (-1, 1)]
    told = cut(rows.groupBy(*by).agg(F.count(v).alias("n"), F.percentile_approx(v, points, ACCURACY).alias("bounds")))
    bounded = rows.select(*by, v.alias("v")).filter("v IS NOT NULL").join(F.broadcast(told), by)
    whole = F.col("n") <= ACCURACY
    low = lambda i: whole | (F.col("v") >= F.col("bounds")[2 * i])
    high = lambda i: whole | (F.col("v") <= F.col("bounds")[2 * i + 1])
    below = bounded.groupBy(*by).agg(*[F.count_if(~low(i)).alias(f"below{i}") for i in range(len(wanted))])
    inside = F.array_compact(F.array(*[F.when(low(i) & high(i), F.lit(i)) for i in range(len(wanted))]))
    near = bounded.select(*by, "v", F.explode(inside).alias("i")).groupBy(*by, "i", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("v"))
    placed = near.withColumn("end", upto).join(F.broadcast(told.select(*by, "n").join(below, by)), by)
    columns = []
    for i, (name, q) in enumerate(wanted.items()):
        rank = F.lit(q) * (F.col("n") - 1)
        end = F.col(f"below{i}") + F.col("end")
        at = lambda r, i=i, end=end: F.max(F.when((F.col("i") == i) & (end > r) & (end - F.col("c") <= r), F.col("v")))
        columns += [at(F.floor(rank)).alias(f"{name}_low"), at(F.ceil(rank)).alias(f"{name}_high")]
    found = told.select(*by, "n").join(placed.groupBy(*by).agg(*columns), by, "left")
    out = []
    for name, q in wanted.items():
        a, b, rank = F.col(f"{name}_low"), F.col(f"{name}_high"), F.lit(q) * (F.col("n") - 1)
        lost = (F.col("n") > 0) & (a.isNull() | b.isNull())
        between = F.when(a == b, a).otherwise((F.floor(rank) + 1 - rank) * a + (rank - F.floor(rank)) * b)
        out.append(F.when(lost, F.raise_error(F.lit(f"the bounds of {name} do not hold it")).cast("double")).otherwise(between).alias(name))
    return found.select(*by, "n", *out)
