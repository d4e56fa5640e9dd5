"""Running sums over a whole table in order, without bringing it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(df: DataFrame, order: str, sums: Sequence[str], descending: bool = False, pieces: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """Adds run_<c> for each c of sums: its total over all rows (of the row's group `by`) up to and including its place in
    the order.

    order: numbers that are unique in a group. The range is cut into `pieces` at approximate percentiles (one pass, that
    many numbers at most reach the driver); each piece of a group is summed in its own task and the totals of the pieces
    before it are added.
    """
    cuts = df.agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 1000)).collect()[0][0] or []
    cuts = sorted(set(cuts))
    at = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + F.when(c <= F.col(order), 1).otherwise(0)) if cuts else F.lit(0)
    cut = df.withColumn("__piece", at)
    totals = cut.groupBy(*by, "__piece").agg(*[F.sum(c).alias(c) for c in sums])
    key = F.desc if descending else F.asc
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(key("__piece")).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*by, "__piece", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__b_{c}") for c in sums])
    own = W.partitionBy(*by, "__piece").orderBy(key(order)).rowsBetween(W.unboundedPreceding, 0)
    summed = cut.select("*", *[F.sum(c).over(own).alias(f"__r_{c}") for c in sums])
    out = summed.join(before, [*by, "__piece"]) if by else summed.join(F.broadcast(before), "__piece")
    return out.select(*df.columns, *[(F.col(f"__r_{c}") + F.col(f"__b_{c}")).alias(f"run_{c}") for c in sums])
