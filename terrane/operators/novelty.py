"""How far cells lie from the reference: similarity surfaces, Mahalanobis distance, classes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.operators.collinear import product_sums
from terrane.operators.stats import exact_percentiles

#: Pieces that a variable's distinct values are cut into; ranks within a piece are counted by one task.
PIECES = 64


def reference(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, value, n): the distinct finite values of each variable, and how often they occur."""
    l = df.unpivot([], [F.col(v).cast("double").alias(v) for v in variables], "variable", "value")
    return l.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).groupBy("variable", "value").agg(F.count("*").alias("n"))


def counted(ref: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (variable, value) with upto (reference values <= value), total, low and high of the variable; each value once.

    The distinct values of both tables are cut at approximate percentiles of their own and summed within a piece; the
    pieces' totals are added, so a variable of any number of distinct values and any spread is no single task. A variable
    without a reference gives no row.
    """
    ends = ref.groupBy("variable").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    both = ref.select("variable", "value", "n", F.lit(False).alias("__a")).unionByName(asked.select("variable", "value").distinct().withColumns({"n": F.lit(0).cast("bigint"), "__a": F.lit(True)}))
    cuts = both.groupBy("variable").agg(F.percentile_approx("value", [i / PIECES for i in range(1, PIECES)], 1000).alias("__cuts"))
    # a row for each variable, so it is small whatever the tables
    cut = both.join(F.broadcast(cuts), "variable").withColumn("__p", F.size(F.filter("__cuts", lambda c: c <= F.col("value")))).drop("__cuts")
    sums = cut.groupBy("variable", "__p").agg(F.sum("n").alias("__s"))
    before = sums.select("variable", "__p", F.coalesce(F.sum("__s").over(W.partitionBy("variable").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    # by range, so that equal reference values count wherever they stand
    own = F.sum("n").over(W.partitionBy("variable", "__p").orderBy("value"))
    told = cut.withColumn("__o", own).filter("__a").join(before, ["variable", "__p"]).join(F.broadcast(ends), "variable")
    return told.select("variable", "value", (F.col("__o") + F.col("__b")).alias("upto"), "total", "low", "high")


def cumulative(ref: DataFrame) -> DataFrame:
    """(variable, value, upto, total, low, high) of the reference's own distinct values."""
    return counted(ref, ref)


def similarity(value: Column, upto: Column, total: Column, low: Column, high: Column) -> Column:
    """100 at the reference's median down to 0 at its ends, and below 0 outside in proportion to its range; without a
    range 100 for its value and -100 for others."""
    span = F.nullif(high - low, F.lit(0.0))
    share = upto / total
    inside = F.when(share <= 0.5, 200 * share).otherwise(200 * (1 - share))
    return F.when(high == low, F.when(value == low, 100.0).otherwise(-100.0)).when(value < low, 100 * (value - low) / span).when(value > high, 100 * (high - value) / span).otherwise(inside)


def mess(cells: DataFrame, key: Sequence[str], ref: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(key, mess, limiting): the lowest similarity over the variables and the first variable that has it
    (to nine decimals); null if the cell
    has no known value.

    Distinct values of the cells are ranked among the reference's distinct values (`counted`), so neither a cell's row nor a
    variable is ever compared with the whole reference. A value that many cells share is looked up once; its rows meet
    its score in a join whose skewed partitions the engine splits.
    """
    place = {v: i for i, v in enumerate(variables)}
    l = cells.unpivot(list(key), [F.col(v).cast("double").alias(v) for v in variables], "variable", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    one = counted(ref, l).select("variable", "value", similarity(F.col("value"), F.col("upto"), F.col("total"), F.col("low"), F.col("high")).alias("score"))
    order = F.element_at(F.create_map(*[F.lit(x) for v, i in place.items() for x in (v, i)]), F.col("variable"))
    worst = l.join(one, ["variable", "value"]).groupBy(*key).agg(F.min(F.struct(F.round("score", 9).alias("r"), order.alias("o"), "variable", "score")).alias("__w"))
    return cells.select(*key).join(worst, list(key), "left").select(*key, F.col("__w.score").alias("mess"), F.col("__w.variable").alias("limiting"))


def training(df: DataFrame, variables: Sequence[str], cutoff: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(means, pseudo-inverse of the covariance) of the rows in which all variables are known: one pass for the means, one for
    the products about them, so that no digits are lost where values are far from 0."""
    n, s, _ = product_sums(df, variables)
    mean = s / max(n, 1)
    _, s, p = product_sums(df, variables, mean)
    return mean, np.linalg.pinv((p - np.outer(s, s) / max(n, 1)) / max(n - 1, 1), rcond=cutoff)


def distance2(variables: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared Mahalanobis distance as an expression; null if a variable is."""
    d = [F.col(v) - F.lit(float(m)) for v, m in zip(variables, mean)]
    out = F.lit(0.0)
    for i, a in enumerate(d):
        for j, b in enumerate(d[i:], i):
            out = out + a * b * F.lit(float(inverse[i, j] * (1 if i == j else 2)))
    return out


def nt2(cells: DataFrame, train: DataFrame, variables: Sequence[str], quantile: float = 0.99) -> DataFrame:
    """Adds nt2: squared distance over the `quantile` of the training rows' squared distances; null if that isn't positive."""
    mean, inverse = training(train, variables)
    d2 = distance2(variables, mean, inverse)
    tau = exact_percentiles(train.dropna(subset=list(variables)), {"d2": (d2, quantile)})["d2"]
    return cells.withColumn("nt2", d2 / F.lit(float(tau)) if tau and tau > 0 else F.lit(None).cast("double"))


def novelty_class(mess_: Column, nt2_: Column) -> Column:
    """0 neither, 1 outside a variable's range, 2 outside their combination, 3 both; null if either is unknown."""
    return F.when(mess_.isNotNull() & nt2_.isNotNull(), F.when(mess_ < 0, 1).otherwise(0) + F.when(nt2_ > 1, 2).otherwise(0))


def class_shares(classes: DataFrame, cell_km2: float = 1.0) -> DataFrame:
    """(cls, n, share, km2) of each class, unknown ones left out."""
    g = classes.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("n"))
    return g.select("cls", "n", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("share"), (F.col("n") * cell_km2).alias("km2"))


def limiting_counts(found: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, n, negative): cells that each variable limits, and those of them below 0; variables that limit none too."""
    v = found.sparkSession.createDataFrame([(x,) for x in variables], "variable string")
    g = found.groupBy(F.col("limiting").alias("variable")).agg(F.count("*").alias("n"), F.count_if(F.col("mess") < 0).alias("negative"))
    return v.join(g, "variable", "left").select("variable", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("negative", F.lit(0)).alias("negative"))
