"""Taking the first rows of each group up to a quota, without ranking a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.session import staged

#: Cuts of the order key; a group's last, partly taken cut holds about one in so many of its rows and is ranked.
CUTS = 4096


def _cut(order: str) -> Column:
    return F.least(F.floor(F.col(order) * CUTS), F.lit(CUTS - 1)).cast("int")


def _ends(sized: DataFrame, left: DataFrame, group: Sequence[str], mine: Column) -> DataFrame:
    """(group, __to, __took): the last of the rows that together stay within __left, in order, and their size; groups of
    which none are taken are left out. Sizes are summed by group and cut; only the cut in which __left ends is ranked."""
    sums = sized.groupBy(*group, "__cut").agg(F.sum("__size").alias("__sum"), F.max(mine).alias("__far"))
    upto = sums.withColumn("__upto", F.sum("__sum").over(W.partitionBy(*group).orderBy("__cut").rowsBetween(W.unboundedPreceding, 0))).join(left, list(group))
    over = F.col("__upto") > F.col("__left")
    ends = upto.groupBy(*group).agg(
        F.first("__left").alias("__left"), F.min(F.when(over, F.col("__cut"))).alias("__end"), F.coalesce(F.max(F.when(~over, F.col("__upto"))), F.lit(0)).alias("__before"), F.max(F.when(~over, F.col("__far"))).alias("__to")
    )
    running = F.sum("__size").over(W.partitionBy(*group).orderBy("__mine")) + F.col("__before")
    last = sized.withColumn("__mine", mine).join(ends.filter("__end is not null").select(*group, "__left", "__end", "__before"), list(group)).filter(F.col("__cut") == F.col("__end"))
    last = last.withColumn("__run", running).filter(F.col("__run") <= F.col("__left")).groupBy(*group).agg(F.max("__mine").alias("__at"), F.max("__run").alias("__run"))
    both = ends.join(last, list(group), "left").select(*group, F.coalesce("__at", "__to").alias("__to"), F.coalesce("__run", "__before").alias("__took"))
    return both.filter(F.col("__to").isNotNull())


def take(rows: DataFrame, quotas: DataFrame, group: Sequence[str], order: str, tie: Sequence[str], size: Column, quota: str, rounds: int = 1, slack: float = 1e-3) -> DataFrame:
    """rows of the smallest `order` (a number in [0, 1)) in each group whose sizes together stay within the group's quota.

    quotas: one row (group, quota) a group. Rows of groups without a quota or of null order are left out. With rounds = 1
    (for sizes that are all the same) the rows up to the first that doesn't fit are taken. With more, a row that doesn't
    fit in what is left is passed over and those behind it are tried: each round goes on behind the last row taken with
    the rows small enough for what is left, until nothing more fits, less than `slack` of the quota is left, or the rounds
    are used up; rows equal in order and tie then go together. Of a group only one cut of the order is ever ranked in one
    task.
    """
    sized = rows.filter(F.col(order).isNotNull()).withColumns({"__size": size.cast("bigint"), "__cut": _cut(order)})
    mine = F.struct(order, *tie)
    wanted = quotas.select(*group, F.col(quota).cast("bigint").alias("__left"))
    if rounds == 1:
        sums = sized.groupBy(*group, "__cut").agg(F.sum("__size").alias("__sum"))
        upto = sums.withColumn("__upto", F.sum("__sum").over(W.partitionBy(*group).orderBy("__cut").rowsBetween(W.unboundedPreceding, 0)))
        over = F.col("__upto") > F.col("__left")
        ends = wanted.join(upto, list(group), "left").groupBy(*group).agg(F.first("__left").alias("__left"), F.min(F.when(over, F.col("__cut"))).alias("__end"), F.max(F.when(~over, F.col("__upto"))).alias("__before"))
        placed = sized.join(ends, list(group)).filter(F.col("__end").isNull() | (F.col("__cut") <= F.col("__end")))
        running = F.sum("__size").over(W.partitionBy(*group).orderBy(order, *tie).rowsBetween(W.unboundedPreceding, 0))
        whole = placed.filter(F.col("__end").isNull() | (F.col("__cut") < F.col("__end")))
        partly = placed.filter(F.col("__cut") == F.col("__end")).withColumn("__run", running).filter(F.col("__run") + F.coalesce("__before", F.lit(0)) <= F.col("__left")).drop("__run")
        return whole.unionByName(partly).select(*rows.columns)
    # of each round: behind which row it began, at which it ended, and how large its rows are at most
    state = wanted.select(*group, "__left", F.lit(None).cast(sized.select(mine.alias("m")).schema[0].dataType).alias("__from"), F.col("__left").alias("__quota"))
    done = None
    for _ in range(rounds):
        fit = sized.join(state, list(group)).filter((F.col("__size") <= F.col("__left")) & (F.col("__from").isNull() | (mine > F.col("__from")))).drop("__left", "__from", "__quota")
        ends = staged(state.join(_ends(fit, state.select(*group, "__left"), group, mine), list(group)).select(*group, "__from", "__to", F.col("__left").alias("__most"), (F.col("__left") - F.col("__took")).alias("__left"), "__quota"))
        if ends.isEmpty():
            break
        done = ends if done is None else done.unionByName(ends)
        state = ends.filter(F.col("__left") > F.col("__quota") * slack).select(*group, "__left", F.col("__to").alias("__from"), "__quota")
    if done is None:
        return rows.limit(0)
    spans = done.groupBy(*group).agg(F.collect_list(F.struct("__from", "__to", "__most")).alias("__spans"))
    inside = F.exists("__spans", lambda p: (F.col("__size") <= p["__most"]) & (mine <= p["__to"]) & (p["__from"].isNull() | (mine > p["__from"])))
    return sized.join(spans, list(group)).filter(inside).select(*rows.columns)


def last_taken(rows: DataFrame, quotas: DataFrame, group: Sequence[str], order: str, tie: Sequence[str], quota: str) -> DataFrame:
    """(group, __last): the last (order, tie) of the first `quota` rows of each group; groups of which none is taken are left out."""
    sized = rows.filter(F.col(order).isNotNull()).withColumns({"__size": F.lit(1).cast("bigint"), "__cut": _cut(order)})
    return _ends(sized, quotas.select(*group, F.col(quota).cast("bigint").alias("__left")), group, F.struct(order, *tie)).select(*group, F.col("__to").alias("__last"))


def smallest(rows: DataFrame, n: Column | DataFrame | int, order: str, tie: Sequence[str]) -> DataFrame:
    """The n rows of smallest `order` (in [0, 1)) of the whole table, in doubt by tie; n may be a table of one row and column.

    Unlike a sort with a limit, any number of rows is taken without bringing them to one task.
    """
    one = F.lit(0)
    quota = n.toDF("__n").withColumn("__all", one) if isinstance(n, DataFrame) else rows.sparkSession.range(1).select((n if isinstance(n, Column) else F.lit(n)).cast("bigint").alias("__n"), one.alias("__all"))
    return take(rows.withColumn("__all", one), quota, ["__all"], order, tie, F.lit(1), "__n").drop("__all")


def share_of(rows: DataFrame, share: float, order: str, tie: Sequence[str], least: int = 2) -> DataFrame:
    """max(least, round(share x rows)) rows, those of smallest `order`, in doubt by tie; all if there are fewer."""
    n = rows.agg(F.greatest(F.lit(least), F.round(F.count("*") * share)).cast("bigint").alias("n"))
    return smallest(rows, n, order, tie)
