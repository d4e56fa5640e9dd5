"""The best N items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.session import staged


def top_n(items: DataFrame, groups: list[str], score: str, key: str, n: int, per: int = 1_000_000) -> DataFrame:
    """The n items of highest score in each group, then of smallest key; the rank (from 1) is added as `rank`.

    Two stages: a group is cut into subgroups by a hash of the key, one for every `per` rows it has, and the best n keys of
    each are kept, then these survivors are ranked by score and key. So a group of any size is spread over the cluster by
    its size, and of a small one only n rows move on. Groups are counted by partial sums in each task; the list of those
    of more than `per` rows is written, so the planner sees its size. Deliveries of one key count once in a group, with the
    best of their scores: keys are reduced to it before any ranking. Rows with a null group, key or score, or a score that
    isn't finite, take no part; groups smaller than n give all their items; an empty table gives none.
    """
    keep = F.col(key).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    for g in groups:
        keep &= F.col(g).isNotNull()
    order = [F.desc(score), F.asc(key)]
    items = items.filter(keep).select(*groups, key, score)
    large = staged(items.groupBy(*groups).agg(F.count("*").alias("__n")).filter(F.col("__n") > per).select(*groups, F.ceil(F.col("__n") / per).alias("__cuts")))
    salt = F.pmod(F.xxhash64(key), F.coalesce("__cuts", F.lit(1)))
    # a key always has the same salt, so the first ranking needs no other shuffle than the reduction's
    items = items.join(large, groups, "left").select(*groups, key, score, salt.alias("__salt")).repartition(*groups, "__salt")
    once = items.groupBy(*groups, "__salt", key).agg(F.max(score).alias(score))
    near = once.withColumn("__r", F.row_number().over(W.partitionBy(*groups, "__salt").orderBy(*order))).filter(F.col("__r") <= n)
    return near.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= n).select(*groups, key, score, "rank")
