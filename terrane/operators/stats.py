"""Summaries of run tables: means with intervals, comparisons, histograms, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.running import running_sums
from terrane.operators.metrics import correlation


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def student_p(t: float, df: float) -> float:
    """The two-sided p of Student's t."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    """t such that a share p of the distribution lies below, p above one half."""
    low, high = 0.0, 1.0
    while 1 - student_p(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - student_p(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else student_p(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    known: dict[tuple[float, float], float] = {}
    out = []
    for key in zip(p, df):
        if pd.isna(key[1]) or key[1] <= 0:
            out.append(None)
            continue
        if key not in known:
            known[key] = student_quantile(*key)
        out.append(known[key])
    return pd.Series(out, dtype="float64")


def interval(df: DataFrame, by: Sequence[str], value: str, method: str = "normal") -> DataFrame:
    """(by, n, mean, sd, half) of a value, half being half the width of the 95 % interval.

    method: "rows" divides by the root of all rows, null values included; "normal" by that of the known values, null below
    two of them; "student" uses Student's t with n - 1 degrees of freedom instead of 1.96, and adds t.
    """
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    g = df.groupBy(*by).agg(F.count(v).alias("n"), F.count("*").alias("__rows"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    if method == "rows":
        return g.withColumn("half", 1.96 * F.col("sd") / F.sqrt("__rows")).drop("__rows")
    if method == "normal":
        return g.withColumn("half", F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt("n"))).drop("__rows")
    t = t_quantile(F.lit(0.975), (F.col("n") - 1).cast("double"))
    return g.withColumn("t", t).withColumn("half", F.col("t") * F.col("sd") / F.sqrt("n")).drop("__rows")


def distribution(df: DataFrame, by: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """(by, n, min, p05, q1, median, q3, p95, max, mean); percentiles are exact, interpolated linearly, which holds a group's
    distinct values in a task, or with `accuracy` off by up to one part in so many of the rank, for large groups."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    at = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), *[(F.percentile(v, p) if accuracy is None else F.percentile_approx(v, p, accuracy)).alias(n) for n, p in at.items()], F.max(v).alias("max"), F.avg(v).alias("mean"))


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], most: int = 100_000) -> dict[str, float | None]:
    """Exact percentiles of whole columns, interpolated linearly, as numbers: name -> (column, share); null without values.

    A bracket about each percentile is taken from an approximate one, what lies below it counted, and the bracket narrowed
    until it holds at most `most` values, which alone are sorted (on the driver). All columns share each pass; no task holds
    a column's distinct values.
    """
    import numpy as np

    columns = {k: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for k, (c, _) in ((k, (F.col(v[0]).cast("double") if isinstance(v[0], str) else v[0].cast("double"), v[1])) for k, v in wanted.items())}
    rows = df.select(*[c.alias(k) for k, c in columns.items()])
    near = 0.002
    first = rows.agg(*[F.struct(F.count(k), F.min(k), F.max(k), F.percentile_approx(k, [max(0.0, q - near), min(1.0, q + near)], 10_000)).alias(k) for k, (_, q) in wanted.items()]).first()
    out: dict[str, float | None] = {}
    open_: dict[str, list] = {}
    for k, (_, q) in wanted.items():
        n, low, high, approx = first[k]
        if n:
            open_[k] = [q * (n - 1), low, high, *approx]
        else:
            out[k] = None
    while open_:
        inside = {k: F.col(k).between(b[3], b[4]) for k, b in open_.items()}
        told = rows.agg(*[F.struct(F.count_if(F.col(k) < open_[k][3]), F.count_if(c), F.percentile_approx(F.when(c, F.col(k)), [i / 64 for i in range(65)], 10_000)).alias(k) for k, c in inside.items()]).first()
        for k, (rank, low, high, a, z) in list(open_.items()):
            below, held, cuts = told[k]
            lo, hi = int(np.floor(rank)), int(np.ceil(rank))
            if not below <= lo or not hi < below + held:  # the approximate bracket missed it
                open_[k][3:] = [low, high]
                if (a, z) == (low, high):
                    raise ValueError("the table changed while it was read")
            elif a == z:
                out[k] = float(a)
                del open_[k]
            elif held <= most:
                got = np.sort(np.array([r[0] for r in rows.filter(inside[k]).select(k).collect()]))
                out[k] = float(got[lo - below] + (rank - lo) * (got[hi - below] - got[lo - below]))
                del open_[k]
            else:
                i = min(63, int((lo - below) / held * 64))
                at = [cuts[max(0, i - 1)], cuts[min(64, i + 2)]]
                if at != [a, z]:
                    open_[k][3:] = at
                else:  # a few values are most of the bracket, so it doesn't narrow: rank the distinct ones by their counts
                    run = running_sums(rows.filter(inside[k]).groupBy(k).agg(F.count("*").alias("__n")), k, ["__n"])
                    x, y = run.agg(*[F.min(F.when(F.col("run___n") + below > r, F.col(k))) for r in (lo, hi)]).first()
                    out[k] = float(x + (rank - lo) * (y - x))
                    del open_[k]
    return out


def share_of_total(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds relative: the value over its sum in the group, null if that is 0. The sums are joined, so a large group is not
    brought to one task."""
    total = df.groupBy(*by).agg(F.sum(value).alias("__t"))
    return df.join(total, list(by)).withColumn("relative", F.try_divide(F.col(value), F.col("__t"))).drop("__t")


def varying(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, kept): whether a column's known values are not all the same; a column without any is not kept."""
    v = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.agg(*[F.coalesce(F.max(v(c)) > F.min(v(c)), F.lit(False)).alias(c) for c in columns]).unpivot([], list(columns), "variable", "kept")


def kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, kinds): how many different values a column has, null being one of them."""
    return df.agg(*[(F.countDistinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias(c) for c in columns]).unpivot([], list(columns), "variable", "kinds")


def means(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, values): means of the known values, null and NaN left out."""
    return df.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in values])


def top_row(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[Column | str]) -> DataFrame:
    """The row of highest score in each group, known scores first, then by tie."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(score), *tie))).filter("__n = 1").drop("__n")


def welch(df: DataFrame, by: Sequence[str], side: str, a, b, value: str) -> DataFrame:
    """(by, n_a, n_b, mean_a, mean_b, difference, percent, t, df, p, low, high, cohen_d, effect) of a value on two sides.

    Only groups with rows on both sides. No spread at all gives t 0 and p 1; fewer than two values on a side give null
    tests. percent is null if the base mean is 0.
    """
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    on = lambda x: F.when(F.col(side) == x, v)
    g = df.groupBy(*by).agg(*[f(on(x)).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]).filter("n_a > 0 and n_b > 0")
    c = F.col
    ea, eb = c("var_a") / c("n_a"), c("var_b") / c("n_b")
    enough = (c("n_a") > 1) & (c("n_b") > 1)
    g = g.withColumns({"difference": c("mean_b") - c("mean_a"), "percent": F.try_divide(100 * (c("mean_b") - c("mean_a")), F.abs("mean_a")), "se": F.when(enough, F.sqrt(ea + eb))})
    square = lambda x: x * x
    g = g.withColumns({"t": F.when(c("se") == 0, 0.0).otherwise(F.try_divide(c("difference"), c("se"))), "df": F.try_divide(square(ea + eb), square(ea) / F.nullif(c("n_a") - 1, F.lit(0)) + square(eb) / F.nullif(c("n_b") - 1, F.lit(0)))})
    pooled = F.sqrt(((c("n_a") - 1) * c("var_a") + (c("n_b") - 1) * c("var_b")) / F.nullif(c("n_a") + c("n_b") - 2, F.lit(0)))
    g = g.withColumns({"p": F.when(c("se") == 0, 1.0).otherwise(p_value("t", "df")), "half": t_quantile(F.lit(0.975), "df") * c("se"), "cohen_d": F.when(enough & (pooled > 0), c("difference") / pooled)})
    size = F.abs("cohen_d")
    effect = F.when(size.isNull(), None).when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return g.withColumns({"low": c("difference") - c("half"), "high": c("difference") + c("half"), "effect": effect}).drop("var_a", "var_b", "half", "se")


def histogram(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, width: float) -> DataFrame:
    """(by, bin, n): counts in bins of equal width, values being cut to [low, high] and the last bin closed."""
    bins = round((high - low) / width)
    v = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(value)))
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.least(F.floor((v - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantile(bins: DataFrame, by: Sequence[str], p: float, low: float, width: float) -> DataFrame:
    """(by, value): the percentile read off a histogram, linearly within its bin. bins: few rows a group."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    c = bins.withColumns({"__c": F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "__t": F.sum("n").over(w)})
    hit = c.filter(F.col("__c") >= F.lit(p) * F.col("__t")).withColumn("__v", F.lit(float(low)) + width * (F.col("bin") + (F.lit(p) * F.col("__t") - (F.col("__c") - F.col("n"))) / F.col("n")))
    first = F.min(F.struct("bin", "__v"))["__v"].alias("value")
    return hit.groupBy(*by).agg(first) if by else hit.agg(first)


def moments(df: DataFrame, by: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """(by, n, total, squares, min, max, negative, below_low, above_high): sums that add up over separate parts."""
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v < 0).alias("negative"), F.count_if(v < low).alias("below_low"), F.count_if(v > high).alias("above_high"))


def merged_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of separate parts or days taken together, with mean and (population) standard deviation."""
    g = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares", "negative", "below_low", "above_high")], F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.col("total") / F.col("n")
    return g.withColumns({"mean": mean, "sd": F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))})


def correlations(df: DataFrame, columns: Sequence[str], complete: bool = False) -> DataFrame:
    """(a, b, r) for each pair a < b in the order of columns, over rows where both are known, or where all are (complete).

    One pass with a few sums for each pair; for many columns see `terrane.operators.collinear.product_sums`.
    """
    d = df.dropna(subset=list(columns)) if complete else df
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = d.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))


def within_domains(pairs: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, a, b, r) of the pairs (a, b, r) whose variables are of one domain (variable, domain)."""
    a, b = domains.select(F.col("variable").alias("a"), "domain"), domains.select(F.col("variable").alias("b"), "domain")
    return pairs.join(a, "a").join(b, ["b", "domain"]).select("domain", "a", "b", "r")


def uniqueness(pairs: DataFrame) -> DataFrame:
    """(variable, uniqueness): one less the largest absolute correlation with another variable."""
    both = pairs.select(F.col("a").alias("variable"), "r").unionByName(pairs.select(F.col("b").alias("variable"), "r"))
    return both.groupBy("variable").agg((1 - F.max(F.abs("r"))).alias("uniqueness"))


def correlation_change(old: DataFrame, new: DataFrame, variables: int) -> DataFrame:
    """(mean_abs, max_abs, frobenius): change of correlations (a, b, r) between two sets of rows, over pairs known in both;
    frobenius is that of the full symmetric matrix over the root of its known cells, the diagonal being unchanged."""
    d = old.withColumnRenamed("r", "r0").join(new, ["a", "b"]).withColumn("d", F.col("r") - F.col("r0")).filter("d is not null")
    return d.agg(F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"), F.sqrt(2 * F.sum(F.col("d") * F.col("d")) / (2 * F.count("d") + variables)).alias("frobenius"))
