"""Scores against labels: curves, thresholds, and the continuous Boyce index.

Inputs are (y, s): a label 1 or 0 and a score; rows whose score is null or NaN are left out everywhere. Results over an
empty class are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.running import running_sums
from terrane.session import staged


def scored(df: DataFrame) -> DataFrame:
    return df.filter(F.col("s").isNotNull() & ~F.isnan("s"))


def counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, s, pos, neg): rows of each class at each distinct score, written once, as several passes read it."""
    return staged(scored(df).groupBy(*by, "s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")))


def curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, s, pos, neg, tp, fp, p, n): what lies at or above each distinct score, and the totals."""
    c = counts(df, by)
    run = running_sums(c, "s", ["pos", "neg"], descending=True, by=by)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    joined = run.join(totals, list(by)) if by else run.join(F.broadcast(totals))
    return joined.select(*by, "s", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"), "p", "n")


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc): the chance that a presence scores above a background row, ties counting half; null over a single class."""
    return curve(df, by).groupBy(*by).agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), (F.max("p") * F.max("n")).cast("double")).alias("auc"))


def precision_recall(df: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at each distinct score."""
    c = curve(df)
    return c.select(F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("p")).alias("recall"))


def average_precision(df: DataFrame) -> DataFrame:
    """(ap): precision summed over the steps of recall."""
    return curve(df).agg(F.sum(F.try_divide(F.col("pos"), F.col("p")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def partial_auc(df: DataFrame, most: float = 0.1) -> DataFrame:
    """(proc): area under the ROC points with a false positive rate up to `most`, the last rate carried flat to it, over
    `most`. A step's area needs only the point before it, which is the row's own count taken off."""
    c = curve(df).select((F.col("fp") / F.col("n")).alias("x"), (F.col("tp") / F.col("p")).alias("t"), (F.col("neg") / F.col("n")).alias("dx"), (F.col("pos") / F.col("p")).alias("dt")).filter(F.col("x") <= most)
    area = F.sum(F.col("dx") * (F.col("t") - F.col("dt") / 2))
    last = F.max(F.struct("x", "t"))
    return c.agg(((area + (F.lit(most) - last["x"]) * last["t"]) / most).alias("proc"))


def confusion(df: DataFrame, threshold: float | Column) -> DataFrame:
    """(tp, fp, fn, tn) of score >= threshold."""
    up, yes = F.col("s") >= threshold, F.col("y") == 1
    return scored(df).agg(F.count_if(up & yes).alias("tp"), F.count_if(up & ~yes).alias("fp"), F.count_if(~up & yes).alias("fn"), F.count_if(~up & ~yes).alias("tn"))


def rates(c: DataFrame, mode: str = "exact") -> DataFrame:
    """Adds precision, recall, f1, omission and sedi to confusion counts; an empty denominator gives 0, sedi null at its
    limits. sedi is the published index; mode "reference" gives the ratio of difference and sum of ln(h (1 - f)) and
    ln((1 - h) f), which has the other sign."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    h, f = F.try_divide(tp, tp + fn), F.try_divide(fp, fp + tn)
    inner = (h > 0) & (h < 1) & (f > 0) & (f < 1)
    top = F.ln(f) - F.ln(h) - F.ln(1 - f) + F.ln(1 - h)
    below = F.ln(f) + F.ln(h) + F.ln(1 - f) + F.ln(1 - h)
    top = top if mode == "exact" else -top
    return c.withColumns({"precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn), "omission": 1 - zero(tp, tp + fn), "sedi": F.when(inner, top / below)})


def best_threshold(df: DataFrame, mode: str = "exact") -> DataFrame:
    """(threshold, f1): the score of largest F1 = 2pr / (p + r + 1e-9), the lowest of equal ones.

    mode "reference" gives the next lower score instead, as a curve read one place off does.
    """
    pr = precision_recall(df).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9))
    if mode == "exact":
        return pr.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")
    # the curve's first point is left out and its index used in the full list of thresholds
    lowest = pr.agg(F.min("threshold").alias("__lo"))
    best = pr.join(F.broadcast(lowest)).filter(F.col("threshold") > F.col("__lo")).orderBy(F.desc("f1"), "threshold").limit(1).select(F.col("threshold").alias("__t"), "f1")
    return pr.select("threshold").join(F.broadcast(best), F.col("threshold") < F.col("__t")).groupBy("f1").agg(F.max("threshold").alias("threshold"))


def unit_bin(c: Column | str, bins: int) -> Column:
    """The bin 0..bins-1 of a number in [0, 1], the last closed on the right; null outside."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when((v >= 0) & (v <= 1), F.least(F.floor(v * bins), F.lit(bins - 1)))


def boyce(df: DataFrame, bins: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, centre, ratio): density of presences over that of background by bin of score; bins without background are
    left out."""
    b = scored(df).withColumn("bin", unit_bin("s", bins)).filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("a"))
    totals = b.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("a").alias("ta"))
    joined = b.join(totals, list(by)) if by else b.join(F.broadcast(totals))
    return joined.filter("a > 0").select(*by, "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), F.try_divide(F.col("p") * F.col("ta"), (F.col("a") * F.col("tp")).cast("double")).alias("ratio"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate over rows in which both are known; null below two rows or without spread."""
    both = lambda v, o: F.when((F.col(o) if isinstance(o, str) else o).isNotNull(), v)
    a, b = both(x if not isinstance(x, str) else F.col(x), y), both(y if not isinstance(y, str) else F.col(y), x)
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def mean_rank(c: str, *by: str) -> Column:
    """The average rank of a value, for small tables such as curves."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2


def boyce_index(df: DataFrame, bins: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """(by, cbi_pearson, cbi_spearman) of the Boyce curve, null below two bins."""
    r = boyce(df, bins, by).withColumns({"__c": mean_rank("centre", *by), "__r": mean_rank("ratio", *by)})
    return r.groupBy(*by).agg(correlation("centre", "ratio").alias("cbi_pearson"), correlation("__c", "__r").alias("cbi_spearman"))


def information(df: DataFrame, k: int) -> DataFrame:
    """(ll, aic, aicc) of scores taken as probabilities, with k parameters; aicc is aic if there are too few rows."""
    s = F.col("s")
    ll = F.sum(F.when(F.col("y") == 1, F.ln(s + 1e-9)).otherwise(F.ln(1 - s + 1e-9)))
    t = scored(df).agg(ll.alias("ll"), F.count("*").alias("n")).withColumn("aic", 2.0 * k - 2 * F.col("ll"))
    return t.select("ll", "aic", (F.col("aic") + F.when(F.col("n") - k - 1 > 0, 2.0 * k * (k + 1) / (F.col("n") - k - 1)).otherwise(0.0)).alias("aicc"))


def omission_at_10(train: DataFrame, test: DataFrame) -> DataFrame:
    """(or10): share of the test presences below the 10th percentile of the train presences' scores; null without either."""
    from terrane.operators.stats import exact_percentiles

    cut = exact_percentiles(scored(train).filter("y = 1"), {"s": ("s", 0.1)})["s"]
    below = F.when(F.col("s") < F.lit(cut), 1.0).otherwise(0.0) if cut is not None else F.lit(None).cast("double")
    return scored(test).filter("y = 1").agg(F.avg(below).alias("or10"))


def topsis(auc: Column, proc: Column, sedi: Column, cbi: Column, or10: Column, auc_diff: Column, aicc: Column) -> Column:
    """Closeness to the ideal: benefits auc, proc, sedi, cbi; costs or10, |auc_diff| and aicc, each c taken as c / (1 + c);
    null counts as 0."""
    known = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    gain = [known(c) for c in (auc, proc, sedi, cbi)]
    costs = [c / (1 + c) for c in (known(or10), F.abs(known(auc_diff)), F.greatest(known(aicc), F.lit(0.0)))]
    square = lambda cs: F.sqrt(sum((c * c for c in cs), F.lit(0.0)))
    best, worst = square([1 - c for c in gain] + costs), square(gain + [1 - c for c in costs])
    return worst / F.nullif(best + worst, F.lit(0.0))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, share): the share of presences by bin of score, 0 for an empty bin; a score of exactly 1 is in none."""
    spark = df.sparkSession
    b = scored(df).withColumn("bin", F.floor(F.col("s") * bins)).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.avg(F.col("y").cast("double")).alias("v"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(b, "bin", "left").select("bin", F.coalesce("v", F.lit(0.0)).alias("share"))


def sweep(df: DataFrame, low: int = 5, high: int = 94, least: int = 2) -> DataFrame:
    """(threshold, auc, cbi): for thresholds low..high hundredths, the AUC of the binarised score and the Boyce index
    (Pearson) of the rows at or above it, null unless each class has `least` rows there.

    Rows are first counted by distinct threshold step and Boyce bin, so each is read once and not once a threshold.
    """
    bins = 25
    step = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.floor(F.col("s") * 100 + 1e-9)))
    c = scored(df).withColumns({"step": step.cast("int"), "bin": unit_bin("s", bins)}).groupBy("step", "bin").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("a"))
    t = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    pairs = c.join(F.broadcast(t)).withColumn("up", F.col("step") >= F.col("t"))
    auc = pairs.groupBy("t").agg(((F.try_divide(F.sum(F.when(F.col("up"), F.col("p"))), F.sum("p")) + F.try_divide(F.sum(F.when(~F.col("up"), F.col("a"))), F.sum("a"))) / 2).alias("auc"))
    b = pairs.filter(F.col("up") & F.col("bin").isNotNull()).groupBy("t", "bin").agg(F.sum("p").alias("p"), F.sum("a").alias("a"))
    totals = b.groupBy("t").agg(F.sum("p").alias("tp"), F.sum("a").alias("ta")).filter((F.col("tp") >= least) & (F.col("ta") >= least))
    cbi = b.filter("a > 0").join(totals, "t").withColumns({"x": (F.col("bin") + 0.5) / bins, "r": F.col("p") * F.col("ta") / (F.col("a") * F.col("tp"))}).groupBy("t").agg(correlation("x", "r").alias("cbi"))
    return auc.join(cbi, "t", "left").select((F.col("t") / 100).alias("threshold"), "auc", "cbi")


def crossing(curve_: DataFrame) -> DataFrame:
    """(at): where a Boyce curve first passes a ratio of 1, linearly between bins; else the centre of the nearest ratio."""
    w = W.partitionBy(F.lit(0)).orderBy("centre")
    d, nd, nx = F.col("ratio") - 1, F.lead("ratio").over(w) - 1, F.lead("centre").over(w)
    steps = curve_.withColumns({"__d": d, "__nd": nd, "__nx": nx})
    hit = steps.filter((F.col("__d") * F.col("__nd") <= 0) & (F.col("__d") != F.col("__nd"))).withColumn("at", F.col("centre") - F.col("__d") * (F.col("__nx") - F.col("centre")) / (F.col("__nd") - F.col("__d")))
    first = hit.agg(F.min(F.struct("centre", "at"))["at"].alias("at"))
    near = curve_.agg(F.min(F.struct(F.abs(F.col("ratio") - 1).alias("g"), "centre"))["centre"].alias("near"))
    return first.join(near).select(F.coalesce("at", "near").alias("at"))
