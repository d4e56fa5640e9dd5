"""Run tables: summaries by combination, pairing of runs, expected sets, selection of the best, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.text import folded
from terrane.operators.stats import interval, top_row, welch


def combinations(runs: DataFrame, by: Sequence[str], values: Sequence[str], splits: Sequence[str] = ("validation", "test"), year: str = "test_year") -> DataFrame:
    """(by, split, <v>_mean, <v>_std, years) of the splits that count."""
    kept = runs.filter(folded("split").isin(*splits))
    return kept.groupBy(*by, "split").agg(*[f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))], F.countDistinct(year).alias("years"))


def by_split(runs: DataFrame, by: Sequence[str], values: Sequence[str], splits: Sequence[str] = ("validation", "test")) -> DataFrame:
    """(by, <v>_<split>): means side by side, a missing split being null."""
    return runs.groupBy(*by).agg(*[F.avg(F.when(folded("split") == k, F.col(c))).alias(f"{c}_{k}") for c in values for k in splits])


def importance_summary(records: DataFrame, by: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """(by, mean, std, median, n, cv); cv is null where the mean is 0. The median is exact, or with accuracy approximate for
    groups of very many values."""
    middle = F.percentile(value, 0.5) if accuracy is None else F.percentile_approx(value, 0.5, accuracy)
    g = records.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), middle.alias("median"), F.count(value).alias("n"))
    return g.withColumn("cv", F.try_divide("std", "mean"))


def fold_summary(records: DataFrame, by: Sequence[str], value: str, above: float = 0.0) -> DataFrame:
    """(by, n, mean, sd, t, half, min, max, positive) over all folds: half of Student's 95 % interval, and values over `above`."""
    t = interval(records, by, value, "student")
    g = records.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(F.col(value) > above).alias("positive"))
    return t.join(g, list(by))


def repeats(records: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, mean, std, min, max); a single repeat has a std of 0."""
    return records.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def class_summary(rows: DataFrame, columns: Sequence[str], label: str = "y") -> DataFrame:
    """(variable, label, mean, std) of each column by class."""
    return rows.unpivot([label], list(columns), "variable", "value").groupBy("variable", label).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def missing_and_unique(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, missing, uniques) of each column; a null is no value of its own."""
    return rows.select(*columns).unpivot([], list(columns), "variable", "value").groupBy("variable").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.countDistinct("value").alias("uniques"))


def strength_summary(trials: DataFrame, by: str, first: Sequence[str] = ("pearson", "cbi")) -> DataFrame:
    """(by, n, auc_mean, auc_std, pearson_mean, spearman_mean) of complete trials, older columns standing in for missing ones."""
    t = trials.filter(F.upper("state") == "COMPLETE")
    return t.groupBy(by).agg(F.count("*").alias("n"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg(F.coalesce(*first)).alias("pearson_mean"), F.avg("spearman").alias("spearman_mean"))


def covered(runs: DataFrame, by: Sequence[str], year: str, wanted: int) -> DataFrame:
    """(by, years, complete): distinct years of each combination, and whether there are `wanted`."""
    return runs.groupBy(*by).agg(F.countDistinct(year).alias("years")).withColumn("complete", F.col("years") == wanted)


def effective_share(policy: DataFrame, source: str = "source", year: str = "year", share: str = "share", flat: str = "flat") -> DataFrame:
    """(year, share): of all sources the smallest share of a year, a source without one for the year using its flat share.

    policy: (source, year, share, flat), year null where a source has only a flat one."""
    years = policy.select(year).dropna().distinct()
    sources = policy.groupBy(source).agg(F.max(flat).alias("__flat"), F.collect_set(F.when(F.col(year).isNotNull(), F.struct(F.col(year).alias("y"), F.col(share).alias("s")))).alias("__own"))
    all_ = sources.select(source, "__flat", "__own").join(F.broadcast(years.agg(F.collect_set(year).alias("__years")))).select("__flat", "__own", F.explode("__years").alias(year))
    own = F.filter("__own", lambda s: s["y"] == F.col(year))
    return all_.groupBy(year).agg(F.min(F.coalesce(F.get(own, F.lit(0))["s"], F.col("__flat"))).alias("share"))


def inflation_summary(requested: DataFrame, found: DataFrame, computed: DataFrame, by: Sequence[str] = ("run", "variable")) -> DataFrame:
    """(by, vif, kind): the inflation of each requested or found variable of a run, from the run's own table if it has it, else
    computed; kind is table, computed or missing."""
    keys = requested.select(*by).unionByName(found.select(*by)).distinct()
    own, made = found.groupBy(*by).agg(F.max("vif").alias("__t")), computed.groupBy(*by).agg(F.max("vif").alias("__c"))
    both = keys.join(own, list(by), "left").join(made, list(by), "left")
    return both.select(*by, F.coalesce("__t", "__c").alias("vif"), F.when(F.col("__t").isNotNull(), "table").when(F.col("__c").isNotNull(), "computed").otherwise("missing").alias("kind"))


def issues(rows: DataFrame, by: str, issue: Column) -> DataFrame:
    """(by, n, issues): the distinct issues of each, in order, in one text; rows of null issue have none."""
    i = rows.select(by, issue.alias("__i")).filter(F.col("__i").isNotNull()).distinct()
    return i.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("__i")), " | ").alias("issues"))


def best_test(runs: DataFrame, by: str, tie: str, spearman: str = "cbi_spearman", pearson: str = "cbi_pearson") -> DataFrame:
    """(by, tie, auc, cbi): the test row of largest AUC of each, its cbi being Spearman's or else Pearson's."""
    t = top_row(runs.filter(folded("split") == "test"), [by], "auc", [tie])
    return t.select(by, tie, "auc", F.coalesce(spearman, pearson).alias("cbi"))


def shared(records: DataFrame, of: str, values: Sequence, name: str) -> DataFrame:
    """The names that occur with every one of the values."""
    return records.filter(F.col(of).isin(*values)).groupBy(name).agg(F.countDistinct(of).alias("__n")).filter(F.col("__n") == len(set(values))).select(name)


def paired(runs: DataFrame, by: Sequence[str], side: str, sides: dict[str, str], value: str) -> DataFrame:
    """(by, kind, value): the mean of each of two sides and their difference (second less first), for groups that have both.

    sides: name in the result -> value of the column."""
    (a, x), (b, y) = sides.items()
    g = runs.groupBy(*by).agg(*[F.avg(F.when(F.col(side) == v, F.col(value))).alias(n) for n, v in ((a, x), (b, y))]).dropna(subset=[a, b])
    return g.withColumn("difference", F.col(b) - F.col(a)).unpivot(list(by), [a, b, "difference"], "kind", value)


def unordered_pairs(names: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b) of all pairs a < b of the distinct names of a group; a group is a list of predictors, not of rows."""
    g = names.select(*by, name).dropna().distinct().groupBy(*by).agg(F.array_sort(F.collect_set(name)).alias("__l"))
    a = g.select(*by, "__l", F.posexplode("__l").alias("__i", "a"))
    return a.select(*by, "a", F.explode(F.slice("__l", F.col("__i") + 2, F.size("__l"))).alias("b"))


def placed_by(rows: DataFrame, name: str, order: Sequence[str], last: int = 99) -> DataFrame:
    """Adds place, from 1 in the given order; names not in it come `last`."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name))
    return rows.withColumn("place", F.when(at > 0, at).otherwise(last).cast("int"))


def level_targets(points: DataFrame, by: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """(level, by, n, target): how many of each group's points a level keeps, at least one, at most all."""
    n = points.groupBy(*by).agg(F.count("*").alias("n"))
    at = n.select(F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"), *by, "n")
    return at.withColumn("target", F.least("n", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("level")))))


def expected(rows: DataFrame, lists: dict[str, Sequence], *names: str) -> DataFrame:
    """Every combination of the distinct values of `names` in rows with the values of the lists, laid out by explode; names and lists
    are few values each."""
    sets = rows.agg(*[F.collect_set(n).alias(n) for n in names])
    for n in names:
        sets = sets.withColumn(n, F.explode(n))
    for n, values in lists.items():
        sets = sets.withColumn(n, F.explode(F.array(*[F.lit(v) for v in values])))
    return sets


def indexed(runs: DataFrame, wanted: DataFrame, keys: Sequence[str], path: str, sound: Column) -> DataFrame:
    """wanted with the last path of the sound runs of the same keys, null where there is none."""
    last = runs.filter(sound).groupBy(*keys).agg(F.max(path).alias("path"))
    return wanted.select(*keys).join(last, list(keys), "left")


def paired_flags(runs: DataFrame, by: str, side: str, sides: dict[str, str], flag: Column) -> DataFrame:
    """(by, one column a side, matched): whether any run of each side has the flag, and whether both sides agree."""
    f = runs.groupBy(by).agg(*[F.max(F.when(F.col(side) == v, flag)).alias(n) for n, v in sides.items()])
    a, b = sides
    return f.withColumn("matched", F.col(a) == F.col(b))


def dataset_pairs(runs: DataFrame, by: str, mono: Column, multi: Column, rank: Sequence[Column | str], name: str) -> DataFrame:
    """(by, mono, multi): of each dataset the first-ranked run on either side, for those that have both."""
    first = lambda c, n: top_first(runs.filter(c), [by], rank).select(by, F.col(name).alias(n))
    return first(mono, "mono").join(first(multi, "multi"), by)


def top_first(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each group by a total order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def classified(rows: DataFrame, rules: Sequence[tuple[str, str, str, str]], rest: str = "review") -> DataFrame:
    """Adds class by the first rule (column, how, value, class) that holds, how being equals, begins or contains."""
    out = F.lit(rest)
    tests = {"equals": lambda c, v: F.col(c) == v, "begins": lambda c, v: F.startswith(c, F.lit(v)), "contains": lambda c, v: F.contains(c, F.lit(v))}
    for column, how, value, name in reversed(list(rules)):
        out = F.when(tests[how](F.col(column) if how != "equals" else column, value), name).otherwise(out)
    return rows.withColumn("class", out)


def statuses(wanted: DataFrame, made: DataFrame, name: str, skipped: Sequence[str] = ()) -> DataFrame:
    """(name, n, status) of each wanted artifact: generated if there are rows of it, skipped if it was to be, else missing."""
    n = made.groupBy(name).agg(F.count("*").alias("n"))
    s = F.when(F.col("n") > 0, "generated").when(F.col(name).isin(*skipped) if skipped else F.lit(False), "skipped").otherwise("missing")
    return wanted.select(name).distinct().join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), s.alias("status"))


def objective(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Adds total and mean of the metrics, unknown ones counting as 0."""
    t = F.lit(0.0)
    for m in metrics:
        t = t + F.coalesce(F.nanvl(m, F.lit(0.0)), F.lit(0.0))
    return runs.withColumns({"total": t, "mean": t / len(metrics)})


def sole(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """The distinct values that match the pattern regardless of case, of which there must be one, else the result is an error."""
    v = rows.select(column).filter(F.lower(column).rlike(pattern)).distinct()
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    return v.withColumn("__n", n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.col("__n").cast("string"), F.lit(f" values match {pattern}"))).isNull())).drop("__n")


def audited(runs: DataFrame, by: str, engine: str, year: str, wanted: Sequence[int], sound: Column) -> DataFrame:
    """(by, years, missing, maps, issues) of each scenario: its years, wanted years it lacks, sound maps by engine (a map), and
    its issues in order: missing years, engines without a map, unsound runs."""
    g = runs.groupBy(by).agg(F.array_sort(F.collect_set(year)).alias("years"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound"))
    maps = runs.groupBy(by, engine).agg(F.count_if(sound).alias("m")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(engine, "m")))).alias("maps"))
    g = g.join(maps, by).withColumn("missing", F.array_except(F.array(*[F.lit(y) for y in wanted]), "years"))
    none = F.map_keys(F.map_filter("maps", lambda _, n: n == 0))
    told = F.array(
        F.when(F.size("missing") > 0, F.concat(F.lit("missing years: "), F.array_join("missing", ", "))),
        F.when(F.size(none) > 0, F.concat(F.lit("no maps: "), F.array_join(none, ", "))),
        F.when(F.col("unsound") > 0, F.concat(F.col("unsound").cast("string"), F.lit(" unsound runs"))),
    )
    return g.select(by, "years", "missing", "maps", F.array_join(F.array_compact(told), " | ").alias("issues"))


def preflight(records: DataFrame, by: Sequence[str], name: str, wanted: DataFrame) -> DataFrame:
    """(by, n, removed, passed) of each run: the predictors its records have, those of `wanted` (one column, a list that is a
    parameter) they lack, and whether none is lacking."""
    have = records.groupBy(*by).agg(F.collect_set(name).alias("__v"))
    want = wanted.agg(F.array_sort(F.collect_set(name)).alias("__w"))
    h = have.join(F.broadcast(want)).withColumn("removed", F.array_except("__w", "__v"))
    return h.select(*by, F.size("__v").cast("bigint").alias("n"), "removed", (F.size("removed") == 0).alias("passed"))


def engines(rows: DataFrame, engine: Column, order: str) -> DataFrame:
    """(engine, place): the distinct engines in order, gbm first, then by first appearance; null (an unknown one) is an error."""
    known = F.when(engine.isNotNull(), engine).otherwise(F.raise_error(F.lit("unknown engine")).cast("string"))
    e = rows.select(known.alias("engine"), order).groupBy("engine").agg(F.min(order).alias("__o"))
    return e.select("engine", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("engine") != "gbm", "__o", "engine")).alias("place"))


def fronted(rows: DataFrame, name: str, order: str, preferred: Sequence[str]) -> DataFrame:
    """(name, place): the distinct names, the preferred ones first in their order, then by first appearance."""
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(name))
    one = rows.groupBy(name).agg(F.min(order).alias("__o")).withColumn("__p", F.when(at > 0, at).otherwise(len(preferred) + 1))
    return one.select(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy("__p", "__o", name)).alias("place"))


def chosen_specs(specs: DataFrame, enabled: str, kind: str, barred: Sequence[str], place: str, last: int = 999) -> DataFrame:
    """The enabled specifications of no barred kind, by place; those without a place come `last`."""
    kept = specs.filter(F.col(enabled) & ~F.col(kind).isin(*barred)).withColumn(place, F.coalesce(place, F.lit(last)))
    return kept.orderBy(place)


def validation_of_best(runs: DataFrame, by: Sequence[str], year: str, score: str, tie: str) -> DataFrame:
    """(by, year, test, validation): the best test score of each, and the best validation score of the same year, if any."""
    t = top_row(runs.filter(folded("split") == "test"), list(by), score, [tie])
    v = runs.filter(folded("split") == "validation").groupBy(*by, year).agg(F.max(score).alias("validation"))
    return t.select(*by, year, F.col(score).alias("test")).join(v, [*by, year], "left")


def with_inflation(importance: DataFrame, inflation: DataFrame, keys: Sequence[str], vif: str = "vif") -> DataFrame:
    """importance with the largest inflation of the same keys, null where there is none."""
    return importance.join(inflation.groupBy(*keys).agg(F.max(vif).alias(vif)), list(keys), "left")


def extremes(runs: DataFrame, by: str, year: str, score: str, low: float) -> DataFrame:
    """(by, worst, best, low, spread): the years of lowest and highest mean score (the earlier of equal ones), years below
    `low`, and how far the means are apart."""
    b = runs.groupBy(by, year).agg(F.avg(score).alias("__s"))
    return b.groupBy(by).agg(F.min_by(year, F.struct("__s", year)).alias("worst"), F.max_by(year, F.struct("__s", (-F.col(year)).alias("y"))).alias("best"), F.count_if(F.col("__s") < low).alias("low"), (F.max("__s") - F.min("__s")).alias("spread"))


def top_differences(rows: DataFrame, difference: str, name: str, n: int) -> DataFrame:
    """The n rows of largest absolute difference (to 12 decimals), then by name."""
    return rows.filter(F.col(difference).isNotNull()).orderBy(F.desc(F.round(F.abs(difference), 12)), name).limit(n)


def compared(records: DataFrame, name: str, run: str, a, b, value: str, vif: str) -> DataFrame:
    """(name, mean_a, mean_b, percent, vif_a, vif_b) of the names that both runs have."""
    w = welch(records, [name], run, a, b, value).select(name, "mean_a", "mean_b", "percent")
    v = records.groupBy(name).agg(*[F.avg(F.when(F.col(run) == r, F.col(vif))).alias(n) for n, r in (("vif_a", a), ("vif_b", b))])
    return w.join(v, name)
