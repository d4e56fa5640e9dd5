"""Fitting and scoring of presence against background, importance, response, folds by clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.hashing import uniform
from terrane.operators.metrics import boyce_index, roc_auc
from terrane.operators.stats import exact_percentiles
from terrane.session import staged


def stacked(presence: DataFrame, background: DataFrame) -> DataFrame:
    """Both with y 1 and 0, columns matched by name."""
    return presence.withColumn("y", F.lit(1)).unionByName(background.withColumn("y", F.lit(0)), allowMissingColumns=True)


def imputed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN values replaced by the column's mean, 0 if it has none. The means are joined, not windowed."""
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    means = df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"__m_{c}") for c, v in known.items()])
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(v, F.col(f"__m_{c}")) for c, v in known.items()}).drop(*[f"__m_{c}" for c in columns])


def hinges(df: DataFrame, columns: Sequence[str], knots: int) -> SQLTransformer:
    """A stage that adds hinge features of each column, forward and reverse, at inner percentiles (approximate, one pass);
    each is scaled to [0, 1] between its knot and the column's end."""
    at = [k / (knots + 1) for k in range(1, knots + 1)]
    row = df.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double"), F.percentile_approx(c, at)).alias(c) for c in columns]).first()
    made = []
    for c in columns:
        low, high, cuts = row[c]
        for k in sorted({float(x) for x in cuts or []} - {low, high}):
            made.append(f"greatest(0D, `{c}` - {k!r}D) / {high - k!r}D AS `__h{len(made)}`")
            made.append(f"greatest(0D, {k!r}D - `{c}`) / {k - low!r}D AS `__h{len(made)}`")
    return SQLTransformer(statement="SELECT *" + "".join(f", {m}" for m in made) + " FROM __THIS__")


def fit_maxent(df: DataFrame, columns: Sequence[str], weight: str | None = None, beta: float = 1.0, product: bool = True, features: Sequence[str] | None = None, knots: int = 8, background: float = 100.0) -> PipelineModel:
    """A penalised logistic model of presence (y = 1) against background in which each background row weighs `background`
    times as much (and `weight` times its own weight): with growing weight this is the point-process form of maximum
    entropy, the background standing for its normaliser.

    features: any of linear, quadratic, product and hinge; quadratic and product come together as the second-degree
    expansion (product=False is short for linear alone). If the wanted features can't be fitted, linear ones are tried.
    beta scales the penalty. It is an equivalent capability and gives no other implementation's numbers.
    """
    wanted = tuple(features) if features is not None else (("linear", "quadratic", "product") if product else ("linear",))
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.withColumn("__w", F.when(F.col("y") == 1, own).otherwise(own * background))

    def fitted(kinds: tuple[str, ...]) -> PipelineModel:
        stages = [VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True)]
        parts = ["__z"]
        if {"quadratic", "product"} & set(kinds):
            stages.append(PolynomialExpansion(degree=2, inputCol="__z", outputCol="__f"))
            parts = ["__f"]
        if "hinge" in kinds:
            bent = hinges(df, columns, knots)
            stages.append(bent)
            parts += [f"__h{i}" for i in range(bent.getStatement().count("AS `__h"))]
        if parts != ["__z"] and len(parts) > 1:
            stages.append(VectorAssembler(inputCols=parts, outputCol="__all"))
            parts = ["__all"]
        stages.append(LogisticRegression(featuresCol=parts[0], labelCol="y", elasticNetParam=1.0, regParam=0.001 * beta, maxIter=50, weightCol="__w"))
        return Pipeline(stages=stages).fit(rows)

    try:
        return fitted(wanted)
    except (IllegalArgumentException, AnalysisException, ValueError):
        if wanted == ("linear",):
            raise
        return fitted(("linear",))


def fit_trees(df: DataFrame, columns: Sequence[str], weight: str | None = None, validation: str | None = None, rounds: int = 20, seed: int = 1) -> PipelineModel:
    """Gradient-boosted trees with early stopping on rows whose `validation` is true."""
    gbt = GBTClassifier(featuresCol="__x", labelCol="y", maxIter=rounds, maxDepth=4, seed=seed, **({"weightCol": weight} if weight else {}), **({"validationIndicatorCol": validation} if validation else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip"), gbt]).fit(df)


def scored(model: PipelineModel, df: DataFrame, cloglog: bool = False) -> DataFrame:
    """df with s, the probability of presence (cloglog: 1 - exp(-exp(raw)))."""
    out = model.transform(df)
    raw = vector_to_array("rawPrediction")[1]
    s = 1 - F.exp(-F.exp(raw)) if cloglog else vector_to_array("probability")[1]
    return out.select(*df.columns, s.alias("s"), raw.alias("margin"))


def calibrated(train: DataFrame, df: DataFrame) -> DataFrame:
    """df with its score replaced by a logistic function of the margin, fitted on (y, margin) of train."""
    model = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="__m"), LogisticRegression(featuresCol="__m", labelCol="y")]).fit(train.select("y", "margin"))
    out = model.transform(df.drop("s"))
    return out.select(*[c for c in df.columns if c != "s"], vector_to_array("probability")[1].alias("s"))


def gains(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Importance as the trees report it, the largest first, by name if equal."""
    return sorted(zip(columns, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def permutation_importance(df: DataFrame, columns: Sequence[str], key: str, score: Callable[[DataFrame], DataFrame], repeats: int = 5, seed: int = 1, ddof: int = 0, draw: Callable[[int], Column] | None = None, block: Column | None = None, blocks: int = 1024) -> DataFrame:
    """(variable, mean, std): fall of the AUC when a column's values are exchanged among rows, over repeats; std with ddof 0
    or 1.

    Rows are dealt into blocks by `block` (a hash of the key, unless given) and exchanged within a block in the order of
    draw(seed + repeat), a hash of the key unless given; every value stays in use exactly as often as before. All columns
    and repeats are exchanged, scored and measured in one pass.
    """
    rows = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)) if block is None else block)
    base = roc_auc(score(df)).withColumnRenamed("auc", "base")
    mine = F.row_number().over(W.partitionBy("__b").orderBy(key))
    told = F.array(*[F.lit(c) for c in columns])
    a = rows.withColumn("__r", mine).withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("variable", F.explode(told))
    draws = [draw(seed + r) if draw else uniform(key, seed=seed + r) for r in range(repeats)]
    long = rows.select("__b", F.col(key).alias("__k"), F.posexplode(F.array(*draws)).alias("__t", "__d"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)])
    # the order of a repeat is the same for all columns, so it is taken once and all columns' values come with it
    b = long.withColumn("__r", F.row_number().over(W.partitionBy("__b", "__t").orderBy("__d", "__k"))).drop("__k", "__d")
    both = a.join(b, ["__b", "__t", "__r"])
    changed = both.withColumns({c: F.when(F.col("variable") == c, F.col(f"__c{i}")).otherwise(F.col(c).cast("double")) for i, c in enumerate(columns)}).drop(*[f"__c{i}" for i in range(len(columns))], "__b", "__r")
    d = roc_auc(score(changed), ["variable", "__t"]).join(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("auc"))
    return d.groupBy("variable").agg(F.avg("drop").alias("mean"), (F.stddev_pop if ddof == 0 else F.stddev_samp)("drop").alias("std"))


def response_grid(df: DataFrame, columns: Sequence[str], steps: int = 50) -> DataFrame:
    """(variable, step, columns...): each column from its smallest to its largest value in steps, the others at their
    medians."""
    medians = exact_percentiles(df, {c: (c, 0.5) for c in columns})
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).withColumns({f"med_{c}": F.lit(medians[c]).cast("double") for c in columns})
    grid = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).select("*", F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable"))
    at = lambda c: F.when(F.col("variable") == c, F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * F.col("step") / (steps - 1)).otherwise(F.col(f"med_{c}"))
    return grid.select("variable", "step", *[at(c).alias(c) for c in columns])


def cluster_folds(df: DataFrame, columns: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """Adds fold 0..k-1 by k-means of the columns; rows in which one is unknown get -1 and are always trained on."""
    known = df.dropna(subset=list(columns))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="__x"), KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="fold")]).fit(known)
    rest = df.filter(" or ".join(f"`{c}` is null" for c in columns)).withColumn("fold", F.lit(-1))
    return model.transform(known).drop("__x").unionByName(rest)


def jackknife(train: DataFrame, test: DataFrame, columns: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], PipelineModel]) -> DataFrame:
    """(variable, kind, auc): the test AUC of models with only a variable and without it."""
    out = None
    for c in columns:
        for kind, use in (("only", [c]), ("without", [x for x in columns if x != c])):
            if use:
                one = roc_auc(scored(fit(train, use), test)).select(F.lit(c).alias("variable"), F.lit(kind).alias("kind"), "auc")
                out = one if out is None else out.unionByName(one)
    return out


def best_setting(train: DataFrame, test: DataFrame, settings: Sequence[dict], fit: Callable[..., PipelineModel], keep: int = 1) -> list[tuple[float, dict]]:
    """(AUC, setting) of the best settings, each fitted on train and judged on a validation part."""
    tried = [(roc_auc(scored(fit(train, **s), test)).first().auc, s) for s in settings]
    return sorted(tried, key=lambda x: (-(x[0] if x[0] is not None else -1.0), str(x[1])))[:keep]


def cross_validated(presence: DataFrame, background: DataFrame, folds: dict[str, DataFrame], key: str, fit: Callable[[DataFrame], PipelineModel], threshold: float = 0.5, bins: int = 25) -> DataFrame:
    """(method, fold, auc, cbi, omission) of each fold of each method, and a row of fold `mean` with the means of the known
    values.

    folds: method -> (key, fold) of the presences. In a fold, the model is fitted on the other folds' presences (those of
    fold -1 always among them) and all background, and judged on the fold's presences and all background; cbi is Spearman's, omission the
    share of its presences below the threshold. A fold of a single class, or without training presences, has nulls. Fits
    run one after another, as each uses the whole cluster; the scores of all folds are written once and measured together.
    """
    spark = presence.sparkSession
    negative = background.withColumn("y", F.lit(0))
    parts, names = None, []
    for method, of in folds.items():
        labelled = presence.join(of.select(key, F.col("fold").cast("string").alias("__fold")), key)
        for f in sorted(r[0] for r in of.select(F.col("fold").cast("string")).distinct().collect() if r[0] not in (None, "-1")):
            names.append((method, f))
            test = labelled.filter(F.col("__fold") == f).drop("__fold").withColumn("y", F.lit(1))
            train = stacked(labelled.filter(F.col("__fold") != f).drop("__fold"), background)
            if train.filter("y = 1").isEmpty():
                continue
            s = staged(scored(fit(train), test.unionByName(negative, allowMissingColumns=True)).select(F.lit(method).alias("method"), F.lit(f).alias("fold"), "y", "s"))
            parts = s if parts is None else parts.unionByName(s)
    all_ = spark.createDataFrame(names, "method string, fold string")
    if parts is None:
        parts = all_.selectExpr("method", "fold", "0 as y", "cast(null as double) as s").limit(0)
    by = ["method", "fold"]
    up = F.avg(F.when((F.col("y") == 1) & ~F.isnan("s"), F.when(F.col("s") < threshold, 1.0).otherwise(0.0))).alias("omission")
    each = roc_auc(parts, by).join(boyce_index(parts, bins, by).select(*by, F.col("cbi_spearman").alias("cbi")), by, "left").join(parts.groupBy(*by).agg(up), by, "left")
    each = each.withColumns({c: F.when(F.col("auc").isNotNull(), F.col(c)) for c in ("cbi", "omission")})
    each = all_.join(each, by, "left")
    mean = each.groupBy("method").agg(*[F.avg(c).alias(c) for c in ("auc", "cbi", "omission")]).withColumn("fold", F.lit("mean"))
    return each.unionByName(mean)


def _suggested(spec: dict, rng: np.random.Generator, seen: list[tuple[float, object]]) -> object:
    """A value of one setting: drawn evenly from its space or, once there are results (score, value), drawn near those of the
    best quarter and kept if it is likelier among these than among the rest."""
    if "choices" in spec:
        options = list(spec["choices"])
        odds = np.ones(len(options))
        for _, v in sorted(seen, key=lambda x: -x[0])[: max(1, len(seen) // 4)] if seen else []:
            odds[options.index(v)] += len(options)
        return options[int(rng.choice(len(options), p=odds / odds.sum()))]
    low, high, log = float(spec["low"]), float(spec["high"]), spec.get("log", False)
    to, back = (np.log, np.exp) if log else (float, float)
    a, z = to(low), to(high)
    if seen:
        ranked = [to(v) for _, v in sorted(seen, key=lambda x: -x[0])]
        good, rest = ranked[: max(1, len(ranked) // 4)], ranked[max(1, len(ranked) // 4) :] or [(a + z) / 2]
        wide = max(float(np.ptp(good)), (z - a) / (len(ranked) + 1)) or 1e-12
        near = lambda x, of: np.mean([np.exp(-0.5 * ((x - o) / wide) ** 2) for o in of]) + 1e-6
        tries = [t for t in (float(rng.normal(good[int(rng.integers(len(good)))], wide)) for _ in range(24)) if a <= t <= z]
        # one in four is drawn evenly, so that the search doesn't stay where it began
        x = max(tries, key=lambda t: near(t, good) / near(t, rest)) if tries and rng.random() >= 0.25 else float(rng.uniform(a, z))
    else:
        x = float(rng.uniform(a, z))
    v = float(np.clip(back(x), low, high))
    step = spec.get("step") or (1 if spec.get("dtype") == "int" or (isinstance(spec["low"], int) and isinstance(spec["high"], int) and not log) else None)
    if step:
        v = float(min(high, low + round((v - low) / step) * step))
    return int(round(v)) if isinstance(step, int) else v


def search(space: dict[str, dict], objective: Callable[[dict, Callable[[int, float], None]], float], trials: int, seed: int = 1, enqueued: Sequence[dict] = (), startup: int = 5, maximise: bool = True) -> list[dict]:
    """The log of a search for settings: number, state (COMPLETE, PRUNED, FAIL), value, and the settings of each trial.

    space: name -> {choices} or {low, high} with step, log or dtype int. Trials enqueued are run first, the next ones are
    drawn evenly until `startup` have ended, and then near the best so far. objective(settings, report) returns the value;
    report(step, value) ends a trial whose value is worse than the median of the ended trials at that step. A trial that
    raises or gives no number has failed, and the search goes on.
    """
    rng, log, sign = np.random.default_rng(seed), [], 1.0 if maximise else -1.0
    steps: dict[int, list[float]] = {}
    for number in range(trials):
        ended = [t for t in log if t["state"] == "COMPLETE"]
        if number < len(enqueued):
            own = dict(enqueued[number])
        else:
            own = {n: _suggested(spec, rng, [(sign * t["value"], t[n]) for t in ended if n in t] if len(ended) >= startup else []) for n, spec in space.items()}
        told: dict[int, float] = {}

        def report(step: int, value: float, told: dict[int, float] = told) -> None:
            told[step] = sign * value
            before = steps.get(step, [])
            if len(before) >= startup and told[step] < float(np.median(before)):
                raise _Pruned

        try:
            value, state = float(objective(own, report)), "COMPLETE"
            if np.isnan(value):
                value, state = None, "FAIL"
        except _Pruned:
            value, state = None, "PRUNED"
        except Exception:  # noqa: BLE001
            value, state = None, "FAIL"
        if state == "COMPLETE":
            for k, v in told.items():
                steps.setdefault(k, []).append(v)
        log.append({"number": number, "state": state, "value": value, **own})
    return log


class _Pruned(Exception):
    pass


def best_trial(log: Sequence[dict], maximise: bool = True) -> dict | None:
    """The complete trial of best value, the first of equal ones."""
    done = [t for t in log if t["state"] == "COMPLETE"]
    return max(done, key=lambda t: ((1 if maximise else -1) * t["value"], -t["number"])) if done else None


def parameters(model: PipelineModel) -> int:
    """Coefficients other than 0 and the intercept of a fitted logistic model; trees count their nodes."""
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        return int((last.coefficients.toArray() != 0).sum()) + 1
    return int(getattr(last, "totalNumNodes", 1))


def fitted_names(model: PipelineModel) -> list[str]:
    """The predictors a model was fitted on, in order."""
    return list(next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols())
