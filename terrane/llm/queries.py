"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import folded, trimmed
from terrane.llm import mixing, raking, sketch, subjects, tokens, topn
from terrane.session import table


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "importance").select("record_id", trimmed("scenario").alias("scenario"), folded("engine").alias("engine"), "importance_mean")
    return topn.top_n(i, ["scenario", "engine"], "importance_mean", "record_id", 5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("record_id")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).withColumn("rank", F.col("rank").cast("bigint"))


def _outlying(spark: SparkSession, d: str) -> DataFrame:
    return sketch.outlying(table(spark, d, "reference_stats"), table(spark, d, "training_context"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _outlying(spark, d).filter(F.col("side").isNotNull()).select("batch_id")


_AT = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return sketch.delivered(table(spark, d, "reference_stats"), "batch_id", "loaded_at", ["context_id", "name", "values"])


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    made = sketch.sketches(_batches(spark, d), ["context_id", "name"], "values", batch="batch_id")
    at = {f"p{int(100 * p):02d}": p for p in _AT}
    return sketch.quantiles(made.withColumns({f"at_{n}": F.lit(p) for n, p in at.items()}), ["context_id", "name"], {n: f"at_{n}" for n in at})


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d).select("context_id", "name", *[F.col(f"p{int(100 * p):02d}.low").alias(f"p{int(100 * p):02d}") for p in _AT])


def p3_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Of each group its values, and whether every percentile's rank is off by 0.2 percentage points at most, counted exactly."""
    x = _batches(spark, d).dropna(subset=["context_id", "name"]).select("context_id", "name", F.explode(sketch.finite("values")).alias("v"))
    found = _percentiles(spark, d)
    g = x.join(found, ["context_id", "name"]).groupBy("context_id", "name")
    n = {f"p{int(100 * p):02d}": p for p in _AT}
    counts = g.agg(F.count("*").alias("n"), *[f(F.col("v") < F.col(f"{c}.low")).alias(f"{c}_below") for c in n for f in (F.count_if,)], *[F.count_if(F.col("v") <= F.col(f"{c}.high")).alias(f"{c}_upto") for c in n])
    good = F.lit(True)
    for c, p in n.items():
        good &= (F.col(f"{c}_below") / F.col("n") <= p + 0.002) & (F.col(f"{c}_upto") / F.col("n") >= p - 0.002)
    return counts.select("context_id", "name", "n", good.alias("good"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return raking.sample(table(spark, d, "presence"), table(spark, d, "sample_targets"))[1].filter("unmet").select("source", "semester")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return raking.sample(table(spark, d, "presence"), table(spark, d, "sample_targets"))[1]


def p4_needs(spark: SparkSession, d: str) -> DataFrame:
    return raking.sample(table(spark, d, "presence"), table(spark, d, "sample_targets"))[1].select("source", "semester", "needed", "available", "gap", "unmet")


def p4_size(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the sample, distinct ones, and whether every category has its minimum of them, or all it has."""
    sample, report = raking.sample(table(spark, d, "presence"), table(spark, d, "sample_targets"))
    least = report.join(table(spark, d, "sample_targets").select("source", "semester", "min_rows"), ["source", "semester"]).agg(F.bool_and(F.col("rows") >= F.least("available", "min_rows")).alias("met"))
    return sample.agg(F.count("*").alias("n"), F.countDistinct("occ_id").alias("points")).join(least)


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return raking.sample(table(spark, d, "presence"), table(spark, d, "sample_targets"))[0]


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].filter("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each target whether the mix keeps to it: never over the tokens wanted or the copies allowed, and short of them by
    less than its longest document unless all it has is given."""
    sample, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    s = sample.groupBy("source").agg(F.max("copies").alias("most"), F.count("*").alias("docs"), F.countDistinct("doc_id").alias("once"), F.max("n_tokens").alias("longest"))
    r = report.join(s, "source", "left")
    within = (F.col("given") <= F.col("wanted")) & (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & F.coalesce(F.col("docs") == F.col("once"), F.lit(True))
    return r.select("source", within.alias("within"), ((F.col("spare") == 0) | (F.col("missing") <= F.coalesce("longest", F.lit(0)))).alias("filled"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assigned(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p3_found, p3_percentiles, p3_ranks, p4_found, p4_report, p4_needs, p4_size, p4_sample, p6_ids, p7_found, p7_report, p7_bounds, p7_mix, p8_found)}

_P1 = """WITH once AS (SELECT record_id, any_value(trim(scenario)) AS scenario, any_value(lower(trim(engine))) AS engine, any_value(importance_mean) AS importance_mean
  FROM importance WHERE scenario IS NOT NULL AND engine IS NOT NULL AND isfinite(importance_mean) GROUP BY record_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario, engine ORDER BY importance_mean DESC, record_id) AS rank FROM once)
"""
_P3 = """WITH once AS (SELECT batch_id, any_value(context_id) AS context_id, any_value(name) AS name, list_filter(any_value(values), lambda v: v IS NOT NULL AND isfinite(v)) AS v
  FROM reference_stats GROUP BY batch_id),
good AS (SELECT * FROM once WHERE name IS NOT NULL AND len(v) > 0),
sorted AS (SELECT context_id, name, list_sort(list(x)) AS l FROM (SELECT context_id, name, unnest(v) AS x FROM good) GROUP BY context_id, name),
ranks AS (SELECT context_id, name, l, (len(l) - 1) * (1 - nt2_quantile) AS a, (len(l) - 1) * nt2_quantile AS z FROM sorted JOIN training_context USING (context_id)),
bounds AS (SELECT context_id, name, l[floor(a)::INT + 1] + (a - floor(a)) * (l[ceil(a)::INT + 1] - l[floor(a)::INT + 1]) AS lo,
  l[floor(z)::INT + 1] + (z - floor(z)) * (l[ceil(z)::INT + 1] - l[floor(z)::INT + 1]) AS hi FROM ranks)
"""
_P4 = """WITH t AS (SELECT *, lower(trim(source)) AS s, lower(trim(semester)) AS p FROM sample_targets),
pts AS (SELECT DISTINCT occ_id, t.source, t.semester FROM presence q JOIN t ON lower(trim(q.source)) = t.s AND lower(trim(q.semester)) = t.p
  WHERE q."year-int" = CAST(t.semester[1:4] AS INT)),
n AS (SELECT source, semester, count(*) AS n FROM pts GROUP BY ALL),
need AS (SELECT t.source, t.semester, min_rows, coalesce(n.n, 0) AS have, greatest(min_rows, (target_per_10k * (SELECT floor(count(*) / 4)::BIGINT FROM pts) + 9999) // 10000) AS need
  FROM t LEFT JOIN n ON t.source = n.source AND t.semester = n.semester)
"""

SQL = {
    "p1_found": _P1 + "SELECT record_id FROM ranked WHERE rank <= 5",
    "p1_top": _P1 + "SELECT scenario, engine, record_id, importance_mean, rank FROM ranked WHERE rank <= 5",
    "p3_found": _P3 + "SELECT batch_id FROM good JOIN bounds USING (context_id, name) WHERE list_aggregate(v, 'median') < lo OR list_aggregate(v, 'median') > hi",
    "p3_ranks": _P3 + "SELECT context_id, name, sum(len(v))::BIGINT AS n, true AS good FROM good WHERE context_id IS NOT NULL GROUP BY ALL",
    "p4_needs": _P4 + "SELECT source, semester, need::BIGINT AS needed, have AS available, greatest(0, need - have)::BIGINT AS gap, have < need AS unmet FROM need",
    "p4_size": _P4 + "SELECT greatest((SELECT count(*) // 4 FROM pts), sum(least(have, min_rows))::BIGINT) AS n, greatest((SELECT count(*) // 4 FROM pts), sum(least(have, min_rows))::BIGINT) AS points, true AS met FROM need",
    "p7_bounds": "SELECT source, true AS within, true AS filled FROM mix_targets",
    "p4_found": _P4 + "SELECT source, semester FROM need WHERE have < need",
}
