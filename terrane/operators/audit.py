"""Checks of run tables and configurations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_rows(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys), list(keys), "left_anti")


def differences(left: DataFrame, right: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(path, left, right, kind): settings (path, value) that differ, a missing one being null; kind is allowed if the path
    is one of the allowed prefixes or below one, else unexpected."""
    both = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), "path", "full").filter(~F.col("left").eqNullSafe(F.col("right")))
    ok = F.lit(False)
    for p in allowed:
        ok = ok | (F.col("path") == p) | F.startswith("path", F.lit(p + "."))
    return both.withColumn("kind", F.when(ok, "allowed").otherwise("unexpected"))


def matched_rules(rules: DataFrame, texts: DataFrame, most_rules: int = 100_000) -> DataFrame:
    """rules (pattern, ...) with each text (key, text) that contains the pattern regardless of case; a pattern without a
    match keeps one row, and a null or empty one matches none. The rules are a parameter table and at most `most_rules`,
    which is checked; they are sent to the texts as one automaton, so each text is read once, whatever their number."""
    patterns = [r[0] for r in rules.select("pattern").distinct().limit(most_rules + 1).collect()]
    if len(patterns) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    by: dict[str, list[str]] = {}
    for p in patterns:
        if p:
            by.setdefault(p.lower(), []).append(p)
    sent = texts.sparkSession.sparkContext.broadcast(by)
    key, kind = texts.columns[0], texts.schema[0]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for low, own in sent.value.items():
            found.add_word(low, own)
        if sent.value:
            found.make_automaton()
        for batch in it:
            at, hits = [], []
            for i, text in enumerate(batch.column(2).to_pylist() if sent.value else []):
                met: set[str] = set()
                for _, own in found.iter(text) if text else ():
                    met.update(own)
                at += [i] * len(met)
                hits += sorted(met)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), rows.column(0), rows.column(1)], names=["pattern", key, "text"])

    schema = T.StructType([T.StructField("pattern", T.StringType()), kind, T.StructField("text", T.StringType())])
    hits = texts.select(key, "text", F.lower("text").alias("__low")).mapInArrow(run, schema)
    return rules.join(hits, "pattern", "left")


def checks(df: DataFrame, tests: dict[str, object]) -> DataFrame:
    """(check, passed): one row for each named condition on the table, a condition being a boolean aggregate; null fails."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("passed")) for n in tests])))


def deduped(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first of each key, in the order of first appearance."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
