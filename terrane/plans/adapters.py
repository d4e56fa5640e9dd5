"""The test tables seen as points, masks, layer stacks, scores and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.grid import STUDY, Grid
from terrane.session import table

#: Columns of the grid that points and layers lie on, and parts to a row of it: rows grow with the tables.
COLS, PARTS_A_ROW = 1000, 20


def hashed(c: Column | str, seed: int = 0, modulus: int = 1000003) -> Column:
    """A whole number below modulus from an id, which any SQL engine gives alike."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("bigint") * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(modulus)


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, year, season, source, quantity): one point for each row of lineitem, labelled by season."""
    l = table(spark, d, "lineitem")
    month = F.month("l_shipdate")
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.lit(91000.0) + (F.col("l_suppkey") % COLS) * 1000 + F.col("l_linenumber") * 100).alias("x"),
        (F.lit(STUDY.top) - F.expr(f"l_partkey div {PARTS_A_ROW}") * 1000 - 500).alias("y"),
        F.when(month <= 2, F.year("l_shipdate") - 1).otherwise(F.year("l_shipdate")).alias("year"),
        F.when(month.between(3, 8), "Summer").otherwise("Winter").alias("season"),
        F.when(F.col("l_returnflag") == "A", "GBIF").when(F.col("l_returnflag") == "N", "RRN").otherwise("SNCF").alias("source"),
        F.col("l_quantity").alias("quantity"),
    )


def extent(spark: SparkSession, d: str) -> Grid:
    """The grid that holds all cells: as wide as the study's, with a row for each PARTS_A_ROW parts."""
    rows = table(spark, d, "part").agg(F.expr(f"coalesce(max(p_partkey) div {PARTS_A_ROW}, 0) + 1").alias("n")).first().n
    return Grid(y0=STUDY.top - rows * 1000.0, rows=rows, cols=COLS)


def cells(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """A wide layer stack (row, col, size, price, balance): one row for each cell that the rows of lineitem meet, which lies
    some columns east of the point's, with the largest size and price of its parts and balance of its suppliers. of: rows
    with a cell (row, col) each; only their cells are made, so that rows of lineitem in others meet no part or supplier."""
    row, col = F.expr(f"l_partkey div {PARTS_A_ROW}"), (F.col("l_suppkey") + F.col("l_linenumber")) % COLS
    l = table(spark, d, "lineitem")
    if of is not None:
        wanted = of.select(F.col("row").alias("__row"), F.col("col").alias("__col")).hint("shuffle_hash")
        l = l.select("l_partkey", "l_suppkey", "l_linenumber").join(wanted, (row == F.col("__row")) & (col == F.col("__col")), "left_semi")
    l = l.select("l_partkey", "l_suppkey", row.alias("row"), col.alias("col"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return l.join(p, "l_partkey").join(s, "l_suppkey").groupBy("row", "col").agg(F.max("p_size").alias("size"), F.max("p_retailprice").alias("price"), F.max("s_acctbal").alias("balance"))


def mask(spark: SparkSession, d: str) -> DataFrame:
    """(row, col) of the cells inside the study area."""
    return inside(cells(spark, d))


def inside(cells: DataFrame) -> DataFrame:
    """The mask's cells among those of a stack that has been made already."""
    return cells.filter("size % 3 <> 0").select("row", "col")


def design(spark: SparkSession, d: str, k: int = 4) -> DataFrame:
    """(id, y, v0..): class and predictors of each embedding."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"), *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(k)])


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, y, s): a label and a score in [0, 1] with many ties, for each order."""
    o = table(spark, d, "orders")
    price = F.least(F.lit(1.0), F.floor(F.col("o_totalprice") / 5000) / 100)
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), price.alias("s"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """(scenario, season, temporal, engine, test_year, split, auc, cbi): a run table with some nulls."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("scenario"),
        F.when(k % 2 == 0, "Winter").otherwise("Summer").alias("season"),
        F.when(F.col("c_nationkey") % 2 == 0, "monotemporal").otherwise("multitemporal").alias("temporal"),
        F.when(F.col("o_orderstatus") == "F", "gbm").otherwise("elapid").alias("engine"),
        F.year("o_orderdate").alias("test_year"),
        F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (k % 3 + 1).cast("int")).alias("split"),
        F.when(k % 7 != 0, 0.5 + (F.floor("o_totalprice") % 500) / 1000.0).alias("auc"),
        F.when(k % 11 != 0, (F.floor("o_totalprice") % 991) / 991.0).alias("cbi"),
        k.alias("run_id"),
    )


def importances(spark: SparkSession, d: str) -> DataFrame:
    """(meta_run, variable, combo, value, vif): importance records by variable and fold."""
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("meta_run"),
        F.concat(F.lit("var_"), (F.col("l_suppkey") % 40).cast("string")).alias("variable"),
        (F.col("l_orderkey") % 100).alias("combo"),
        (F.col("l_discount") - 0.02).alias("value"),
        (F.lit(1.0) + F.col("l_tax") * 50).alias("vif"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


#: The same adapters in SQL, as common table expressions.
SQL = {
    "points": f"""points AS (SELECT l_orderkey * 10 + l_linenumber AS id, 91000.0::DOUBLE + (l_suppkey % {COLS}) * 1000 + l_linenumber * 100 AS x,
  7124000.0::DOUBLE - (l_partkey // {PARTS_A_ROW}) * 1000 - 500 AS y,
  CASE WHEN month(l_shipdate) <= 2 THEN year(l_shipdate) - 1 ELSE year(l_shipdate) END AS year,
  CASE WHEN month(l_shipdate) BETWEEN 3 AND 8 THEN 'Summer' ELSE 'Winter' END AS season,
  CASE l_returnflag WHEN 'A' THEN 'GBIF' WHEN 'N' THEN 'RRN' ELSE 'SNCF' END AS source, l_quantity AS quantity FROM lineitem)""",
    "placed": "placed AS (SELECT *, CAST(floor((7124000 - y) / 1000) AS BIGINT) AS row, CAST(floor((x - 91000) / 1000) AS BIGINT) AS col FROM points)",
    "cells": f"""cells AS (SELECT l_partkey // {PARTS_A_ROW} AS row, (l_suppkey + l_linenumber) % {COLS} AS col, max(p_size) AS size, max(p_retailprice) AS price, max(s_acctbal) AS balance
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)""",
    "mask": "mask AS (SELECT row, col FROM cells WHERE size % 3 <> 0)",
    "design": "design AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(4)) + " FROM embeddings)",
    "scores": """scores AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, least(1.0::DOUBLE, floor(o_totalprice / 5000) / 100) AS s FROM orders)""",
    "metrics": """metrics AS (SELECT c_mktsegment AS scenario, CASE WHEN o_orderkey % 2 = 0 THEN 'Winter' ELSE 'Summer' END AS season,
  CASE WHEN c_nationkey % 2 = 0 THEN 'monotemporal' ELSE 'multitemporal' END AS temporal, CASE WHEN o_orderstatus = 'F' THEN 'gbm' ELSE 'elapid' END AS engine,
  year(o_orderdate) AS test_year, ['train', 'validation', 'test'][o_orderkey % 3 + 1] AS split,
  CASE WHEN o_orderkey % 7 <> 0 THEN 0.5::DOUBLE + (floor(o_totalprice) % 500) / 1000.0::DOUBLE END AS auc,
  CASE WHEN o_orderkey % 11 <> 0 THEN (floor(o_totalprice) % 991) / 991.0::DOUBLE END AS cbi, o_orderkey AS run_id
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "importances": """importances AS (SELECT l_linestatus AS meta_run, 'var_' || (l_suppkey % 40) AS variable, l_orderkey % 100 AS combo, l_discount - 0.02::DOUBLE AS value,
  1.0::DOUBLE + l_tax * 50 AS vif, l_orderkey * 10 + l_linenumber AS id FROM lineitem)""",
}


def sql(body: str, *names: str, also: str = "") -> str:
    """A statement over the named adapters (each after those it needs)."""
    needs = {"placed": ["points"], "mask": ["cells"]}
    order: list[str] = []
    for n in names:
        order += [m for m in [*needs.get(n, []), n] if m not in order]
    return "WITH " + ",\n".join([SQL[n] for n in order] + ([also] if also else [])) + "\n" + body
