"""Queries of the general data problems: lines that fail to load, points near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import folded
from terrane.operators import proximity, rejects
from terrane.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "presence_raw")).select("file_name", "line_no", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(table(spark, d, "presence_raw"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "presence").select("occ_id", "ingested_at", F.col("dd long").alias("x"), F.col("dd lat").alias("y"), folded("source").alias("s"))
    (_, _, _, _, x0, x1), (_, _, _, _, y0, y1) = [(c.name, c.place, c.pattern, c.kind, c.lower, c.upper) for c in rejects.PRESENCE_CHECKS[:2]]
    points = proximity.one_version(at, "occ_id", "ingested_at", "x", "y", "s")
    points = points.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & F.col("s").isNotNull())
    return proximity.near_pairs(points, "occ_id", "x", "y", "s", 50.0).select(F.col("a").alias("occ_id_a"), F.col("b").alias("occ_id_b"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p5_found": p5_found}

_P2_SPLIT = r"""
WITH body AS (
  SELECT file_name, line_no, regexp_replace(raw_line, '\r+\z', '') AS b FROM presence_raw
  WHERE line_no IS DISTINCT FROM 1 AND regexp_matches(raw_line, '[^ \t\r]')),
sorted AS (
  SELECT *, regexp_full_match(b, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS sound FROM body),
parts AS (
  SELECT *, CASE WHEN sound THEN regexp_extract_all(',' || b, ',("(?:[^"]|"")*"|[^",]*)', 1) END AS raw FROM sorted),
plain AS (
  SELECT file_name, line_no, sound, len(raw) AS n,
         [CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END FOR f IN raw] AS f FROM parts),
typed AS (
  SELECT *, trim(f[2]) AS lon, trim(f[3]) AS lat, trim(f[4]) AS yr FROM plain),
judged AS (
  SELECT *,
    coalesce(regexp_full_match(lon, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') AND TRY_CAST(lon AS DOUBLE) >= 91000 AND TRY_CAST(lon AS DOUBLE) < 1091000, false)
    AND coalesce(regexp_full_match(lat, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') AND TRY_CAST(lat AS DOUBLE) >= 6124000 AND TRY_CAST(lat AS DOUBLE) < 7124000, false)
    AND coalesce(regexp_full_match(yr, '[0-9]{4}([.]0+)?') AND TRY_CAST(yr AS DOUBLE) BETWEEN 2017 AND 2024, false) AS good
  FROM typed)
"""

SQL = {
    "p2_found": _P2_SPLIT
    + """SELECT DISTINCT file_name, line_no, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 10 THEN 'columns' ELSE 'value' END AS reason
FROM judged WHERE NOT sound OR n <> 10 OR NOT good""",
    "p2_loaded": _P2_SPLIT
    + """SELECT file_name, line_no, nullif(f[1], '') AS occ_id, CAST(lon AS DOUBLE) AS "dd long", CAST(lat AS DOUBLE) AS "dd lat", CAST(yr AS DOUBLE) AS "year-int",
  nullif(f[5], '') AS "month-int", nullif(f[6], '') AS source, nullif(f[7], '') AS season, nullif(f[8], '') AS semester, nullif(f[9], '') AS month, nullif(f[10], '') AS remarks
FROM judged WHERE sound AND n = 10 AND good""",
    "p5_found": """
WITH pts AS (SELECT occ_id, any_value("dd long") AS x, any_value("dd lat") AS y, any_value(lower(trim(source))) AS s FROM presence WHERE source IS NOT NULL
  AND "dd long" >= 91000 AND "dd long" < 1091000 AND "dd lat" >= 6124000 AND "dd lat" < 7124000 GROUP BY occ_id)
SELECT a.occ_id AS occ_id_a, b.occ_id AS occ_id_b FROM pts a JOIN (SELECT *, unnest([-1, 0, 1]) AS dc FROM pts) b
  ON floor(a.x / 50) = floor(b.x / 50) + b.dc AND abs(a.y - b.y) <= 50
WHERE a.occ_id < b.occ_id AND a.s <> b.s AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500""",
}
