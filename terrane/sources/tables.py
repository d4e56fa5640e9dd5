"""Reading points, predictors, grids, lists and run tables."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.text import folded
from terrane.operators.layers import NODATA, known

#: Names that columns of older files have.
RENAMED = {"dd_long": "x", "dd_lat": "y", "longitude": "x", "latitude": "y", "year_int": "year", "month_int": "month_label"}


def header(name: str) -> str:
    """A column name stripped, in lower case, blanks and hyphens as single underscores."""
    return re.sub(r"[\s-]+", "_", name.lstrip("﻿").strip().lower())


def normalised(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Columns under normalised names; names that become equal get _2, _3 and so on."""
    names: list[str] = []
    for c in df.columns:
        n = (RENAMED if rename is None else rename).get(header(c), header(c))
        k = 1
        while (n if k == 1 else f"{n}_{k}") in names:
            k += 1
        names.append(n if k == 1 else f"{n}_{k}")
    return df.toDF(*names)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def located(df: DataFrame) -> DataFrame:
    """Points with numeric x and y; those that aren't numbers, or aren't finite, are left out."""
    d = require(normalised(df), ["x", "y"]).withColumns({c: known(F.col(c).try_cast("double"), float("-inf")) for c in ("x", "y")})
    return d.dropna(subset=["x", "y"])


def read_points(spark: SparkSession, path: str | list[str], format: str = "csv") -> DataFrame:
    """Points of CSV, Parquet, ORC or JSON files, all columns of CSV as strings but x and y (no pass to infer types)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if format == "csv" else spark.read
    return located(reader.format(format).load(path))


def of_semesters(points: DataFrame, semesters: Sequence[str] | None = None, years: tuple[int, int] | None = None, sources: Sequence[str] | None = None) -> DataFrame:
    """Points of any of the semesters or, without such, of the years from first to last; of the sources, if given.

    Labels are compared without outer blanks and regardless of case."""
    keep = F.lit(True)
    if semesters:
        keep = folded("semester").isin(*[s.strip().lower() for s in semesters])
    elif years:
        keep = F.col("year").between(*years)
    if sources:
        keep = keep & folded("source").isin(*[s.strip().lower() for s in sources])
    return points.filter(keep)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def read_predictors(spark: SparkSession, path: str) -> DataFrame:
    """The numeric columns of a Parquet or CSV table, told by its suffix."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.option("header", True).csv(path, inferSchema=True)
    return df.select(*[F.col(f"`{c}`") for c in numeric_columns(df)])


def read_ascii_grids(spark: SparkSession, path: str | list[str], nodata: float = NODATA) -> DataFrame:
    """(layer, row, col, value) of ESRI ASCII grid files, nodata being null; the layer is the file's name without suffix.

    Lines are numbered within the piece of a file that a task reads, and pieces are put in order by where they begin; a file
    may be read by any number of tasks. A file with other rows than its header says is an error.
    """
    names = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("layer"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("__i")
    )
    # a line of the body is as long as the grid is wide: only its beginning is cut off here
    first = F.lower(F.split(F.trim("line"), r"\s+", 2)[0])
    lines = lines.withColumn("__body", ~first.isin(*names) & (F.trim("line") != ""))
    pieces = lines.groupBy("__f", "__b").agg(F.min("__i").alias("__i0"), F.count("*").alias("__n"), F.min(F.when(F.col("__body"), F.col("__i"))).alias("__s"), F.count_if("__body").alias("__k"), F.max(F.when(first == "nrows", F.split(F.trim("line"), r"\s+")[1].try_cast("bigint"))).alias("__rows"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__f").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("__at", before - F.col("__i0"))
    pieces = pieces.withColumn("__at", F.col("__at") - F.min(F.col("__s") + F.col("__at")).over(W.partitionBy("__f"))).withColumns({n: f(n).over(W.partitionBy("__f")) for n, f in (("__k", F.sum), ("__rows", F.max))}).select("__f", "__b", "__at", "__k", "__rows")
    at = lines.filter("__body").join(F.broadcast(pieces), ["__f", "__b"]).withColumn("row", F.when(F.col("__rows") != F.col("__k"), F.raise_error(F.concat_ws(" ", "__f", F.lit("has"), F.col("__k").cast("string"), F.lit("rows, not"), F.col("__rows").cast("string"))).cast("bigint")).otherwise(F.col("__i") + F.col("__at")))
    values = at.select("layer", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    return values.select("layer", "row", F.col("col").cast("bigint").alias("col"), known(F.col("v").try_cast("double"), nodata).alias("value"))


def collapsed_bands(bands: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """(keys, value): the mean over bands of the known values."""
    return bands.groupBy(*keys).agg(F.avg(known("value")).alias("value"))


def expanded(pattern: str, options: dict[str, Sequence], spark: SparkSession | None = None) -> list[str] | DataFrame:
    """All paths of a pattern with {names}; months are written with two digits, {x_lower} is the lower case of {x}."""
    used = [k for k in options if f"{{{k}" in pattern]
    out = []
    for values in itertools.product(*[options[k] for k in used]):
        d = {k: (f"{int(v):02d}" if k == "month" else str(v)) for k, v in zip(used, values)}
        out.append(pattern.format(**d, **{f"{k}_lower": v.lower() for k, v in d.items()}))
    return out if spark is None else spark.createDataFrame([(p,) for p in out], "path string")


def named_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, place) of lists one name a line or separated by commas, `#` beginning a comment; each name once, in order.

    lines needs a column `line_no` that numbers them."""
    parts = lines.select("line_no", F.posexplode(F.split(F.regexp_replace(F.coalesce(column, F.lit("")), "#.*", ""), ",")).alias("__p", "__n")).select("line_no", "__p", F.trim("__n").alias("name")).filter("name <> ''")
    first = parts.groupBy("name").agg(F.min(F.struct("line_no", "__p")).alias("__f"))
    return first.select("name", F.row_number().over(W.orderBy("__f.line_no", "__f.__p")).alias("place"))


def first_existing(candidates: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Of candidates (key, path, priority), the first that the inventory (path, modified) has, the newest of equal ones."""
    w = W.partitionBy(key).orderBy("priority", F.desc("modified"), "path")
    return candidates.join(inventory, "path").withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, "path")


def prioritised(roots: DataFrame, wanted: str, opposed: str) -> DataFrame:
    """roots (path, idx) with a rank: 0 if the path has the wanted word, 2 the opposed one, else 1."""
    p = F.lower("path")
    return roots.withColumn("rank", F.when(F.contains(p, F.lit(wanted.lower())), 0).when(F.contains(p, F.lit(opposed.lower())), 2).otherwise(1))


def path_labels(path: Column | str) -> dict[str, Column]:
    """season, test_year and engine of a run's path, null where it has none."""
    ex = lambda r: F.nullif(F.regexp_extract(path, r, 1), F.lit(""))
    return {"season": F.lower(ex(r"(?i)(?:^|[/_])(summer|winter)(?:[/_]|$)")), "test_year": ex(r"(?:^|/)test_(\d{4})(?:/|$)").cast("int"), "engine": F.lower(ex(r"(?i)(?:^|/)(elapid|maxent|gbm)(?:/|$)"))}


def read_runs(spark: SparkSession, path: str | list[str], format: str = "csv") -> DataFrame:
    """The rows of run tables with the labels of their paths, columns matched by name."""
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    df = reader.format(format).load(path)
    return df.withColumn("path", F.col("_metadata.file_path")).withColumns(path_labels("path"))


def alias(df: DataFrame, wanted: str, *names: str, kind: str = "double") -> DataFrame:
    """Adds `wanted` from the first of the names there is (regardless of case), as a number, null where it isn't one."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in (wanted, *names) if n.lower() in have), None)
    return df.withColumn(wanted, F.lit(None).cast(kind) if found is None else F.col(f"`{found}`").try_cast(kind))


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dispatched(source: str | list[str] | dict, options: dict[str, Sequence]) -> list[str]:
    """Paths of a source given as a pattern, a list, or a mapping with `pattern` or `files`; anything else is an error."""
    if isinstance(source, str):
        return expanded(source, options)
    if isinstance(source, list):
        return list(source)
    if isinstance(source, dict) and "pattern" in source:
        return expanded(source["pattern"], options)
    if isinstance(source, dict) and "files" in source:
        return list(source["files"])
    raise ValueError(f"no source: {source!r}")
