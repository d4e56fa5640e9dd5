"""Writing stacks, grids, tables and bundles."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.grid import Grid
from terrane.operators.layers import NODATA
from terrane.session import staged


def write_stack(cells: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A stack as Parquet, sorted by cell within files so that ranges of rows are skipped, in folders by season or year."""
    w = cells.sortWithinPartitions("row", "col").write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def ascii_rows(cells: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """(row, line) of an ESRI ASCII grid's body: six decimals, what isn't known as nodata; rows without cells are left out."""
    v = F.col(value).cast("double")
    text = F.format_string("%.6f", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(NODATA)).otherwise(v))
    # by the way from one known place to the next, so that a row costs what its cells do and not its width times them
    lists = cells.filter(grid.inside()).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("c"), text.alias("t")))).alias("__l"))
    nothing = f"{NODATA:.6f}"
    last = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("__l", i - 1)["c"])
    gap = lambda n: F.repeat(F.lit(f"{nothing} "), n)
    twice = lambda x, i: F.when(x["c"] == last(i), F.raise_error(F.concat(F.lit("more than one cell in column "), x["c"].cast("string"))).cast("string"))
    parts = F.transform("__l", lambda x, i: F.coalesce(twice(x, i), F.concat(gap(x["c"] - last(i) - 1), x["t"])))
    behind = F.repeat(F.lit(f" {nothing}"), F.lit(grid.cols - 1) - F.element_at("__l", -1)["c"])
    return lists.select("row", F.concat(F.array_join(parts, " "), behind).alias("line"))


def ascii_header(grid: Grid) -> list[str]:
    return [f"ncols {grid.cols}", f"nrows {grid.rows}", f"xllcorner {grid.x0:.6f}", f"yllcorner {grid.y0:.6f}", f"cellsize {grid.cell:.6f}", f"NODATA_value {NODATA:.6f}"]


def ascii_grid(cells: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """(place, line) of a whole grid file in order: header, then rows from the top, rows without cells as nodata."""
    spark = cells.sparkSession
    head = spark.createDataFrame([(i - 6, t) for i, t in enumerate(ascii_header(grid))], "place bigint, line string")
    empty = " ".join([f"{NODATA:.6f}"] * grid.cols)
    body = spark.range(grid.rows).withColumnRenamed("id", "place").join(ascii_rows(cells, grid, value).withColumnRenamed("row", "place"), "place", "left").select("place", F.coalesce("line", F.lit(empty)).alias("line"))
    return head.unionByName(body)


def interop_points(points: DataFrame, species: str) -> DataFrame:
    """(species, longitude, latitude) with six decimals, as text."""
    return points.select(F.lit(species).alias("species"), F.format_string("%.6f", "x").alias("longitude"), F.format_string("%.6f", "y").alias("latitude"))


def interop_bundle(points: DataFrame, cells: DataFrame, grid: Grid, layers: Sequence[str], species: str, path: str, settings: dict) -> None:
    """What another program needs for a run: the points as CSV, each layer as an ASCII grid (a folder with one file), and the
    settings with the lists of both as JSON, written last."""
    interop_points(points, species).write.mode("overwrite").option("header", True).csv(f"{path}/points")
    for v in layers:
        ascii_grid(cells, grid, v).repartition(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(f"{path}/layers/{v}")
    told = settings | {"species": species, "points": "points", "layers": {v: f"layers/{v}" for v in layers}, "cell": grid.cell, "rows": grid.rows, "columns": grid.cols}
    write_text(points.sparkSession, f"{path}/bundle.json", json.dumps(told, sort_keys=True))


def markdown(df: DataFrame) -> DataFrame:
    """(line) of each row as a row of a Markdown table; null is empty and | is escaped. For small tables."""
    cells = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def signature(settings: dict) -> str:
    """A name for a result that changes with the settings it was made with."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def cached(df_of, spark, folder: str, settings: dict) -> DataFrame:
    """The result kept under its settings' signature in the folder, made first if there is none that was finished."""
    path = f"{folder.rstrip('/')}/{signature(settings)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Appends the rows whose keys the table at path doesn't have, each key once, and returns what it has then.

    A batch is named by its content, so one that is delivered again, or was written only in part, replaces itself."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(list(keys))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(path).select(*keys), list(keys), "left_anti")
    rows = staged(rows)
    told = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).alias("h")).first()
    if told.n:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch-{told.n}-{told.h}")
    return spark.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(path)


def write_text(spark, path: str, text: str) -> None:
    """Writes a small text file beside its place and moves it there in one step, so a reader sees the old or the new one."""
    fs, conf, hadoop = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    context = fs.FileContext.getFileContext(hadoop(path).toUri(), conf)
    part = hadoop(f"{path}.{uuid.uuid4().hex}.part")
    out = part.getFileSystem(conf).create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    renames = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    renames[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, hadoop(path), renames)


def latex(df: DataFrame) -> DataFrame:
    """(line) of each row as a row of a LaTeX table; null is empty and special characters are escaped. For small tables."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\\", r"\\textbackslash "), r"([&%$#_{}])", r"\\$1")
    return df.select(F.concat(F.concat_ws(" & ", *[cell(c) for c in df.columns]), F.lit(r" \\")).alias("line"))


def bundle(df: DataFrame, path: str) -> None:
    """A table as csv, tsv, md and tex, each in a folder of its own under path."""
    for name, sep in (("csv", ","), ("tsv", "\t")):
        df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(f"{path}/{name}")
    markdown(df).write.mode("overwrite").text(f"{path}/md")
    latex(df).write.mode("overwrite").text(f"{path}/tex")


def write_archive(files: DataFrame, path: str, most: int, name: str = "name", size: str = "size", content: str = "content") -> DataFrame:
    """Writes (name, content, crc32) of the files of at most `most` bytes, compressed, and returns (name, reason) of the
    others; a file of unknown size is left out."""
    told = size_limited(files, most, size)
    kept = told.filter(F.coalesce("included", F.lit(False))).select(F.col(name).alias("name"), F.col(content).alias("content"), F.crc32(F.col(content).cast("binary")).alias("crc32"))
    kept.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return told.filter(~F.coalesce("included", F.lit(False))).select(F.col(name).alias("name"), F.coalesce("reason", F.lit("unknown size")).alias("reason"))


def archive_checked(spark, path: str) -> DataFrame:
    """(name, sound) of each member of an archive: whether it still has the sum it was written with."""
    return spark.read.parquet(path).select("name", (F.crc32(F.col("content").cast("binary")) == F.col("crc32")).alias("sound"))


def size_limited(files: DataFrame, most: int, size: str = "size") -> DataFrame:
    """Adds included and the reason for which a file is not."""
    return files.withColumns({"included": F.col(size) <= most, "reason": F.when(F.col(size) > most, f"over {most} bytes")})


def storable(kind: Column | str, nodata: float = NODATA) -> Column:
    """The number type that can hold nodata in place of a given one."""
    k = F.col(kind) if isinstance(kind, str) else kind
    least = {"int8": -128, "int16": -32768, "int32": -(2**31)}
    out = F.when(k.startswith("float"), k).when(k.isin("uint8", "uint16"), "int32")
    for name, low in least.items():
        out = out.when(k == name, name if nodata >= low else "int32")
    return out.otherwise("float32")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.orderBy(*order)))
