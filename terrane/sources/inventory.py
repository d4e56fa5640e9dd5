"""What files there are: expected layers, yearly inventories, runs, documents, points in JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.stats import top_row
from terrane.sources.tables import expanded


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, size) of the files below a folder, whose content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def stem(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def expected_layers(inventory: DataFrame, patterns: Sequence[str], options: dict[str, Sequence]) -> DataFrame:
    """(stem) of the files that the patterns name and the inventory (path) has, each once."""
    wanted = inventory.sparkSession.createDataFrame([(p,) for t in patterns for p in expanded(t, options)], "path string").distinct()
    return inventory.select("path").distinct().join(wanted, "path", "left_semi").select(stem("path").alias("stem")).distinct()


def yearly(inventory: DataFrame, pattern: str, years: Sequence[int], configured: Sequence[str] = ()) -> DataFrame:
    """(year, path, present, configured, found): the path a template names for each year, whether it is there and is one of the
    configured, and if it isn't there, the last file anywhere whose name is the wanted one's."""
    spark = inventory.sparkSession
    wanted = spark.createDataFrame([(y, pattern.format(year=y)) for y in years], "year int, path string").withColumn("__n", F.regexp_extract("path", r"([^/]*)$", 1))
    have = inventory.select("path").distinct().withColumn("present", F.lit(True))
    same = inventory.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("__n"), "path").groupBy("__n").agg(F.max("path").alias("__p"))
    out = wanted.join(have, "path", "left").join(same, "__n", "left")
    present = F.coalesce("present", F.lit(False))
    return out.select("year", "path", present.alias("present"), F.col("path").isin(*configured).alias("configured") if configured else F.lit(False).alias("configured"), F.when(present, F.col("path")).otherwise(F.col("__p")).alias("found"))


#: Words in a file's name that tell a prediction, and how much.
TELLS = {"test": 5, "importance": 4}


def ranked_files(files: DataFrame, by: str, path: str, tells: dict[str, int] | None = None, barred: Sequence[str] = ("stack",)) -> DataFrame:
    """(by, path, score): of each group the file whose path below the run's folder has most telling words, a year counting
    one; of equal ones the last by name. Names with a barred word are none."""
    p = F.lower(F.regexp_extract(path, r"outputs/[^/]*/(.*)$", 1))
    score = F.when(p.rlike(r"(19|20)[0-9]{2}"), 1).otherwise(0)
    for w, n in (tells or TELLS).items():
        score = score + F.when(F.contains(p, F.lit(w)), n).otherwise(0)
    kept = files
    for w in barred:
        kept = kept.filter(~F.contains(p, F.lit(w)))
    return top_row(kept.select(by, path, score.alias("score")), [by], "score", [F.desc(path)])


def run_folders(paths: DataFrame, path: str) -> DataFrame:
    """(folder, season, temporal, engine, test_year) of the runs that the paths lie in, by folders named so; a part that a
    folder doesn't tell is null. Each folder once."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))
    part = lambda r: F.nullif(F.regexp_extract(name, r, 1), F.lit(""))
    return paths.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), part(r"(summer|winter)").alias("season"), part(r"(mono|multi)temporal").alias("temporal"), part(r"(elapid|maxent|gbm)").alias("engine"), part(r"test_(\d{4})").cast("int").alias("test_year")).distinct()


def season_years(folders: DataFrame) -> DataFrame:
    """(season, years): the test years there are runs for, by season, in order; what a driver of runs goes through."""
    return folders.dropna(subset=["season", "test_year"]).groupBy("season").agg(F.array_sort(F.collect_set("test_year")).alias("years"))


def read_geojson(spark: SparkSession, path: str | list[str], properties: dict[str, str], lines: bool = False) -> DataFrame:
    """(x, y, properties...) of the points of GeoJSON feature collections, properties being name -> type. Features that are no
    points, or have no coordinates, are left out. A collection is one JSON document, read by one task; with lines, each
    line of the files is a feature, and a file is read by any number of tasks."""
    own = "struct<" + ", ".join(f"`{n}`: {t}" for n, t in properties.items()) + ">" if properties else "map<string, string>"
    # coordinates differ in depth by kind, so they are read as text
    feature = f"struct<geometry: struct<type: string, coordinates: string>, properties: {own}>"
    schema = f"type string, features array<{feature}>, geometry struct<type: string, coordinates: string>, properties {own}"
    docs = spark.read.schema(schema).option("multiLine", not lines).json(path)
    each = docs.select(F.explode(F.coalesce("features", F.array(F.struct("geometry", "properties")))).alias("f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    points = each.filter(F.col("f.geometry.type") == "Point").select(at[0].alias("x"), at[1].alias("y"), *[F.col(f"f.properties.`{n}`").alias(n) for n in properties])
    return points.dropna(subset=["x", "y"])


def text_flags(files: DataFrame, flags: dict[str, str], content: str = "content", name: str = "path") -> DataFrame:
    """(name, size, one count a flag) of text files (content binary or string, UTF-8): in how many lines each pattern occurs."""
    lines = F.split(F.col(content).cast("string"), r"\r?\n")

    def hits(pattern: str) -> Column:
        return F.when(F.col(content).isNull(), 0).otherwise(F.size(F.filter(lines, lambda line: line.rlike(pattern))))

    return files.select(name, F.octet_length(content).alias("size"), *[hits(r).alias(k) for k, r in flags.items()])


def hygiene(files: DataFrame, forbidden: Sequence[str], content: str = "content", name: str = "path") -> DataFrame:
    """(name, sha256, copies, first, forbidden, conflict) of files: how many have the same content and the first of them by
    name, whether its extension is forbidden, and whether it has a line that marks a merge conflict."""
    text = F.col(content).cast("string")
    f = files.select(name, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*forbidden).alias("forbidden"), F.coalesce(text.rlike(r"(?m)^(<{7}|>{7})( |$)"), F.lit(False)).alias("conflict"))
    same = f.groupBy("sha256").agg(F.count("*").alias("copies"), F.min(name).alias("first"))
    return f.join(same, "sha256").select(name, "sha256", "copies", "first", "forbidden", "conflict")
