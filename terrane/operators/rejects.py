"""Delimited lines that fail to load, and typed loading of those that don't."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import staged

_FIELD = r'"[^"]*+(?:""[^"]*+)*+"|[^",]*+'
_RECORD = rf"\A(?:{_FIELD})(?:,(?:{_FIELD}))*+\z"
_DECIMAL = r"\A[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class Checked:
    """A column whose values must be sound: its place (from 0), its type, and lower <= value < upper."""

    name: str
    place: int
    pattern: str
    kind: str
    lower: float
    upper: float


#: The study grid's bounds in metres, and the years of the surveys.
PRESENCE_COLUMNS = ("occ_id", "dd long", "dd lat", "year-int", "month-int", "source", "season", "semester", "month", "remarks")
PRESENCE_CHECKS = (
    Checked("dd long", 1, _DECIMAL, "double", 91000, 1091000),
    Checked("dd lat", 2, _DECIMAL, "double", 6124000, 7124000),
    Checked("year-int", 3, r"\A[0-9]{4}(?:\.0+)?\z", "double", 2017, 2025),
)


def split_lines(lines: DataFrame, columns: int, line: str = "raw_line", line_no: str = "line_no") -> DataFrame:
    """Adds `fields` (array of unquoted strings, null if unsound) and `reason` (quoting, columns or null) to each record.

    Line 1 of a file and lines that are null or hold only blanks, tabs and carriage returns are no records and are left
    out. Carriage returns at the end are dropped, line breaks inside quotes kept.
    """
    body = F.regexp_replace(F.col(line), r"\r+\z", "")
    records = lines.filter(~F.col(line_no).eqNullSafe(1) & F.col(line).rlike(r"[^ \t\r]")).withColumn("__body", body)
    # without a quote a record is sound and its fields lie between commas
    plain = F.when(~F.contains("__body", F.lit('"')), F.split("__body", ",", -1))
    quoted = records.withColumn("__raw", plain.when(F.col("__body").rlike(_RECORD), F.regexp_extract_all(F.concat(F.lit(","), "__body"), F.lit(f",({_FIELD})"), F.lit(1))))
    unquote = lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    reason = F.when(F.col("__raw").isNull(), "quoting").when(F.size("__raw") != columns, "columns")
    return quoted.withColumn("reason", reason).withColumn("fields", F.when(F.col("reason").isNull(), F.transform("__raw", unquote))).drop("__body", "__raw")


def _named(checks: tuple[Checked, ...]) -> Column:
    """The checked values of a record as (place, value) pairs; spaces around a value are ignored."""
    return F.array(*[F.struct(F.lit(c.place).alias("place"), F.trim(F.col("fields")[c.place]).alias("value")) for c in checks])


def invalid_values(values: DataFrame, checks: tuple[Checked, ...]) -> DataFrame:
    """The dictionary (place, value, why) of the unsound ones of (place, value), each distinct value of a column being cast once.

    `why` hangs on the count of a value, which is only there once equal values have met, so that it can't be computed for
    each row before."""
    distinct = values.groupBy("place", "value").agg(F.count("*").alias("n"))
    why = F.lit(None).cast("string")
    for c in checks:
        number = F.col("value").try_cast(c.kind)
        own = F.when(F.col("value") == "", "empty").when(~F.col("value").rlike(c.pattern), "form").when(number.isNull() | ~((number >= c.lower) & (number < c.upper)), "range")
        why = F.when(F.col("place") == c.place, own).otherwise(why)
    return distinct.withColumn("why", F.when(F.col("n") > 0, why)).filter(F.col("why").isNotNull()).drop("n")


def rejected(lines: DataFrame, keys: tuple[str, ...] = ("file_name", "line_no"), columns: int = len(PRESENCE_COLUMNS), checks: tuple[Checked, ...] = PRESENCE_CHECKS) -> DataFrame:
    """One row (keys, reason, detail) for each line that fails; reason is quoting, columns or value, the first that holds.

    detail names the unsound columns and why (for reason value). Lines are split once; what is checked of them is written,
    and so is the dictionary of invalid values that is joined back; the planner sees its size, so it is broadcast only
    below the session's threshold and shuffled, with skewed values split, above it. Repeated identical keys give one row.
    An empty table gives no rows.
    """
    split = split_lines(lines.select(*keys, "raw_line"), columns)
    # a line of unsound structure goes on as a single value of no column
    broken = F.array(F.struct(F.lit(-1).alias("place"), F.col("reason").alias("value")))
    told = staged(split.select(*keys, F.when(F.col("reason").isNotNull(), broken).otherwise(_named(checks)).alias("told"))).select(*keys, F.inline("told"))
    bad = staged(invalid_values(told.filter("place >= 0").select("place", "value"), checks))
    failed = told.join(bad, ["place", "value"], "left").filter((F.col("place") < 0) | F.col("why").isNotNull())
    names = F.element_at(F.create_map(*[F.lit(x) for c in checks for x in (c.place, c.name)]), F.when(F.col("place") >= 0, F.col("place")))
    # structure and values never both fail, as the values of a broken line aren't read
    reason = F.coalesce(F.max(F.when(F.col("place") < 0, F.col("value"))), F.lit("value"))
    detail = F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("place") >= 0, F.concat_ws(": ", names, "why")))), "; "), F.lit(""))
    return failed.groupBy(*keys).agg(reason.alias("reason"), detail.alias("detail"))


def loaded(lines: DataFrame, keys: tuple[str, ...] = ("file_name", "line_no"), columns: tuple[str, ...] = PRESENCE_COLUMNS, checks: tuple[Checked, ...] = PRESENCE_CHECKS) -> DataFrame:
    """The sound lines with one column for each field; checked columns are typed, others stay strings (empty ones null)."""
    split = staged(split_lines(lines.select(*keys, "raw_line"), len(columns)).filter(F.col("reason").isNull()).select(*keys, "fields"))
    bad = staged(invalid_values(split.select(F.inline(_named(checks))), checks))
    flagged = split
    for c in checks:
        own = bad.filter(F.col("place") == c.place).select(F.col("value").alias(f"__v{c.place}"))
        flagged = flagged.withColumn("__v", F.trim(F.col("fields")[c.place])).join(own, F.col("__v") == F.col(f"__v{c.place}"), "left_anti").drop("__v")
    typed = {c.place: c.kind for c in checks}
    return flagged.select(*keys, *[(F.trim(F.col("fields")[i]).cast(typed[i]) if i in typed else F.nullif(F.col("fields")[i], F.lit(""))).alias(n) for i, n in enumerate(columns)])
