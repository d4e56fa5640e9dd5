"""Column expressions on names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as an outer blank of a label.
BLANKS = " \t\n\r\x0b\x0c\xa0"


def trimmed(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def folded(c: Column | str) -> Column:
    """A label without outer blanks, in lower case; null stays null."""
    return F.lower(trimmed(c))


def sanitised(c: Column | str) -> Column:
    """A name of letters, digits, points, hyphens and single underscores, `unnamed` if nothing is left."""
    v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    v = F.btrim(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit("_."))
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("unnamed"))


def truthy(c: Column | str, yes: tuple[str, ...] = ("true", "1", "yes", "y")) -> Column:
    return F.coalesce(folded(c).isin(*yes), F.lit(False))


def engine(c: Column | str) -> Column:
    """The engine's own name for its aliases; null for an unknown one."""
    e = folded(c)
    return F.when(e.isin("elapid", "maxent"), "elapid").when(e == "gbm", "gbm")


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-F.col(c)))


def cloglog(c: Column | str) -> Column:
    return 1 - F.exp(-F.exp(c))


def finite(c: Column | str) -> Column:
    """A number, or null if it is NaN or infinite."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
