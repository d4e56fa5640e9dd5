"""Nested settings: substitution, flattening, merging, comparing."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def substituted(text: str, values: dict) -> str:
    """The text with ${key} replaced by the values that are no lists or mappings; unknown keys stay."""
    plain = {k: str(v) for k, v in values.items() if not isinstance(v, (dict, list))}
    return re.sub(r"\$\{(\w+)\}", lambda m: plain.get(m[1], m[0]), text)


def flattened(settings, prefix: str = "") -> dict:
    """Dotted path to value; lists are values."""
    if not isinstance(settings, dict):
        return {prefix: settings}
    out: dict = {}
    for k, v in settings.items():
        out |= flattened(v, f"{prefix}.{k}" if prefix else str(k))
    return out


def merged(base: dict, patch: dict) -> dict:
    """base with patch laid over it, mapping by mapping; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in patch.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def stable_hash(settings) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def only(items: Iterable[dict], **wanted) -> dict:
    """The one item with all the wanted values; none or several are an error."""
    hits = [x for x in items if all(x.get(k) == v for k, v in wanted.items())]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} items match {wanted}")
    return hits[0]


def as_table(spark: SparkSession, settings: dict) -> DataFrame:
    """(path, value) with values as JSON."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(flattened(settings).items())], "path string, value string")


def flags_in_json(configs: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """configs with one column for each path ($.a.b) of a JSON text, null where it isn't there or the text doesn't parse."""
    return configs.withColumns({n: F.get_json_object(column, p) for n, p in paths.items()})


def disabled(configs: DataFrame, name: str, text: str, flag: str, wanted: dict[str, str]) -> DataFrame:
    """(name, scenario, problem) of the scenarios in JSON settings that have all wanted values and the flag (a dotted path)
    exactly false; a text that doesn't parse has a row with its problem instead.

    A text is one scenario, or has a list of them under `scenarios`; a scenario is named by its `id`.
    """
    whole = F.try_parse_json(text)
    problem = F.when(whole.isNull(), "no settings")
    each = F.from_json(F.get_json_object(text, "$.scenarios"), "array<string>")
    # each scenario as text of its own, as their settings differ
    own = configs.select(name, problem.alias("problem"), F.explode_outer(F.coalesce(each, F.array(text))).alias("__s"))
    at = lambda p: F.get_json_object("__s", f"$.{p}")
    hit = at(flag) == "false"
    for k, v in wanted.items():
        hit &= F.lower(at(k)) == v.lower()
    return own.filter(F.col("problem").isNotNull() | hit).select(name, F.when(F.col("problem").isNull(), at("id")).alias("scenario"), "problem")
