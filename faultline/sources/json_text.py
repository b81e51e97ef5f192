"""Lenient JSON: comments, trailing commas, property names in any case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = r'("(?:[^"\\]++|\\.)*+")'


def clean_json(text: Column) -> Column:
    """Drop comments and trailing commas, but never inside a string."""
    no_comments = F.regexp_replace(text, _STRING + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(
        F.regexp_replace(no_comments, _STRING + r"|,(?=\s*[\]}])", "$1"), "^﻿", "")


def lower_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.lower(k))


def json_object(text: Column) -> Column:
    """Object as ``map<lower name, JSON text>``."""
    return lower_keys(F.from_json(text, "map<string,string>"))


def json_objects(text: Column) -> Column:
    """Array of objects as array of maps with lower-cased names."""
    return F.transform(F.from_json(text, "array<map<string,string>>"), lower_keys)


def get_text(m: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name.lower())), F.lit(default))


def _refused(name: str, wanted: str, got: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"JSON property '{name}' is not {wanted}: "), F.substring(got, 1, 200)))


def required_objects(text: Column, name: str) -> Column:
    """As ``json_objects``; none of an absent or null text, an error for anything but an array of objects."""
    kind = "array<map<string,string>>"
    read = json_objects(text)
    wrong = read.isNull() | F.exists(read, lambda m: m.isNull())
    return F.when(F.coalesce(F.trim(text), F.lit("")).isin("", "null"), F.array().cast(kind)).when(
        wrong, _refused(name, "an array of objects", text).cast(kind)).otherwise(read)


def _typed_list(m: Column, name: str, element: str, kinds: list[str]) -> Column:
    """Array of the given element type; none if absent or null, an error for anything else."""
    raw = F.try_element_at(m, F.lit(name.lower()))
    items = F.when(F.startswith(F.schema_of_variant(F.try_parse_json(raw)), F.lit("ARRAY")),
                   F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"))
    wrong = items.isNull() | F.exists(items, lambda v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin(*kinds, "VOID"))
    empty = F.array().cast(f"array<{element}>")
    return F.when(F.coalesce(F.trim(raw), F.lit("")).isin("", "null"), empty).when(
        wrong, _refused(name, f"a list of {kinds[0].lower()} values", raw).cast(f"array<{element}>")).otherwise(
        F.from_json(raw, f"array<{element}>"))


def get_list(m: Column, name: str) -> Column:
    return _typed_list(m, name, "string", ["STRING"])


def get_int(m: Column, name: str, default: int) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name.lower())).try_cast("int"), F.lit(default))


def get_bool(m: Column, name: str, default: bool = False) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name.lower())).try_cast("boolean"), F.lit(default))


def get_ints(m: Column, name: str) -> Column:
    return _typed_list(m, name, "int", ["BIGINT", "INT", "SMALLINT", "TINYINT"])


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
