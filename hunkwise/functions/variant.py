"""Typed reads from JSON that keep apart missing, null, quoted and bare values.

A JSON text is parsed once and cast once to a struct whose leaves are VARIANT: a missing field is a NULL leaf,
a JSON null is a null VARIANT, and a leaf still knows whether its value was quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER_TEXT = r"\A\s*[+-]?[0-9]+\s*\z"
FLOAT_TEXT = r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def last_key_wins(df: DataFrame) -> None:
    """Of repeated keys of a JSON object the last one counts. By default the parser takes such a text for no JSON; the setting is
    the session's, read when a query runs."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_as(json_text: Column, ddl: str) -> Column:
    """The JSON object as a struct; NULL when the text is no JSON or no object."""
    return F.try_variant_get(F.try_parse_json(json_text), "$", ddl)


def kind(leaf: Column) -> Column:
    """``STRING``, ``BIGINT``, ``DECIMAL(…)``, ``DOUBLE``, ``BOOLEAN``, ``VOID``, ``OBJECT<…>``, ``ARRAY<…>``."""
    return F.schema_of_variant(leaf)


def is_null(leaf: Column) -> Column:
    return F.is_variant_null(leaf)


def is_number(type_name: Column) -> Column:
    return type_name.isin("BIGINT", "DOUBLE", "FLOAT") | type_name.startswith("DECIMAL")


def as_(leaf: Column, type_name: str) -> Column:
    return F.try_variant_get(leaf, "$", type_name)


def text(leaf: Column) -> Column:
    """The value when it is a JSON string, else NULL."""
    return F.when(kind(leaf) == "STRING", as_(leaf, "string"))


def integer(leaf: Column) -> Column:
    """The value when it is a bare integral number, or one in quotes; else NULL."""
    type_name, number, quoted = kind(leaf), as_(leaf, "double"), as_(leaf, "string")
    return (
        F.when(type_name == "BIGINT", as_(leaf, "bigint"))
        .when(is_number(type_name) & (number == F.floor(number)), number.cast("bigint"))
        .when((type_name == "STRING") & quoted.rlike(INTEGER_TEXT), F.trim(quoted).try_cast("bigint"))
    )
