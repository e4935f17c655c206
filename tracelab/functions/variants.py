"""Strictly typed reading of VARIANT values: a node's type is tested before it is read, nothing is coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>, OBJECT<...> and so on; '' where there is no node."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def is_list(v: Column) -> Column:
    """Reads one level only, where kind() would look at all that the list holds."""
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def string(v: Column, path: str) -> Column:
    """The string at path, null if there is none or it is of another type."""
    return F.when(is_string(node(v, path)), F.try_variant_get(v, path, "string"))


def items(v: Column, path: str) -> Column:
    """The items of the list at path, null if it isn't a list."""
    return F.try_variant_get(v, path, "array<variant>")


def strings(v: Column, path: str) -> Column:
    """The string items of the list at path, none if it isn't a list."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(F.filter(items(v, path), is_string), lambda x: F.variant_get(x, "$", "string")), none)


def integer(v: Column, path: str) -> Column:
    return F.when(kind(node(v, path)) == "BIGINT", F.try_variant_get(v, path, "bigint"))
