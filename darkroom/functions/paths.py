"""Path expressions: POSIX paths as strings, by the rules of pure paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; none for names that only begin or end with a dot."""
    return F.regexp_extract(file_name(path), r"^.*[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def ancestor(path: Column, level: int) -> Column:
    """Name of the folder ``level`` steps up (1: the parent); null at the root."""
    return F.nullif(F.get(F.reverse(F.split(path, "/")), F.lit(level)), F.lit(""))


def is_hidden(path: Column) -> Column:
    """Any part of the path begins with a dot."""
    return F.exists(F.split(path, "/"), lambda part: part.startswith("."))
