"""Duplicate files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.session import salted_join


def duplicate_groups(files: DataFrame, hash_column: str = "file_hash", path_column: str = "source_path") -> DataFrame:
    """Hashes held by two distinct paths at least: ``file_hash``, ``copies`` (distinct paths), ``first_path``. Null hashes form no group. The paths of a
    group are not gathered; ``duplicate_members`` lists them a row each."""
    one = files.select(F.col(hash_column).alias("file_hash"), F.col(path_column).alias("path")).filter("file_hash is not null and path is not null").distinct()
    return one.groupBy("file_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def duplicate_members(files: DataFrame, hash_column: str = "file_hash", path_column: str = "source_path") -> DataFrame:
    """Every path in a duplicate group with the group's first path: ``path``, ``file_hash``, ``first_path``."""
    one = files.select(F.col(hash_column).alias("file_hash"), F.col(path_column).alias("path")).filter("file_hash is not null and path is not null").distinct()
    groups = one.groupBy("file_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).filter("copies > 1").drop("copies")
    return salted_join(one, groups, ["file_hash"]).select("path", "file_hash", "first_path")


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (path, size_bytes, file_hash) whose content is found in ``right`` under another path, with the first such path as
    ``match``. The right side is reduced to its two first paths per content, which is enough to name one that is not the row itself."""
    best = right.filter("file_hash is not null").groupBy("size_bytes", "file_hash").agg(F.min("path").alias("p1"))
    keyed = right.filter("file_hash is not null").select("size_bytes", "file_hash", "path")
    second = keyed.join(best, ["size_bytes", "file_hash"]).filter("path <> p1").groupBy("size_bytes", "file_hash").agg(F.min("path").alias("p2"))
    two = best.join(second, ["size_bytes", "file_hash"], "left")
    match = F.when(F.col("path") == F.col("p1"), F.col("p2")).otherwise(F.col("p1"))
    return salted_join(left, two, ["size_bytes", "file_hash"]).withColumn("match", match).filter("match is not null").drop("p1", "p2")
