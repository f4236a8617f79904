"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.session import materialise


def ranked(df: DataFrame, keys: list[str], order: list[str], into: str = "seq") -> DataFrame:
    """Adds the place (from 1) of each row within its key.

    The rows are range-partitioned by (key, order), so a key with a third of all rows lies in many partitions; each numbers its own piece and the
    pieces' sizes are summed up. Ties in the order are numbered arbitrarily; null keys are one key.
    """
    piece = "__piece"
    fixed = materialise(df.repartitionByRange(*keys, *order).withColumn(piece, F.spark_partition_id()))
    names = [F.coalesce(F.col(k).cast("string"), F.lit("\x00null")).alias(f"__k{i}") for i, k in enumerate(keys)]
    keyed = fixed.select("*", *names)
    codes = [f"__k{i}" for i in range(len(keys))]
    local = keyed.withColumn("__at", F.row_number().over(Window.partitionBy(piece, *codes).orderBy(*order)))
    sizes = keyed.groupBy(piece, *codes).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*codes).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(piece, *codes, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row per key and piece
    return local.join(starts, [piece, *codes]).withColumn(into, F.col("__at") + F.col("__start")).drop(piece, *codes, "__at", "__start")
