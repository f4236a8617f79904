"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_IN_COPY = "missing_in_copy"
MISSING_IN_MAIN = "missing_in_main"


def compare_copies(
    main: DataFrame,
    copy: DataFrame,
    keys: list[str],
    fields: list[str],
    version: list[str],
) -> DataFrame:
    """Report rows missing on either side and fields whose values differ, one row per difference.

    The two sides are tagged, unioned and grouped **once** by the key; each group keeps one struct per side, the one with
    the greatest ``version`` (columns compared in turn; a null version is the oldest). The structs are then compared by
    generated higher-order expressions. The aggregate is a partial one (``max_by`` on both sides of the shuffle), so repeated
    rows and a hot key are folded before the shuffle and no group is ever gathered.

    Result: the key columns, ``difference`` (``missing_in_copy``, ``missing_in_main`` or a field name), ``main_value`` and
    ``copy_value`` (both as string; null for a missing side).

    Defined cases: a null key part equals a null key part only; a null field equals null only; rows repeated exactly give one
    row; two rows of equal version are told apart by their field values (the greatest stands), so the result does not depend on
    row order; an empty side makes every entry of the other one missing; two empty sides give no row. Further columns of either side
    are ignored, whatever they are called. Values are compared as stored.
    """
    columns = [*keys, *fields]

    def tagged(df: DataFrame, side: str) -> DataFrame:
        order = F.struct(*[df[c].alias(f"v{i}") for i, c in enumerate(version)], *[df[c].alias(f"f{i}") for i, c in enumerate(fields)])
        return df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keys)], F.lit(side).alias("side"), order.alias("row"))

    both = tagged(main, "m").unionByName(tagged(copy, "c"))
    key_names = [f"k{i}" for i in range(len(keys))]
    sides = both.groupBy(*key_names).agg(
        F.max(F.when(F.col("side") == "m", F.col("row"))).alias("m"),
        F.max(F.when(F.col("side") == "c", F.col("row"))).alias("c"),
    )

    def entry(name: Column, left: Column, right: Column) -> Column:
        return F.struct(name.alias("difference"), left.cast("string").alias("main_value"), right.cast("string").alias("copy_value"))

    none = F.lit(None).cast("string")
    compared = F.array(
        *[
            F.when(~F.col(f"m.f{i}").eqNullSafe(F.col(f"c.f{i}")), entry(F.lit(name), F.col(f"m.f{i}"), F.col(f"c.f{i}")))
            for i, name in enumerate(fields)
        ]
    )
    differences = (
        F.when(F.col("c").isNull(), F.array(entry(F.lit(MISSING_IN_COPY), none, none)))
        .when(F.col("m").isNull(), F.array(entry(F.lit(MISSING_IN_MAIN), none, none)))
        .otherwise(F.filter(compared, lambda d: d.isNotNull()))
    )
    found = sides.select(*key_names, F.explode(differences).alias("d"))
    return found.select(*[F.col(k).alias(name) for k, name in zip(key_names, keys, strict=True)], "d.difference", "d.main_value", "d.copy_value")


def difference_summary(differences: DataFrame) -> DataFrame:
    """Number of differences of each kind. An empty report gives no row."""
    return differences.groupBy("difference").agg(F.count(F.lit(1)).alias("entries"))
