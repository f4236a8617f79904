"""Grouped reports over file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_measures(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files, dated and undated ones, bytes, mismatches, duplicates and errors, in one pass."""
    dated = F.count("detected_date")
    n = F.count(F.lit(1))
    measures = [
        n.alias("files"), dated.alias("dated"), (n - dated).alias("undated"), F.sum("size_bytes").alias("bytes"),
        F.count_if(F.col("date_mismatch")).alias("mismatches"), F.count_if(F.col("is_duplicate")).alias("duplicates"), F.count("error_category").alias("with_errors"),
    ]
    return files.groupBy(*by).agg(*measures) if by else files.agg(*measures)


def count_by(files: DataFrame, value: Column) -> DataFrame:
    return files.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("files"))


def error_categories(files: DataFrame) -> DataFrame:
    """Files per error category; an undated file without one counts as ``no_date_found``; a date mismatch counts besides."""
    category = F.coalesce("error_category", F.when(F.col("detected_date").isNull(), F.lit("no_date_found")))
    both = F.array_compact(F.array(category, F.when(F.col("date_mismatch"), F.lit("date_mismatch"))))
    return files.select(F.explode(both).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("files"))


def detected_tags(files: DataFrame) -> DataFrame:
    """Distinct tags of each scan, sorted. Made distinct before they are listed, so the list is as long as the scan's vocabulary."""
    one = files.select("scan_id", F.explode("folder_tags").alias("tag")).filter("tag <> ''").distinct()
    return one.groupBy("scan_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def listing_with_samples(rows: DataFrame, key: str, samples: int = 3) -> DataFrame:
    """Files per key with the first ``samples`` paths. Null keys and paths are left out; repeated rows count once."""
    one = rows.filter(F.col(key).isNotNull() & F.col("source_path").isNotNull()).select(key, "source_path").distinct()
    counts = one.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    first = one.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("source_path"))).filter(F.col("n") <= samples)  # each task keeps that many a key before the shuffle
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list("source_path")).alias("samples"))  # at most ``samples`` each
    return counts.join(listed, key)


def as_map(counts: DataFrame, key: str = "value", value: str = "files") -> dict[str, int]:
    """A small count table as a sorted dict for a report document."""
    return dict(sorted((str(r[key]), int(r[value])) for r in counts.collect()))
