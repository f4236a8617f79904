"""Queries of the general training-data operators over the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators.diffing import compare_copies, difference_summary
from darkroom.operators.timeline import resolve_readings
from darkroom.session import table

VERIFY_FIELDS = ["source_hash", "destination_hash", "expected_destination_path", "status"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Date values that denote exactly one instant, with that instant."""
    resolved = resolve_readings(table(spark, d, "date_readings"), table(spark, d, "devices"), keep_unread=False)
    return resolved.filter("determinate").select("reading_id", "field_name", F.col("chosen.instant_us").alias("instant_us"))


def p3_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every date value with the interpretation chosen, ambiguous ones included, by notation."""
    resolved = resolve_readings(table(spark, d, "date_readings"), table(spark, d, "devices"))
    return resolved.groupBy("field_name", F.coalesce("chosen.fmt", F.lit("none")).alias("notation"), F.size("candidates").alias("interpretations")).agg(
        F.count(F.lit(1)).alias("values_read"), F.sum(F.col("determinate").cast("bigint")).alias("determinate")
    )


def _verify_differences(spark: SparkSession, d: str) -> DataFrame:
    return compare_copies(
        table(spark, d, "verify_entries"), table(spark, d, "verify_entries_copy"), ["verify_id", "source_path"], VERIFY_FIELDS, ["recorded_at"]
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries absent on one side and fields that differ between the two copies."""
    return _verify_differences(spark, d).select("verify_id", "source_path", "difference")


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number of entries per kind of difference."""
    return difference_summary(_verify_differences(spark, d))


_LATEST = """
WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verify_id, source_path ORDER BY recorded_at DESC NULLS LAST,
    source_hash DESC NULLS LAST, destination_hash DESC NULLS LAST, expected_destination_path DESC NULLS LAST, status DESC NULLS LAST) AS rn
    FROM verify_entries) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verify_id, source_path ORDER BY recorded_at DESC NULLS LAST,
    source_hash DESC NULLS LAST, destination_hash DESC NULLS LAST, expected_destination_path DESC NULLS LAST, status DESC NULLS LAST) AS rn
    FROM verify_entries_copy) WHERE rn = 1),
j AS (SELECT coalesce(m.verify_id, c.verify_id) AS verify_id, coalesce(m.source_path, c.source_path) AS source_path, m.rn AS in_m, c.rn AS in_c,
    m.source_hash AS m1, c.source_hash AS c1, m.destination_hash AS m2, c.destination_hash AS c2,
    m.expected_destination_path AS m3, c.expected_destination_path AS c3, m.status AS m4, c.status AS c4
    FROM m FULL JOIN c ON m.verify_id IS NOT DISTINCT FROM c.verify_id AND m.source_path IS NOT DISTINCT FROM c.source_path),
d AS (SELECT verify_id, source_path, 'missing_in_copy' AS difference FROM j WHERE in_c IS NULL
  UNION ALL SELECT verify_id, source_path, 'missing_in_main' FROM j WHERE in_m IS NULL
  UNION ALL SELECT verify_id, source_path, 'source_hash' FROM j WHERE in_m = 1 AND in_c = 1 AND m1 IS DISTINCT FROM c1
  UNION ALL SELECT verify_id, source_path, 'destination_hash' FROM j WHERE in_m = 1 AND in_c = 1 AND m2 IS DISTINCT FROM c2
  UNION ALL SELECT verify_id, source_path, 'expected_destination_path' FROM j WHERE in_m = 1 AND in_c = 1 AND m3 IS DISTINCT FROM c3
  UNION ALL SELECT verify_id, source_path, 'status' FROM j WHERE in_m = 1 AND in_c = 1 AND m4 IS DISTINCT FROM c4)
"""

QUERIES = {"p3_found": p3_found, "p3_resolved": p3_resolved, "p4_found": p4_found, "p4_summary": p4_summary}
ORACLES = {
    "p4_found": _LATEST + "SELECT verify_id, source_path, difference FROM d",
    "p4_summary": _LATEST + "SELECT difference, count(*) AS entries FROM d GROUP BY difference",
}
