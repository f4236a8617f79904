"""Verification of copies by joins on path and content, and what may be cleaned up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import paths
from darkroom.session import salted_join

STATUSES = ["ok", "ok_existing_duplicate", "mismatch", "missing_destination", "missing_source", "error", "skipped"]


def status_of(source_found: Column, destination_found: Column, source: Column, destination: Column, quick: bool = False) -> Column:
    """The status ladder. ``source``/``destination`` are hashes, or sizes in quick mode."""
    ladder = F.when(~source_found, "missing_source").when(~destination_found, "missing_destination")
    if not quick:
        ladder = ladder.when(source.isNull() | destination.isNull(), "error")
    return ladder.when(source == destination, "ok").otherwise("mismatch")


def verify(entries: DataFrame, sources: DataFrame, destinations: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Each run entry (source_path, destination_path, operation) with its status.

    ``sources`` and ``destinations`` are listings (path, size_bytes, file_hash); a path listed several times counts once, with its least hash.
    Copies are compared; moved files are reported as missing at the source without a look; other operations are left out.
    """
    if algorithm not in ("sha256", "quick"):
        raise ValueError(f"unknown algorithm {algorithm!r}")

    def listing(df: DataFrame, side: str) -> DataFrame:
        one = df.filter("path is not null").groupBy("path").agg(F.min("size_bytes").alias(f"{side}_size"), F.min("file_hash").alias(f"{side}_hash"))
        return one.select(F.col("path").alias(f"{side}_path"), f"{side}_size", f"{side}_hash", F.lit(True).alias(f"{side}_found"))

    copies = entries.filter(F.col("operation") == "copy")
    joined = copies.join(listing(sources, "src").withColumnRenamed("src_path", "source_path"), "source_path", "left")
    joined = joined.join(listing(destinations, "dst").withColumnRenamed("dst_path", "destination_path"), "destination_path", "left")
    found = lambda c: F.coalesce(c, F.lit(False))
    values = ("src_size", "dst_size") if algorithm == "quick" else ("src_hash", "dst_hash")
    status = status_of(found("src_found"), found("dst_found"), F.col(values[0]), F.col(values[1]), algorithm == "quick")
    columns = [c for c in entries.columns if c not in ("source_path", "destination_path", "operation")]
    compared = joined.select(*columns, "source_path", "destination_path", status.alias("status"), F.col("src_hash").alias("source_hash"), F.col("dst_hash").alias("destination_hash"))
    none = F.lit(None).cast("string")
    moved = entries.filter(F.col("operation") == "move").select(*columns, "source_path", "destination_path", F.lit("missing_source").alias("status"), none.alias("source_hash"), none.alias("destination_hash"))
    return compared.unionByName(moved)


def explained(checked: DataFrame, algorithm: str) -> DataFrame:
    """Adds what a report says of each entry: ``hash_algorithm``, ``match_type``, ``actual_destination_path`` (where a file was found) and ``error``."""
    status = F.col("status")
    error = F.when((status == "mismatch") & F.lit(algorithm == "quick"), "Size mismatch").when(
        status == "error", F.when(F.col("source_hash").isNull(), "Could not compute source hash").otherwise("Could not compute destination hash")
    )
    found = F.when(status.isin("ok", "ok_existing_duplicate", "mismatch", "error"), F.col("destination_path"))
    return checked.withColumns({"hash_algorithm": F.lit(algorithm), "match_type": F.lit("expected_path"), "actual_destination_path": found, "error": error})


def search_content(files: DataFrame, destinations: DataFrame) -> DataFrame:
    """Files (path, size_bytes, file_hash) found by content among the destinations: ``path``, ``match`` (the first path with the same lower-case extension,
    size and hash, other than the file itself) or null, and ``status``."""
    ext = lambda df: df.withColumn("ext", paths.extension(F.col("path")))
    there = ext(destinations).filter("file_hash is not null").select("ext", "size_bytes", "file_hash", "path").distinct()
    two = there.groupBy("ext", "size_bytes", "file_hash").agg(F.min("path").alias("p1"))
    rest = there.join(two, ["ext", "size_bytes", "file_hash"]).filter("path <> p1").groupBy("ext", "size_bytes", "file_hash").agg(F.min("path").alias("p2"))
    best = two.join(rest, ["ext", "size_bytes", "file_hash"], "left")
    found = salted_join(ext(files), best, ["ext", "size_bytes", "file_hash"], "left")
    match = F.when(F.col("path") == F.col("p1"), F.col("p2")).otherwise(F.col("p1"))
    return found.select("path", match.alias("match"), F.when(match.isNotNull(), "ok_existing_duplicate").otherwise("missing_destination").alias("status"))


def status_counts(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries in all and per status."""
    counts = [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]]
    return report.groupBy(*by).agg(*counts) if by else report.agg(*counts)


def cleanup_eligible(report: DataFrame, require_sha256: bool = True) -> DataFrame:
    """Entries whose source may be deleted: verified, and by content."""
    kept = report.filter(F.col("status").isin("ok", "ok_existing_duplicate"))
    return kept.filter(F.col("hash_algorithm") == "sha256") if require_sha256 else kept


def still_there(eligible: DataFrame, sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """Eligible entries whose source still exists, and whose destination does if one is recorded."""
    kept = eligible.join(sources.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi")
    target = F.coalesce("actual_destination_path", "expected_destination_path")
    listed = destinations.select(F.col("path").alias("__target")).distinct()
    some = kept.withColumn("__target", target)
    return some.filter("__target is not null").join(listed, "__target", "left_semi").select(*kept.columns).unionByName(some.filter("__target is null").select(*kept.columns))
