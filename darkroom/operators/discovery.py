"""Run and verification records: entries, summaries, discovery, lookup, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODE_TEXTS = {"dry_run": "dry-run", "live_copy": "copy", "live_move": "move"}


def run_entries(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "mode", F.explode("entries").alias("e")).select("run_id", "mode", "e.*")


def run_summary(entries: DataFrame) -> DataFrame:
    op = F.col("operation")
    return entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(op == "copy").alias("copied_files"), F.count_if(op == "move").alias("moved_files"), F.count_if(op == "skip").alias("skipped_files")
    )


def mode_text(mode: Column) -> Column:
    out = mode
    for value, text in MODE_TEXTS.items():
        out = F.when(mode == value, text).otherwise(out)
    return out


def run_file_name(run_id: Column, mode: Column) -> Column:
    return F.concat(run_id, F.when(mode == "dry_run", "_apply_dryrun.json").otherwise("_apply.json"))


def discover_runs(runs: DataFrame, source_prefix: str | None = None, destination_prefix: str | None = None, include_dry_runs: bool = False, limit: int = 20) -> DataFrame:
    """Newest runs first; prefixes are plain string prefixes; a missing mode counts as a dry run."""
    kept = runs
    if source_prefix:
        kept = kept.filter(F.col("source_root").startswith(source_prefix))
    if destination_prefix:
        kept = kept.filter(F.col("destination_root").startswith(destination_prefix))
    if not include_dry_runs:
        kept = kept.filter(F.coalesce("mode", F.lit("dry_run")) != "dry_run")
    columns = ["run_id", "created_at", "source_root", "destination_root", "mode"]
    return kept.select(*columns, mode_text(F.col("mode")).alias("mode_text")).orderBy(F.col("created_at").desc_nulls_last(), F.col("run_id").desc()).limit(limit)


def discover_verifications(entries: DataFrame, limit: int = 20) -> DataFrame:
    s = F.col("status")
    counted = entries.groupBy("verify_id").agg(
        F.min("run_id").alias("run_id"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "ok_existing_duplicate").alias("duplicates"), F.count_if(s == "mismatch").alias("mismatches"),
        F.count_if(s.isin("missing_destination", "missing_source")).alias("missing"), F.count(F.lit(1)).alias("total"),
    )
    return counted.orderBy(F.col("verify_id").desc()).limit(limit)


def find_by_id(records: DataFrame, column: str, value: str) -> DataFrame:
    return records.filter(F.col(column) == value)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(1)


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """A folder is either used or ignored: a change replaces what the folder had."""
    return rules.join(changes.select("folder_name").distinct(), "folder_name", "left_anti").unionByName(changes)
