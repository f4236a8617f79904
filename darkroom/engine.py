"""The engine: scan, plan, apply, verify, clean up and report on real folders."""

from __future__ import annotations

import csv
import dataclasses
import io
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.config import Config
from darkroom.functions import dates, names, paths, tags
from darkroom.functions.instants import staged
from darkroom.operators import actions, collisions, exporting, reports, verification
from darkroom.operators.discovery import run_entries
from darkroom.session import broadcast_if_small, build_session, materialise, stored
from darkroom.sources import fstree, metadata, records

SQL_FUNCTIONS = {
    "path_name(p STRING) RETURNS STRING": "substring_index(p, '/', -1)",
    "path_suffix(p STRING) RETURNS STRING": "regexp_extract(substring_index(p, '/', -1), '^.*[^.](\\\\.[^.]+)$', 1)",
    "destination_folder(d TIMESTAMP_NTZ, structure STRING) RETURNS STRING": "CASE structure WHEN 'YYYY' THEN date_format(d, 'yyyy') WHEN 'YYYY/MM/DD' THEN date_format(d, 'yyyy/MM/dd') ELSE date_format(d, 'yyyy/MM') END",
}


def scan_directory(path: str, recursive: bool = True, include_videos: bool = True, limit: int | None = None) -> DataFrame:
    """Scan with default settings."""
    base = Config()
    general = dataclasses.replace(base.general, recursive=recursive, include_videos=include_videos)
    return Engine(config=dataclasses.replace(base, general=general, scan=dataclasses.replace(base.scan, limit=limit))).scan(path)


class Engine:
    def __init__(self, spark: SparkSession | None = None, config: Config | None = None, rules: records.TagRules | None = None):
        self.spark = spark or build_session()
        self.config = config or Config()
        self.rules = rules
        self.register_functions()

    # --- scan -------------------------------------------------------------------------------------------------------
    def list(self, root: str) -> DataFrame:
        general = self.config.general
        return fstree.list_files(self.spark, str(Path(root).resolve()), general.recursive, not general.ignore_hidden_files, self.config.extensions, self.config.scan.limit)

    def file_type(self, path):  # noqa: ANN001
        scan, ext = self.config.scan, paths.extension(path)
        return F.when(ext.isin(*scan.image_extensions), "image").when(ext.isin(*scan.video_extensions), "video").when(ext.isin(*scan.raw_extensions), "raw").otherwise("unknown")

    def scan(self, root: str) -> DataFrame:
        """One row per file: dates by the configured cascade, folder tag, mismatch and error category. Embedded data is only read from files
        whose type has it; Python readers see no other rows."""
        cfg, path = self.config, F.col("path")
        listed = self.list(root).withColumn("file_type", self.file_type(path))
        listed = listed.join(metadata.read_exif(listed.filter("file_type <> 'video'")).select("path", F.col("best_date").alias("exif_date"), "exif_error"), "path", "left")
        if cfg.video_metadata.enabled:
            video = cfg.video_metadata
            listed = listed.join(metadata.read_video_dates(listed.filter("file_type = 'video'"), video.provider, video.ffprobe_path, video.fallback_to_hachoir), "path", "left")
        else:
            listed = listed.withColumn("video_date", F.lit(None).cast("timestamp_ntz"))
        from_name = dates.filename_date(paths.stem(path), cfg.filename_date.year_cutoff, cfg.filename_date.enabled)
        listed = staged(listed, {"filename_date": from_name, "folder_date": dates.nearest_folder_date(path), "source_folder_name": paths.ancestor(path, 1)})
        sources = {
            "exif": F.col("exif_date"),
            "video_metadata": F.col("video_date"),
            "filename": F.col("filename_date"),
            "filesystem": F.timestamp_micros("mtime_us").cast("timestamp_ntz"),
            "folder_name": F.col("folder_date"),
        }
        found = staged(listed, {"best": dates.cascade(sources, cfg.date_priority)})
        if self.rules is not None:
            table = self.rules.frame(self.spark).withColumnRenamed("folder_name", "source_folder_name")
            found = found.join(broadcast_if_small(table), "source_folder_name", "left")
        else:
            found = found.withColumns({"decision": F.lit(None).cast("string"), "alias": F.lit(None).cast("string")})
        settings = cfg.folder_tags
        verdict = tags.classify_folder(F.col("source_folder_name"), settings.ignore_list, settings.force_list, settings.min_length, settings.max_length, F.col("decision"))
        found = staged(found, {"verdict": verdict, "tag": tags.format_tag(F.col("source_folder_name"), settings.max_length, F.col("alias"))})
        present = tags.tag_in_name(paths.file_name(path), F.when(F.col("verdict.usable"), F.col("tag")), settings.distance_threshold)
        days = dates.mismatch_days(F.col("best.date"), F.col("filename_date"))
        usable = F.col("verdict.usable") & ~F.col("present")
        out = found.withColumn("present", present).withColumn("days", F.when(F.lit(cfg.date_mismatch.enabled), days))
        kind = F.col("file_type")
        category = F.when(F.col("best.date").isNull(), F.when(kind == "video", "no_video_metadata").when(kind.isin("image", "raw"), "no_exif_date").otherwise("no_date_found"))
        none = F.lit(None).cast("string")
        return out.select(
            F.col("path").alias("source_path"), "file_type", "size_bytes", F.col("best.date").alias("detected_date"), F.col("best.source").alias("date_source"),
            none.alias("destination_folder"), none.alias("destination_filename"), "source_folder_name",
            F.when(usable, F.array("tag")).otherwise(F.array().cast("array<string>")).alias("folder_tags"), F.array("verdict.reason").alias("folder_tag_reasons"),
            none.alias("proposed_destination_folder"), none.alias("proposed_filename"), F.lit(False).alias("needs_rename"), (F.col("best.source") == "exif").alias("has_exif"), F.coalesce("exif_error", "error").alias("exif_error"),
            "filename_date", F.coalesce(F.col("days") > cfg.date_mismatch.threshold_days, F.lit(False)).alias("date_mismatch"), F.col("days").alias("date_mismatch_days"),
            none.alias("file_hash"), none.alias("duplicate_of"), F.lit(False).alias("is_duplicate"), F.col("video_date").alias("video_metadata_date"), category.alias("error_category"),
        )

    def summary(self, files: DataFrame) -> dict:
        """The statistics of a scan or export as one document."""
        m = reports.file_measures(files).first()
        size = files.sparkSession.range(1).select(names.human_size(F.lit(int(m["bytes"] or 0))).alias("t")).first()["t"]
        dated = files.filter("detected_date is not null")
        ext = F.coalesce(F.nullif(paths.extension(F.col("source_path")), F.lit("")), F.lit("no_extension"))
        return {
            "total_files": m["files"], "total_size_bytes": int(m["bytes"] or 0), "total_size_human": size, "dated_files": m["dated"], "undated_files": m["undated"],
            "date_sources": reports.as_map(reports.count_by(dated, F.col("date_source"))), "files_by_year": reports.as_map(reports.count_by(dated, F.date_format("detected_date", "yyyy"))),
            "files_by_extension": reports.as_map(reports.count_by(files, ext)), "date_mismatch_count": m["mismatches"], "duplicate_count": m["duplicates"],
            "errors_by_category": reports.as_map(reports.count_by(files.filter("error_category is not null"), F.col("error_category"))) or None,
        }

    # --- plan and apply ---------------------------------------------------------------------------------------------
    def plan(self, files: DataFrame, root: str, operation: str = "copy") -> DataFrame:
        cfg = self.config
        return exporting.plan_operations(files, root, cfg.sorting.folder_structure, operation, cfg.renaming.enabled, cfg.folder_tags.enabled, self.naming)

    @property
    def naming(self) -> dict:
        """The configured form of new names."""
        r = self.config.renaming
        return {"pattern": r.pattern, "date_format": r.date_format, "time_format": r.time_format, "tag_format": r.tag_part_format, "lowercase_ext": r.lowercase_extensions}

    def resolved(self, files: DataFrame, root: str, operation: str = "copy") -> DataFrame:
        """The plan with collisions resolved against what is on disk. Only contested files and those of a size seen more than once are hashed."""
        planned = materialise(self.plan(files, root, operation))  # read several times below
        todo = planned.filter("operation <> 'skip'").select(F.col("source_path").alias("source"), F.col("destination_path").alias("destination"))
        taken = fstree.list_files(self.spark, root, hidden=True).filter("error is null").select(F.col("path").alias("destination")) if Path(root).is_dir() else todo.select("destination").limit(0)
        keyed, on_disk = collisions.keyed(todo, taken)
        contested = keyed.groupBy("key").count().filter("count > 1").select("key").union(on_disk.select("key")).distinct()
        hash_of = lambda df, c: metadata.read_hashes(df.select(F.col(c).alias("path")), self.config.duplicates.hashing_algorithm)
        hashes = hash_of(keyed.join(contested, "key", "left_semi"), "source").withColumnRenamed("path", "source")
        there = on_disk.join(keyed.select("key").distinct(), "key", "left_semi")
        disk = there.select("destination").join(hash_of(there, "destination").withColumnRenamed("path", "destination"), "destination", "left")
        policy = self.config.duplicates.on_collision
        policy = policy if self.config.duplicates.enabled or policy != "check_hash" else "rename"
        settled = collisions.resolve_collisions(todo.join(hashes, "source", "left"), disk, policy)
        ops = settled.select(
            F.col("source").alias("source_path"), F.when(F.col("final_destination").isNotNull(), F.lit(operation)).otherwise("skip").alias("operation"),
            F.col("final_destination").alias("destination_path"), F.when(F.col("final_destination").isNull(), F.col("outcome")).alias("reason"),
        )
        return ops.unionByName(planned.filter("operation = 'skip'"))

    def apply(self, source: str, destination: str, dry_run: bool = True, move: bool = False, state: str | None = None, write_record: bool | None = None) -> records.RunRecord:
        """Plans, writes the run record and, unless dry, carries it out. The plan is stored first, so no retry can plan anew; files are copied or moved by the executors,
        which must see both folders, and ``results`` of the record has a row a file. The record is one document, as its format wants; without it
        (``write_record``) nothing is gathered."""
        operation = "move" if move and not dry_run else "copy"
        files = self.scan(source)
        planned = stored(self.plan(files, destination) if dry_run else self.resolved(files, destination, operation))
        cfg = self.config
        mode = "dry_run" if dry_run else "live_move" if move else "live_copy"
        signature = {"folder_structure": cfg.sorting.folder_structure, "renaming_enabled": cfg.renaming.enabled, "renaming_pattern": cfg.renaming.pattern, "folder_tags_enabled": cfg.folder_tags.enabled, "on_collision": cfg.duplicates.on_collision}
        folder = Path(state or cfg.verify.state_dir) / cfg.verify.run_record_dir
        record = records.RunRecord(folder, str(Path(source).resolve()), str(Path(destination).resolve()), mode, signature)
        if cfg.verify.write_run_record if write_record is None else write_record:
            with record:
                for r in planned.orderBy("source_path").toLocalIterator():
                    record.add(r["operation"], r["source_path"], r["destination_path"], r["reason"])
        todo = planned.filter("operation <> 'skip'").select(F.col("source_path").alias("source"), F.col("destination_path").alias("destination"))
        record.planned, record.results = planned, stored(actions.carry_out(todo, move)) if not dry_run else None
        record.failed = 0 if dry_run else record.results.filter("not ok").count()
        return record

    # --- verify and clean up ----------------------------------------------------------------------------------------
    def verify(self, runs: DataFrame, algorithm: str = "sha256") -> DataFrame:
        """Status of every entry of the runs, by reading the files named in them."""
        entries = run_entries(runs).select("run_id", "source_path", "destination_path", "operation")
        copies = entries.filter("operation = 'copy'")
        deep = algorithm == "sha256"
        sources = metadata.read_listing(copies.select(F.col("source_path").alias("path")).distinct(), contents=deep)
        targets = metadata.read_listing(copies.select(F.col("destination_path").alias("path")).distinct(), contents=deep)
        return verification.explained(verification.verify(entries, sources, targets, algorithm), algorithm)

    def verify_reconstructed(self, source: str, destination: str, algorithm: str = "sha256") -> DataFrame:
        """Without a run record: the plan is made again and compared with the destination; with ``content_search_on_reconstruct`` a file missing at its
        expected place is looked for by extension, size and hash. Renames after collisions are not known, so a file that lost its place
        is compared with the winner's."""
        planned = materialise(self.plan(self.scan(source), destination).filter("operation = 'copy'"))
        runs = planned.select(F.lit(None).cast("string").alias("run_id"), "source_path", "destination_path", "operation")
        deep = algorithm == "sha256"
        sources = metadata.read_listing(runs.select(F.col("source_path").alias("path")), contents=deep)
        found = fstree.list_files(self.spark, destination, hidden=True).filter("error is null") if Path(destination).is_dir() else fstree.list_files(self.spark, source).limit(0)
        sources, targets = stored(sources), stored(metadata.read_listing(found, contents=deep))
        checked = stored(verification.explained(verification.verify(runs, sources, targets, algorithm), algorithm))
        if self.config.verify.content_search_on_reconstruct and deep:
            lost = sources.join(checked.filter("status = 'missing_destination'").select(F.col("source_path").alias("path")), "path", "left_semi")
            hits = verification.search_content(lost, targets).filter("match is not null").select(F.col("path").alias("source_path"), "match")
            found_by_content = F.col("match").isNotNull()
            checked = checked.join(hits, "source_path", "left").withColumns(
                {
                    "status": F.when(found_by_content, "ok_existing_duplicate").otherwise(F.col("status")),
                    "match_type": F.when(found_by_content, "content_search").otherwise(F.col("match_type")),
                    "actual_destination_path": F.coalesce("match", "actual_destination_path"),
                    "destination_hash": F.when(found_by_content, F.col("source_hash")).otherwise(F.col("destination_hash")),
                }
            ).drop("match")
        return checked

    def save_verification(self, report: DataFrame, run_id: str | None, roots: tuple[str, str], state: str | None = None, seconds: float = 0.0) -> Path:
        """Writes a verification as one document, as its format wants; a report without run is a reconstructed one."""
        report = stored(report)
        wanted = ["source_path", F.col("destination_path").alias("expected_destination_path"), "actual_destination_path", "status", "match_type", "hash_algorithm", "source_hash", "destination_hash", "error"]
        entries = [r.asDict() for r in report.select(*wanted).orderBy("source_path").toLocalIterator()]
        summary = verification.status_counts(report).first().asDict()
        algorithm = (report.select("hash_algorithm").first() or [self.config.verify.algorithm])[0]
        document = {"verify_id": records.new_id(), "created_at": datetime.now().isoformat(), "source_root": roots[0], "destination_root": roots[1], "input_source": "run_record" if run_id else "reconstructed", "run_id": run_id, "hash_algorithm": algorithm, "entries": entries, "summary": summary, "duration_seconds": seconds}
        return records.write_verification(Path(state or self.config.verify.state_dir) / self.config.verify.verification_dir, document)

    def clean_up(self, report: DataFrame, dry_run: bool = True) -> dict:
        """Deletes the sources of eligible entries on the executors, where the destination still is; counts and freed bytes."""
        eligible = verification.cleanup_eligible(report, not self.config.verify.allow_cleanup_on_quick)
        todo = eligible.select(F.col("source_path").alias("source"), F.col("destination_path").alias("destination"))
        return actions.deletion_totals(stored(actions.delete_files(todo, dry_run)))

    # --- export -----------------------------------------------------------------------------------------------------
    def export_json(self, files: DataFrame, root: str, output: str | None = None, statistics: bool = True, pretty: bool = True) -> str:
        """One document: time, folder, count, files and statistics. For large libraries write ``exporting.json_rows`` instead."""
        rows = [json.loads(r["json"]) for r in exporting.json_rows(files).orderBy("path").collect()]
        document = {"export_timestamp": datetime.now().isoformat(), "source_directory": root, "file_count": len(rows), "files": rows}
        if statistics:
            document["statistics"] = self.summary(files)
        text = json.dumps(document, ensure_ascii=False, indent=2 if pretty else None)
        if output:
            Path(output).write_text(text, encoding="utf-8")
        return text

    def export_parts(self, files: DataFrame, folder: str, form: str = "json") -> None:
        """The export as a folder of part files, written by the executors: JSON lines or CSV with header. Nothing is gathered."""
        if form == "json":
            exporting.json_rows(files).select("json").write.mode("errorifexists").text(folder)
        else:
            exporting.csv_rows(files).write.mode("errorifexists").option("header", "true").option("emptyValue", "").option("escape", '"').csv(folder)

    def export_csv(self, files: DataFrame, output: str | None = None) -> str:
        out = io.StringIO(newline="")
        writer = csv.writer(out)
        writer.writerow(exporting.COLUMNS)
        for row in exporting.csv_rows(files).orderBy("path").toLocalIterator():
            writer.writerow(list(row))
        if output:
            Path(output).write_text(out.getvalue(), encoding="utf-8", newline="")
        return out.getvalue()

    # --- SQL --------------------------------------------------------------------------------------------------------
    def register_functions(self) -> None:
        """SQL names for the expressions (as SQL functions where they are plain SQL) and the near-match UDF."""
        self.spark.udf.register("tag_in_name", tags._tag_in_name)
        for head, body in SQL_FUNCTIONS.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    def register_views(self, **frames: DataFrame) -> None:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
