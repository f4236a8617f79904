"""JSON documents of runs and verifications, and YAML tag rules."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = """run_id string, created_at string, source_root string, destination_root string, mode string,
 config_signature struct<folder_structure:string,renaming_enabled:boolean,renaming_pattern:string,folder_tags_enabled:boolean,on_collision:string>,
 entries array<struct<source_path:string,destination_path:string,operation:string,reason:string>>,
 summary struct<total_files:bigint,copied_files:bigint,moved_files:bigint,skipped_files:bigint,error_files:bigint,duration_seconds:double>, _corrupt_record string"""
VERIFICATION_SCHEMA = """verify_id string, created_at string, source_root string, destination_root string, input_source string, run_id string, hash_algorithm string,
 entries array<struct<source_path:string,expected_destination_path:string,actual_destination_path:string,status:string,match_type:string,hash_algorithm:string,source_hash:string,destination_hash:string,error:string>>,
 duration_seconds double, _corrupt_record string"""
_REQUIRED = ["run_id", "created_at", "source_root", "destination_root", "mode", "config_signature"]


def _read(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of a folder; documents that are no JSON or lack a required field are skipped."""
    runs = _read(spark, folder, "*_apply*.json", RUN_SCHEMA)
    ok = F.col("_corrupt_record").isNull()
    for name in _REQUIRED:
        ok = ok & F.col(name).isNotNull()
    return runs.filter(ok).drop("_corrupt_record")


def read_verifications(spark: SparkSession, folder: str) -> DataFrame:
    found = _read(spark, folder, "*_verify.json", VERIFICATION_SCHEMA)
    return found.filter("_corrupt_record is null and verify_id is not null").drop("_corrupt_record")


def new_id(now: datetime | None = None) -> str:
    return f"{now or datetime.now():%Y%m%d_%H%M%S}_{uuid4().hex[:4]}"


def summarise(entries: list[dict], duration: float = 0.0) -> dict:
    count = lambda op: sum(e["operation"] == op for e in entries)
    return {"total_files": len(entries), "copied_files": count("copy"), "moved_files": count("move"), "skipped_files": count("skip"), "error_files": 0, "duration_seconds": duration}


class RunRecord:
    """Collects the operations of one run and writes them as one document at the end, unless an exception ends it."""

    def __init__(self, folder: str | Path, source_root: str, destination_root: str, mode: str, signature: dict, run_id: str | None = None):
        if mode not in ("dry_run", "live_copy", "live_move"):
            raise ValueError(f"unknown mode {mode!r}")
        self.folder, self.path = Path(folder), None
        self.started = datetime.now()
        self.document = {"run_id": run_id or new_id(self.started), "created_at": self.started.isoformat(), "source_root": source_root, "destination_root": destination_root, "mode": mode, "config_signature": signature}
        self.entries: list[dict] = []

    def add(self, operation: str, source: str, destination: str | None = None, reason: str | None = None) -> None:
        self.entries.append({"source_path": source, "destination_path": destination, "operation": operation, "reason": reason})

    def __enter__(self) -> RunRecord:
        return self

    def __exit__(self, kind, value, trace) -> None:  # noqa: ANN001
        if kind is not None:
            return
        self.folder.mkdir(parents=True, exist_ok=True)
        suffix = "_apply_dryrun.json" if self.document["mode"] == "dry_run" else "_apply.json"
        self.path = self.folder / (self.document["run_id"] + suffix)
        summary = summarise(self.entries, (datetime.now() - self.started).total_seconds())
        self.path.write_text(json.dumps(self.document | {"entries": self.entries, "summary": summary}, ensure_ascii=False, indent=2), encoding="utf-8")


def write_verification(folder: str | Path, document: dict) -> Path:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    path = out / f"{document['verify_id']}_verify.json"
    path.write_text(json.dumps(document, ensure_ascii=False, indent=2), encoding="utf-8")
    return path


class TagRules:
    """Folder decisions in a YAML file: a folder is used (perhaps under an alias) or ignored, never both."""

    def __init__(self, path: str | Path = ".darkroom/tag_rules.yaml"):
        self.path = Path(path)
        self.use: set[str] = set()
        self.ignore: set[str] = set()
        self.aliases: dict[str, str] = {}
        if self.path.is_file():
            import yaml

            data = yaml.safe_load(self.path.read_text(encoding="utf-8")) or {}
            self.use, self.ignore, self.aliases = set(data.get("use") or ()), set(data.get("ignore") or ()), dict(data.get("aliases") or {})

    def add_use(self, folder: str, alias: str | None = None) -> None:
        self.ignore.discard(folder)
        self.use.add(folder)
        if alias:
            self.aliases[folder] = alias

    def add_ignore(self, folder: str) -> None:
        self.use.discard(folder)
        self.aliases.pop(folder, None)
        self.ignore.add(folder)

    def clear(self, folder: str) -> bool:
        known = folder in self.use or folder in self.ignore or folder in self.aliases
        self.use.discard(folder), self.ignore.discard(folder), self.aliases.pop(folder, None)
        return known

    def save(self) -> None:
        import yaml

        self.path.parent.mkdir(parents=True, exist_ok=True)
        data = {"version": 1, "updated_at": datetime.now().isoformat(), "use": sorted(self.use), "ignore": sorted(self.ignore), "aliases": dict(sorted(self.aliases.items()))}
        self.path.write_text(yaml.safe_dump(data, allow_unicode=True, sort_keys=False), encoding="utf-8")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, "use", self.aliases.get(f)) for f in sorted(self.use)] + [(f, "ignore", None) for f in sorted(self.ignore)]
        return spark.createDataFrame(rows, "folder_name string, decision string, alias string")
