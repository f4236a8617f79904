"""Command line: scan, apply, verify, cleanup, export, tags, config, doctor, version."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import logging.handlers
import sys
from pathlib import Path

from pyspark.sql import functions as F

import darkroom
from darkroom import config as configuration
from darkroom.engine import Engine
from darkroom.operators import discovery, reports
from darkroom.sources import metadata, records


def set_up_logging(section: configuration.Logging) -> logging.Logger:
    """The logger ``darkroom``: warnings and worse to standard error, everything from the configured level on to a file that is turned over at 10 MB, five times."""
    log = logging.getLogger("darkroom")
    log.setLevel(section.level.upper())
    for handler in list(log.handlers):
        log.removeHandler(handler)
    screen = logging.StreamHandler()
    screen.setLevel(logging.WARNING)
    screen.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
    log.addHandler(screen)
    if section.log_to_file:
        Path(section.file_path).parent.mkdir(parents=True, exist_ok=True)
        file = logging.handlers.RotatingFileHandler(section.file_path, maxBytes=10 << 20, backupCount=5, encoding="utf-8", delay=True)
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(file)
    return log


def _override(cfg: configuration.Config, section: str, **values: object) -> configuration.Config:
    given = {k: v for k, v in values.items() if v is not None}
    return dataclasses.replace(cfg, **{section: dataclasses.replace(getattr(cfg, section), **given)}) if given else cfg


def _folder(path: str) -> str:
    """A source folder that exists, as an absolute path."""
    found = Path(path).resolve()
    if not found.exists():
        raise SystemExit(f"no such folder: {found}")
    if not found.is_dir():
        raise SystemExit(f"not a folder: {found}")
    return str(found)


def _confirmed(force: bool, question: str) -> bool:
    """Whether to go ahead: by the flag, or by an answer; nobody to ask means no."""
    if force:
        return True
    try:
        return input(f"{question} [y/N] ").strip().lower() in ("y", "yes")
    except (EOFError, OSError):
        return False


def _one_of(found, key: str, last: bool, yes: bool, columns: list[str]):  # noqa: ANN001, ANN202
    """The newest record with ``last``, the only one with ``yes``, else the one that is chosen from a list of twenty; null if there is none."""
    rows = found.orderBy(F.col(key).desc()).select(*columns).limit(20).collect()
    if not rows or last or len(rows) == 1:
        return rows[0][key] if rows else None
    if yes:
        raise SystemExit(f"{len(rows)} records match; name one")
    for i, r in enumerate(rows, 1):
        print(i, *[r[c] for c in columns], file=sys.stderr)
    try:
        answer = input("number: ")
    except (EOFError, OSError):
        raise SystemExit("several records match; name one, or take --last") from None
    if not answer.isdigit() or not 1 <= int(answer) <= len(rows):
        raise SystemExit("none chosen")
    return rows[int(answer) - 1][key]


def _by_roots(found, source: str | None, destination: str | None):  # noqa: ANN001, ANN202
    for column, root in (("source_root", source), ("destination_root", destination)):
        if root:
            found = found.filter(F.col(column).startswith(str(Path(root).resolve())))
    return found


def _fix_configuration(path: str | None, command: str) -> str | None:
    """Writes the place of a probe that the configuration misses into the configuration file."""
    import yaml

    found = metadata.find_probe(command)
    if found is None or found == command or metadata.shutil.which(command):
        return None
    file = Path(path or next((p for p in configuration.DEFAULT_FILES if Path(p).is_file()), configuration.DEFAULT_FILES[0]))
    data = (yaml.safe_load(file.read_text(encoding="utf-8")) if file.is_file() else None) or {}
    data.setdefault("video_metadata", {})["ffprobe_path"] = found
    file.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return found


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="darkroom")
    out.add_argument("--config")
    out.add_argument("--state", help="folder of run records and verifications")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        return p

    flag = argparse.BooleanOptionalAction
    p = command("scan", "source")
    p.add_argument("--recursive", action=flag), p.add_argument("--videos", action=flag), p.add_argument("--limit", type=int), p.add_argument("--show", type=int, default=10, help="files to show")
    p = command("apply", "source", "destination")
    p.add_argument("--dry-run", action=flag), p.add_argument("--move", action="store_true"), p.add_argument("--rename", action=flag)
    p.add_argument("--tag-names", action=flag), p.add_argument("--structure"), p.add_argument("--limit", type=int), p.add_argument("--on-collision")
    p.add_argument("--recursive", action=flag), p.add_argument("--videos", action=flag), p.add_argument("--force", action="store_true"), p.add_argument("--no-run-record", action="store_true"), p.add_argument("--show", type=int, default=10)
    p = command("verify")
    p.add_argument("--run-id"), p.add_argument("--last", action="store_true"), p.add_argument("--algorithm", choices=["sha256", "quick"]), p.add_argument("--include-dry-runs", action="store_true")
    p.add_argument("--reconstruct", action="store_true"), p.add_argument("--source"), p.add_argument("--destination"), p.add_argument("--run-file"), p.add_argument("--yes", action="store_true")
    p = command("cleanup")
    p.add_argument("--verify-id"), p.add_argument("--verify-file"), p.add_argument("--last", action="store_true"), p.add_argument("--yes", action="store_true"), p.add_argument("--dry-run", action=flag)
    p.add_argument("--only", default="ok", choices=["ok"]), p.add_argument("--force", action="store_true"), p.add_argument("--source"), p.add_argument("--destination")
    p = command("export", "format", "source")
    p.add_argument("--output"), p.add_argument("--destination"), p.add_argument("--statistics", action=flag), p.add_argument("--parts", action="store_true", help="a folder of part files")
    p.add_argument("--sample", type=int), p.add_argument("--rename", action=flag), p.add_argument("--tag-names", action=flag), p.add_argument("--structure"), p.add_argument("--limit", type=int), p.add_argument("--pretty", action=flag)
    p = command("tags", "action")
    p.add_argument("target", nargs="?"), p.add_argument("--use", action="store_true"), p.add_argument("--ignore", action="store_true"), p.add_argument("--clear", action="store_true")
    p.add_argument("--alias"), p.add_argument("--samples", type=int, default=3)
    p = command("config", "action")
    p.add_argument("--full", action="store_true"), p.add_argument("--output")
    command("doctor").add_argument("--fix", action="store_true")
    command("version")
    return out


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        cfg = configuration.load(args.config)
    except configuration.ConfigError as error:
        print(error, file=sys.stderr)
        return 2
    state = Path(args.state or cfg.verify.state_dir)
    if args.state:
        cfg = _override(cfg, "logging", file_path=str(state / "darkroom.log"))
    log = set_up_logging(cfg.logging)
    log.info("command %s", args.command)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if args.command == "version":
        print(darkroom.__version__)
        return 0
    if args.command == "doctor":
        probe = cfg.video_metadata.ffprobe_path
        report = {"errors": cfg.errors(), "readers": metadata.providers(probe), "probe": metadata.find_probe(probe), "probe_version": metadata.probe_version(probe)}
        show(report | ({"fixed": _fix_configuration(args.config, probe)} if args.fix else {}))
        return int(bool(cfg.errors()))
    if args.command == "config":
        if args.action == "init":
            target = Path(args.output or configuration.DEFAULT_FILES[0])
            if target.exists():
                print(f"{target} exists", file=sys.stderr)
                return 1
            target.write_text(configuration.template(args.full), encoding="utf-8")
        elif args.action == "show":
            show(dataclasses.asdict(cfg))
        else:
            print(next((p for p in configuration.DEFAULT_FILES if Path(p).is_file()), "no configuration file"))
        return 0
    rules = records.TagRules(state / "tag_rules.yaml")
    if args.command == "tags" and args.action == "classify":
        if args.use:
            rules.add_use(args.target, args.alias)
        elif args.ignore:
            rules.add_ignore(args.target)
        elif args.clear:
            rules.clear(args.target)
        rules.save()
        return 0
    if args.command in ("scan", "apply", "export"):
        args.source = _folder(args.source)
        cfg = _override(cfg, "scan", limit=args.limit)
    if args.command in ("scan", "apply"):
        cfg = _override(cfg, "general", recursive=args.recursive, include_videos=args.videos)
    if args.command == "apply":
        args.destination = str(Path(args.destination).resolve())
    if args.command in ("apply", "export"):
        cfg = _override(cfg, "renaming", enabled=args.rename)
        cfg = _override(cfg, "folder_tags", enabled=args.tag_names)
        cfg = _override(cfg, "sorting", folder_structure=args.structure)
    if args.command == "apply":
        cfg = _override(cfg, "duplicates", on_collision=args.on_collision)
    if engine is None:
        engine = Engine(config=cfg, rules=rules)
    else:
        engine.config, engine.rules = cfg, rules
    if args.command == "scan":
        files = engine.scan(args.source)
        head = files.orderBy("source_path").select("source_path", "detected_date", "date_source", F.get("folder_tags", F.lit(0)).alias("tag")).limit(args.show)
        show(engine.summary(files) | {"first_files": [r.asDict() for r in head.collect()]})
    elif args.command == "apply":
        dry = cfg.general.dry_run_default if args.dry_run is None else args.dry_run
        if not dry and not _confirmed(args.force, f"{'Move' if args.move else 'Copy'} files of {args.source} to {args.destination}?"):
            print("aborted", file=sys.stderr)
            return 1
        record = engine.apply(args.source, args.destination, dry, args.move, str(state), False if args.no_run_record else None)
        counts = reports.as_map(record.planned.groupBy("operation").agg(F.count(F.lit(1)).alias("files")), "operation")
        head = record.planned.orderBy("source_path").select("source_path", "operation", "destination_path", "reason").limit(args.show)
        for r in record.results.filter("not ok").toLocalIterator() if record.failed else ():
            log.error("%s: %s", r["source"], r["message"])
        show({"record": record.path, "operations": counts, "failed": record.failed, "first_operations": [r.asDict() for r in head.collect()]})
        return int(bool(record.failed))
    elif args.command == "verify" and args.reconstruct:
        if not args.source or not args.destination:
            print("--reconstruct needs --source and --destination", file=sys.stderr)
            return 2
        report = engine.verify_reconstructed(_folder(args.source), args.destination, args.algorithm or cfg.verify.algorithm)
        path = engine.save_verification(report, None, (args.source, args.destination), str(state))
        show({"report": path, "statuses": reports.as_map(report.groupBy("status").agg(F.count(F.lit(1)).alias("files")), "status")})
    elif args.command == "verify":
        if args.run_file and not Path(args.run_file).is_file():
            print(f"no run record {args.run_file}", file=sys.stderr)
            return 1
        runs = records.read_runs(engine.spark, args.run_file or str(state / cfg.verify.run_record_dir))
        if not args.run_file:
            wanted = args.run_id
            if not wanted:
                some = _by_roots(runs if args.include_dry_runs else runs.filter("mode <> 'dry_run'"), args.source, args.destination)
                wanted = _one_of(some, "run_id", args.last, args.yes, ["run_id", "created_at", "mode", "source_root", "destination_root"])
            runs = discovery.find_by_id(runs, "run_id", wanted)
        one = runs.first()
        if one is None:
            print("no run record", file=sys.stderr)
            return 1
        report = engine.verify(runs, args.algorithm or cfg.verify.algorithm)
        path = engine.save_verification(report, one["run_id"], (one["source_root"], one["destination_root"]), str(state))
        show({"report": path, "statuses": reports.as_map(report.groupBy("status").agg(F.count(F.lit(1)).alias("files")), "status")})
    elif args.command == "cleanup":
        if args.verify_file and not Path(args.verify_file).is_file():
            print(f"no verification {args.verify_file}", file=sys.stderr)
            return 1
        dry = cfg.general.dry_run_default if args.dry_run is None else args.dry_run
        found = records.read_verifications(engine.spark, args.verify_file or str(state / cfg.verify.verification_dir))
        if not args.verify_file:
            some = _by_roots(found, args.source, args.destination)
            wanted = args.verify_id or _one_of(some, "verify_id", args.last, args.yes, ["verify_id", "created_at", "source_root", "destination_root"])
            found = discovery.find_by_id(found, "verify_id", wanted)
        if found.first() is None:
            print("no verification", file=sys.stderr)
            return 1
        if not dry and not _confirmed(args.force, "Delete the verified sources?"):
            print("aborted", file=sys.stderr)
            return 1
        rows = found.select(F.explode("entries").alias("e")).select("e.source_path", F.coalesce("e.actual_destination_path", "e.expected_destination_path").alias("destination_path"), "e.status", "e.hash_algorithm")
        show(engine.clean_up(rows, dry))
    elif args.command == "export":
        files = engine.scan(args.source)
        if args.destination:
            dated = files.filter("detected_date is not null")
            first = dated.orderBy("source_path").limit(args.sample) if args.sample else dated
            planned = engine.plan(first, args.destination).select("source_path", F.regexp_replace("destination_path", "/[^/]*$", "").alias("pf"), F.substring_index("destination_path", "/", -1).alias("pn"))
            files = files.join(planned, "source_path", "left").withColumns({"proposed_destination_folder": F.col("pf"), "proposed_filename": F.col("pn")}).drop("pf", "pn")
        statistics = cfg.export.include_statistics if args.statistics is None else args.statistics
        if args.parts:
            if not args.output:
                print("--parts needs --output", file=sys.stderr)
                return 2
            engine.export_parts(files, args.output, args.format)
            return 0
        pretty = cfg.export.pretty_print if args.pretty is None else args.pretty
        text = engine.export_json(files, args.source, args.output, statistics, pretty) if args.format == "json" else engine.export_csv(files, args.output)
        if not args.output:
            print(text)
    elif args.command == "tags":
        files = engine.scan(_folder(args.target or "."))
        listed = reports.listing_with_samples(files.select(F.explode("folder_tags").alias("tag"), "source_path"), "tag", args.samples)
        ignored = files.filter(F.col("source_folder_name").isNotNull() & (F.size("folder_tags") == 0)).select(F.col("source_folder_name").alias("folder"), F.get("folder_tag_reasons", F.lit(0)).alias("reason"), "source_path")
        ignored = ignored.filter(~F.col("reason").isin("meaningful", "in_rules_use_list"))
        reasons = ignored.groupBy("folder").agg(F.min("reason").alias("reason"))
        skipped = reports.listing_with_samples(ignored, "folder", args.samples).join(reasons, "folder")
        show({"tags": [r.asDict() for r in listed.orderBy("tag").collect()], "ignored": [r.asDict() for r in skipped.orderBy("folder").collect()]})
    return 0


if __name__ == "__main__":
    sys.exit(main())
