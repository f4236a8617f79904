import json
import os
import struct
from datetime import datetime

import pytest

from darkroom import config
from darkroom.cli import main
from darkroom.engine import Engine
from darkroom.operators import actions
from darkroom.sources import fstree, metadata, records


def tiff(date: str) -> bytes:
    text = date.encode() + b"\0"
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    return body + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(text), 44) + struct.pack("<I", 0) + text


def jpeg(date: str | None, extra: bytes = b"") -> bytes:
    block = b"Exif\0\0" + tiff(date) if date else b""
    segment = b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block if date else b""
    return b"\xff\xd8" + segment + b"\xff\xda\0\2" + extra


def movie(seconds: int) -> bytes:
    mvhd = b"\0" * 4 + struct.pack(">II", seconds, 0) + b"\0" * 80
    atom = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    return atom(b"ftyp", b"mp42") + atom(b"moov", atom(b"mvhd", mvhd))


@pytest.fixture
def library(tmp_path):
    files = {
        "Paris 2024/a.jpg": jpeg("2024:03:15 14:30:00"), "Paris 2024/b/a.jpg": jpeg("2024:03:20 10:00:00", b"other"), "2023-12-25 Christmas/family.jpg": jpeg(None),
        "tosort/IMG_20220101_101010.png": b"\x89PNG\r\n\x1a\n", "_u.jpg": jpeg("2024:03:15 14:30:00"), "k=v/c.JPG": jpeg("2021:01:01 00:00:00"), "clip.mp4": movie(3_660_000_000), ".hidden.jpg": b"x", "note.txt": b"x",
        "Paris 2024/b/IMG 1%20.jpg": jpeg("2020:02:02 02:02:02"), "twin/a.jpg": jpeg("2024:03:15 14:30:00"),
    }
    root = tmp_path / "library"
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        os.utime(path, (1_600_000_000, 1_600_000_000))
    return root


def test_listing(spark, library):
    found = {r.path.rsplit("/", 1)[1] for r in fstree.list_files(spark, str(library), extensions=[".jpg", ".png"]).collect()}
    assert found == {"a.jpg", "family.jpg", "IMG_20220101_101010.png", "_u.jpg", "c.JPG", "IMG 1%20.jpg"}
    assert fstree.list_files(spark, str(library), recursive=False).count() == 3
    assert fstree.list_files(spark, str(library), hidden=True).filter("path like '%.hidden.jpg'").count() == 1
    assert fstree.list_files(spark, str(library), limit=2).count() == 2
    assert [r.error is not None for r in fstree.list_files(spark, str(library / "nowhere")).collect()] == [True]


def test_metadata_readers(spark, library):
    assert metadata.tiff_tags(tiff("2024:03:15 14:30:00")) == {"date_original": "2024:03:15 14:30:00"}
    assert metadata.tiff_tags(b"II*\0\xff\xff\0\0") == {} and metadata.embedded_tiff(b"nothing") == b""
    assert metadata.mvhd_date(str(library / "clip.mp4")) == datetime(2019, 12, 24, 2, 40).strftime("%Y-%m-%d %H:%M:%S")
    assert metadata.probe_json_date(json.dumps({"format": {"tags": {"Date": "2024"}}, "streams": [{"tags": {"creation_time": "x"}}]})) == "2024"
    listed = fstree.list_files(spark, str(library))
    assert listed.filter("error is null").count() == metadata.read_hashes(listed).filter("length(file_hash) = 64").count()


def heif(date: str, idat: bool = False) -> bytes:
    box = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    item = struct.pack(">I", 6) + b"Exif\0\0" + tiff(date)
    entry = lambda i, kind: box(b"infe", b"\2\0\0\0" + struct.pack(">HH4s", i, 0, kind) + b"\0")
    items = box(b"iinf", b"\0" * 4 + struct.pack(">H", 2) + entry(1, b"hvc1") + entry(2, b"Exif"))
    head, pixels = box(b"ftyp", b"heic\0\0\0\0heic"), b"\1" * (2 << 20)
    place = lambda at: b"\1\0\0\0" + struct.pack(">HH", 0x4400, 2) + struct.pack(">HHHHII", 1, 0, 0, 1, 0, 9) + struct.pack(">HHHHII", 2, int(idat), 0, 1, at, len(item))
    body = lambda at: box(b"meta", b"\0" * 4 + items + box(b"iloc", place(at)) + (box(b"idat", item) if idat else b""))
    if idat:
        return head + box(b"mdat", pixels) + body(0)
    return head + body(len(head + body(0)) + 8 + len(pixels)) + box(b"mdat", pixels + item)


def test_embedded_dates_behind_the_first_megabyte(spark, tmp_path):
    date, pixels = "2024:03:15 14:30:00", b"\1" * (2 << 20)
    block = tiff(date)
    text = date.encode() + b"\0"
    at = 8 + len(pixels)
    raw = b"II*\0" + struct.pack("<I", at) + pixels + struct.pack("<HHHIII", 1, 0x8769, 4, 1, at + 18, 0) + struct.pack("<HHHIII", 1, 0x9003, 2, len(text), at + 36, 0) + text
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + b"\0" * 4
    riff = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", pixels)
    webp = b"WEBP" + riff(b"VP8X", b"\0" * 10) + riff(b"VP8 ", pixels + b"EXIF\1")
    segments = b"".join(b"\xff\xe2" + struct.pack(">H", 60_002) + b"\1" * 60_000 for _ in range(30))
    files = {
        "a.dng": raw, "a.tif": raw, "a.png": png + chunk(b"eXIf", block), "a.webp": b"RIFF" + struct.pack("<I", 0) + webp + riff(b"EXIF", block), "b.webp": b"RIFF" + struct.pack("<I", 0) + webp + riff(b"EXIF", b"Exif\0\0" + block),
        "a.heic": heif(date), "b.heic": heif(date, idat=True), "a.jpg": b"\xff\xd8" + segments + jpeg(date)[2:], "other.heif": pixels[:-3] + b"Exif\0\0" + block,
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    without = {"none.png": png, "none.jpg": b"", "none.webp": b"RIFF" + struct.pack("<I", 0) + webp, "none.heic": heif(date)[: 2 << 20], "cut.tif": raw[:-30]}
    for name, content in without.items():
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, *without]], "path string")
    got = {r.path.rsplit("/", 1)[1]: r.best_date for r in metadata.read_exif(paths).collect()}
    assert got == dict.fromkeys(files, datetime(2024, 3, 15, 14, 30)) | dict.fromkeys(without)


def test_scan(spark, library):
    engine = Engine(spark, config.Config())
    got = {r.source_path.replace(str(library.resolve()) + "/", ""): r for r in engine.scan(str(library)).collect()}
    assert len(got) == 9
    assert got["Paris 2024/a.jpg"].detected_date == datetime(2024, 3, 15, 14, 30) and got["Paris 2024/a.jpg"].has_exif
    assert got["Paris 2024/a.jpg"].folder_tags == ["Paris_2024"] and got["tosort/IMG_20220101_101010.png"].folder_tags == []
    assert got["tosort/IMG_20220101_101010.png"].date_source == "filename" and got["2023-12-25 Christmas/family.jpg"].date_source == "filesystem_modified"
    assert got["clip.mp4"].date_source == "video_metadata" and got["clip.mp4"].file_type == "video"
    summary = engine.summary(engine.scan(str(library)))
    assert summary["total_files"] == 9 and summary["files_by_extension"] == {".jpg": 7, ".mp4": 1, ".png": 1}


def test_apply_verify_clean_up(spark, library, tmp_path, capsys):
    engine = Engine(spark, config.Config())
    state, out = str(tmp_path / "state"), str(tmp_path / "sorted")
    assert main(["--state", state, "apply", str(library), out], engine) == 0
    assert not os.path.exists(out)
    assert main(["--state", state, "apply", str(library), out, "--no-dry-run", "--force"], engine) == 0
    made = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs)
    assert "2024/03/a.jpg" in made and "2024/03/a_001.jpg" in made and len(made) == 8  # one copy is skipped
    assert main(["--state", state, "verify", "--last"], engine) == 0
    assert main(["--state", state, "cleanup", "--last", "--no-dry-run", "--force"], engine) == 0
    assert not (library / "Paris 2024/a.jpg").exists() and (library / "twin/a.jpg").exists()
    assert main(["--state", state, "apply", str(library), out, "--no-dry-run", "--force"], engine) == 0
    assert "duplicate of existing file" in "".join(p.read_text() for p in (tmp_path / "state/runs").iterdir())
    capsys.readouterr()


def test_reconstructed_verification(spark, library, tmp_path):
    import dataclasses

    cfg = dataclasses.replace(config.Config(), verify=dataclasses.replace(config.Config().verify, content_search_on_reconstruct=True))
    engine = Engine(spark, cfg)
    out = tmp_path / "sorted"
    (out / "2024/03").mkdir(parents=True), (out / "else").mkdir()
    (out / "2024/03/a.jpg").write_bytes((library / "Paris 2024/a.jpg").read_bytes())
    (out / "else/moved.jpg").write_bytes((library / "k=v/c.JPG").read_bytes())
    got = {r.source_path.rsplit("/library/", 1)[1]: r.status for r in engine.verify_reconstructed(str(library), str(out)).collect()}
    assert got["Paris 2024/a.jpg"] == "ok" and got["twin/a.jpg"] == "ok" and got["Paris 2024/b/a.jpg"] == "mismatch"
    assert got["k=v/c.JPG"] == "ok_existing_duplicate" and got["clip.mp4"] == "missing_destination"


def test_sql_functions(spark):
    Engine(spark)
    row = spark.sql("select path_name('/a/b.JPG'), path_suffix('/a/b.JPG'), destination_folder(timestamp_ntz'2024-03-05 00:00:00', 'YYYY/MM/DD'), tag_in_name('Paris_1.jpg', 'paris', 0.75)").first()
    assert row[:] == ("b.JPG", ".JPG", "2024/03/05", True)


def test_exports(spark, library, tmp_path):
    engine = Engine(spark, config.Config())
    files = engine.scan(str(library))
    document = json.loads(engine.export_json(files, str(library), str(tmp_path / "x.json")))
    assert document["file_count"] == 9 and document["statistics"]["total_files"] == 9 and len(document["files"][0]) == 26
    text = engine.export_csv(files)
    assert text.startswith("path,filename,size_bytes,") and text.count("\r\n") == 10


def test_configuration(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("sorting: {folder_structure: YYYY, unknown: 1}\nfilename_date: {enabled: false}\nscan: {limit: 3}\nextra: 1\n")
    cfg = config.load(file)
    assert cfg.sorting.folder_structure == "YYYY" and "filename" not in cfg.date_priority and cfg.scan.limit == 3 and cfg.errors() == []
    file.write_text("sorting: {folder_structure: X, fallback_date_priority: [exif, y]}\nfolder_tags: {min_length: 0}\n")
    assert len(config.load(file).errors()) == 3
    for text in ("a: [", "- 1"):
        file.write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(file)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.yaml")
    file.write_text(config.template(True))
    assert config.load(file) == config.Config()
    order = {"before_exif": ["filename", "exif", "filesystem"], "after_exif": ["exif", "filename", "filesystem"], "after_filesystem": ["exif", "filesystem", "filename"]}
    for setting, want in order.items():
        assert config.from_dict({"sorting": {"fallback_date_priority": ["exif", "filesystem"]}, "filename_date": {"priority": setting}}).date_priority == want


def test_rules_and_records(spark, tmp_path):
    rules = records.TagRules(tmp_path / "rules.yaml")
    rules.add_use("Paris 2022", "ParisTrip"), rules.add_ignore("tosort"), rules.add_ignore("Paris 2022"), rules.add_use("tosort")
    rules.save()
    again = records.TagRules(tmp_path / "rules.yaml")
    assert (again.use, again.ignore, again.aliases) == ({"tosort"}, {"Paris 2022"}, {})
    assert again.clear("tosort") and not again.clear("tosort")
    assert again.frame(spark).collect()[0].decision == "ignore"
    with records.RunRecord(tmp_path / "runs", "/a", "/b", "live_copy", {}) as record:
        record.add("copy", "/a/x", "/b/x"), record.add("skip", "/a/y", None, "why")
    (tmp_path / "runs/broken_apply.json").write_text("{")
    runs = records.read_runs(spark, str(tmp_path / "runs")).collect()
    assert len(runs) == 1 and runs[0].summary.copied_files == 1 and len(runs[0].entries) == 2
    with pytest.raises(RuntimeError), records.RunRecord(tmp_path / "none", "/a", "/b", "dry_run", {}):
        raise RuntimeError
    assert not (tmp_path / "none").exists()


def test_file_actions(tmp_path):
    a, b = tmp_path / "a", tmp_path / "x/b"
    a.write_text("1")
    assert actions.copy_file(a, b)[0] and not b.exists()
    assert actions.copy_file(a, b, False)[0] and not actions.copy_file(a, b, False)[0] and not actions.move_file(tmp_path / "none", b, False)[0]
    batch = actions.Batch(False)
    assert batch.move([(str(b), str(tmp_path / "c")), (str(b), str(tmp_path / "d"))]) == (1, 1)
    assert batch.roll_back() == (1, 0) and b.exists()
    assert actions.enough_space(tmp_path / "not/there", 1)[0] and actions.ensure_folder(tmp_path / "n", False)[0]
    gone = actions.delete_sources([(str(a), str(b)), (str(tmp_path / "zz"), None)], False)
    assert gone["bytes_freed"] == 1 and gone["skipped"] == [str(tmp_path / "zz")] and gone["success_rate"] == 100.0


def test_streams(spark, data, tmp_path):
    from darkroom.streaming import incoming

    schema = spark.read.parquet(f"{data}/file_records.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/file_records.parquet").coalesce(1).write.parquet(str(tmp_path / "in/x"))
    stream = incoming.arrivals(spark, str(tmp_path / "in/*"), schema)
    query = incoming.first_arrivals(stream).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        hashes = spark.sql("select count(file_hash) n, count(distinct file_hash) d, count(*) - count(file_hash) without from arrived").first()
        nulls = spark.read.parquet(f"{data}/file_records.parquet").filter("file_hash is null").count()
        assert hashes.n == hashes.d > 0 and hashes.without == nulls > 0
    finally:
        query.stop()


def _with(**sections):
    import dataclasses

    base = config.Config()
    return dataclasses.replace(base, **{name: dataclasses.replace(getattr(base, name), **values) for name, values in sections.items()})


def test_configured_names_reach_the_plan(spark, library):
    def plan(**sections):
        engine = Engine(spark, _with(**sections))
        rows = engine.plan(engine.scan(str(library)), "/out").collect()
        return {r.source_path.rsplit("/library/", 1)[1]: (r.destination_path or "").rsplit("/", 1)[-1] for r in rows}

    got = plan(renaming={"enabled": True, "pattern": "{original}_{date}", "date_format": "%y-%m-%d"})
    assert got["Paris 2024/a.jpg"] == "a_24-03-15.jpg" and got["twin/a.jpg"] == "a_24-03-15_001.jpg" and got["Paris 2024/b/a.jpg"] == "a_24-03-20.jpg"
    got = plan(renaming={"enabled": True, "lowercase_extensions": False, "time_format": "%H"})
    assert got["k=v/c.JPG"] == "20210101_00.JPG"
    got = plan(renaming={"enabled": True, "tag_part_format": "-{tag}"}, folder_tags={"enabled": True})
    assert got["Paris 2024/a.jpg"] == "20240315_143000-Paris_2024.jpg"
    got = plan(renaming={"enabled": True, "pattern": "{date}_n{counter}"})
    assert got["_u.jpg"].startswith("20240315_n") and len({got["_u.jpg"], got["Paris 2024/a.jpg"], got["twin/a.jpg"]}) == 3


def test_unique_names_equal_the_rule_in_sequence(spark):
    import random

    from darkroom.operators.collisions import unique_names

    rng = random.Random(12)
    rows = [(f"s{i:03d}", rng.choice(["x.jpg", "X.jpg", "x_001.jpg", "y.JPG", "y_002.jpg", "y", "x_001_001.jpg"])) for i in range(60)] + [(None, "x.jpg"), ("z", None)]
    used, want = set(), {}
    for source, name in sorted(r for r in rows if r[0] and r[1]):
        stem, dot, ext = name.partition(".")
        new, counter = name, 0
        while new.lower() in used:
            counter += 1
            new = f"{stem}_{counter:03d}{dot}{ext}"
        used.add(new.lower())
        want[source] = new
    assert {r.source: r.unique_name for r in unique_names(spark.createDataFrame(rows, "source string, name string")).collect()} == want


def test_quick_verification_and_its_report(spark, library, tmp_path, capsys):
    engine, state, out = Engine(spark, config.Config()), str(tmp_path / "state"), str(tmp_path / "sorted")
    assert main(["--state", state, "apply", str(library), out, "--no-dry-run", "--force"], engine) == 0
    changed = tmp_path / "sorted/2024/03/a.jpg"
    reports_of = lambda: sorted((tmp_path / "state/verifications").iterdir())
    assert main(["--state", state, "verify", "--last", "--algorithm", "quick"], engine) == 0
    document = json.loads(reports_of()[-1].read_text())
    assert document["hash_algorithm"] == "quick" and document["input_source"] == "run_record" and document["summary"]["ok"] == document["summary"]["total"] == 8
    assert main(["--state", state, "cleanup", "--last", "--no-dry-run", "--force"], engine) == 0 and (library / "Paris 2024/a.jpg").exists()  # quick is not enough
    changed.write_bytes(changed.read_bytes() + b"x")
    runs = records.read_runs(spark, str(tmp_path / "state/runs"))
    quick = {r.status: (r.error, r.match_type) for r in engine.verify(runs, "quick").collect()}
    assert quick["mismatch"] == ("Size mismatch", "expected_path") and quick["ok"][0] is None
    assert {r.status for r in engine.verify(runs).collect()} == {"ok", "mismatch"}
    changed.unlink()
    assert "missing_destination" in {r.status for r in engine.verify(runs, "quick").collect()}
    assert main(["--state", state, "verify", "--run-file", str(tmp_path / "none.json")], engine) == 1
    assert main(["--state", state, "verify", "--run-file", str(next((tmp_path / "state/runs").iterdir()))], engine) == 0
    assert main(["--state", state, "cleanup", "--verify-file", str(reports_of()[-1])], engine) == 0  # a dry run by default
    assert '"bytes_freed"' in capsys.readouterr().out and (library / "Paris 2024/b/a.jpg").exists()


def test_actions_that_run_again_find_their_work(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "x/b"
    a.write_text("1")
    todo = spark.createDataFrame([(str(a), str(b)), (str(tmp_path / "none"), str(tmp_path / "y")), (None, "z")], "source string, destination string")
    for _ in range(2):
        assert sorted(r.ok for r in actions.carry_out(todo).collect()) == [False, False, True]
    for _ in range(2):
        assert sorted(r.ok for r in actions.carry_out(todo, move=True).collect()) == [False, False, True] and not a.exists()
    gone = actions.deletion_totals(actions.delete_files(spark.createDataFrame([(str(b), None), (str(b), None), (str(a), None)], "source string, destination string"), False))
    assert gone == {"deleted": 1, "skipped": 1, "failed": 0, "bytes_freed": 1, "success_rate": 100.0}


def test_commands(spark, library, tmp_path, capsys, monkeypatch):
    engine, state, out = Engine(spark, config.Config()), str(tmp_path / "state"), str(tmp_path / "sorted")
    shown = lambda *args: (main(["--state", state, *args], engine), json.loads(capsys.readouterr().out))[1]
    with pytest.raises(SystemExit):
        main(["--state", state, "scan", str(tmp_path / "nowhere")], engine)
    assert len(shown("scan", str(library), "--show", "2")["first_files"]) == 2
    assert main(["--state", state, "apply", str(library), out, "--no-dry-run"], engine) == 1 and not os.path.exists(out)  # nobody to ask
    capsys.readouterr()
    assert shown("apply", str(library), out, "--no-run-record")["record"] is None and not (tmp_path / "state/runs").exists()
    listed = shown("tags", "list", str(library))
    assert {t["tag"] for t in listed["tags"]} >= {"Paris_2024"} and {t["folder"]: t["reason"] for t in listed["ignored"]}["tosort"] == "in_ignore_list"
    files = shown("export", "json", str(library), "--destination", out, "--sample", "2", "--rename", "--structure", "YYYY")["files"]
    proposed = [f["proposed_target_path"] for f in files if f["proposed_filename"]]
    assert len(proposed) == 2 and all(p.startswith(f"{out}/2024/2024") or p.startswith(f"{out}/20") for p in proposed) and len(files) == 9
    assert main(["--state", state, "export", "csv", str(library), "--parts", "--output", str(tmp_path / "parts")], engine) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "parts")).count() == 9
    probe = tmp_path / "ffprobe"
    probe.write_text("#!/bin/sh\necho ffprobe version 1"), probe.chmod(0o755)
    monkeypatch.setattr(metadata, "PROBE_FOLDERS", (str(tmp_path),))
    monkeypatch.setattr(metadata.shutil, "which", lambda c: None)
    file = tmp_path / "c.yaml"
    file.write_text("general: {recursive: true}\n")
    monkeypatch.chdir(tmp_path)
    assert main(["--config", str(file), "doctor", "--fix"]) == 0
    assert config.load(file).video_metadata.ffprobe_path == str(probe) and "ffprobe version 1" in capsys.readouterr().out


def test_logging(tmp_path):
    from darkroom.cli import set_up_logging

    log = set_up_logging(config.Logging(level="info", file_path=str(tmp_path / "logs/x.log")))
    log.debug("no"), log.info("a file"), log.handlers[1].flush()
    assert "INFO darkroom a file" in (tmp_path / "logs/x.log").read_text() and "no" not in (tmp_path / "logs/x.log").read_text().split()
    assert len(set_up_logging(config.Logging(log_to_file=False)).handlers) == 1


def test_all_tags_are_kept():
    block = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHIHH", 0x0128, 3, 1, 2, 0) + struct.pack("<I", 0)
    assert metadata.tiff_tags(block) == {"orientation": "6", "0x0128": "2"}


def test_everything_a_reader_says(spark, library):
    assert metadata.probe_tags(json.dumps({"format": {"tags": {"a": 1}}, "streams": [{}, {"tags": {"b": "2"}}]})) == {"a": "1", "stream_1_b": "2"}
    files = fstree.list_files(spark, str(library)).filter("path like '%.mp4' or path like '%note.txt'")
    got = {r.path.rsplit("/", 1)[1]: (r.reader, r.tags) for r in metadata.all_video_metadata(files).collect()}
    assert got["clip.mp4"] == ("builtin", {"creation_time": "2019-12-24 02:40:00"}) and got["note.txt"] == (None, {})
