import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from darkroom.operators.collisions import name_counters, resolve_collisions, resolve_in_order
from darkroom.operators.diffing import compare_copies
from darkroom.operators.duplicates import duplicate_members, same_content
from darkroom.operators.ranking import ranked
from darkroom.operators.timeline import CANDIDATES, best_path, choose_by_viterbi, reading_candidates, resolve_readings
from darkroom.operators.verification import search_content, verify
from darkroom.session import salted_join

KEY = "k string, f1 string, f2 string, at int, side string, difference string"


def test_copies_are_compared_field_by_field(spark):
    main = [("a", "1", "x", 1, "q", "q"), ("a", "1", "y", 2, "q", "q"), ("a", "1", "y", 2, "q", "q"), ("b", None, "x", 1, "q", "q"), ("c", "1", None, 1, "q", "q"), (None, "1", "1", 1, "q", "q")]
    copy = [("a", "1", "y", 1, "q", "q"), ("c", "1", "z", 1, "q", "q"), ("d", "1", "1", None, "q", "q"), (None, "2", "1", 1, "q", "q")]
    found = compare_copies(spark.createDataFrame(main, KEY), spark.createDataFrame(copy, KEY), ["k"], ["f1", "f2"], ["at"])
    assert sorted(((r.k or "", r.difference) for r in found.collect())) == [("", "f1"), ("b", "missing_in_copy"), ("c", "f2"), ("d", "missing_in_main")]


def test_copies_that_are_empty(spark):
    none, one = spark.createDataFrame([], KEY), spark.createDataFrame([("a", "1", "x", 1, "q", "q")], KEY)
    assert compare_copies(none, none, ["k"], ["f1"], ["at"]).count() == 0
    assert [r.difference for r in compare_copies(none, one, ["k"], ["f1"], ["at"]).collect()] == ["missing_in_main"]


def test_copies_ties_do_not_depend_on_order(spark):
    rows = [("a", "1", "x", 1, "", ""), ("a", "2", "x", 1, "", "")]
    other = spark.createDataFrame([("a", "2", "x", 9, "", "")], KEY)
    for order in (rows, rows[::-1]):
        assert compare_copies(spark.createDataFrame(order, KEY), other, ["k"], ["f1"], ["at"]).count() == 0


def test_best_path_is_the_cheapest_of_all():
    rng = random.Random(5)
    cost = lambda a, b: (a[1] != b[1]) * 1.0 + (b[2] < a[2]) * 0.5
    for _ in range(200):
        rows = [[(rng.choice([0.0, 0.3]), rng.choice("xy"), rng.randrange(5)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
        every = [[]]
        for row in rows:
            every = [p + [c] for p in every for c in row]
        total = lambda p: sum(c[0] for c in p) + sum(map(cost, p, p[1:]))
        got = [r[i] for r, i in zip(rows, best_path(rows), strict=True)]
        assert abs(total(got) - min(map(total, every))) < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_viterbi_over_partitions_equals_one_sequence(spark, parts):
    rng = random.Random(11)
    rows, by_source = [], {}
    for i in range(400):
        source = rng.choice(["hot", "hot", "hot", None, "b"])
        cands = [(rng.choice([0.0, 0.3]), rng.choice("xy"), rng.randrange(100)) for _ in range(rng.choice([0, 1, 2, 2, 2, 3]))]
        rows.append((source, i, cands if cands or rng.random() < 0.5 else None, "clash"))
        if cands:
            by_source.setdefault(source, []).append((i, cands))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, f"s string, i int, c {CANDIDATES}, __source string").withColumn("chosen", F.lit(1))
        got = {r.i: r.chosen for r in choose_by_viterbi(frame, ["s"], ["i"], "c").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 400
    cost = lambda a, b: (a[1] != b[1]) * 1.0 + (b[2] < a[2]) * 0.5
    total = lambda p: sum(c[0] for c in p) + sum(map(cost, p, p[1:]))
    for seen in by_source.values():
        want = total([c[k] for (_, c), k in zip(seen, best_path([c for _, c in seen]), strict=True)])
        assert abs(total([tuple(got[i]) for i, _ in seen]) - want) < 1e-6


def _readings(spark, texts, **device):
    base = {"zone_name": "Europe/Berlin", "date_order": "dmy", "video_clock": "local"} | device
    devices = spark.createDataFrame([(1, base["zone_name"], base["date_order"], base["video_clock"], "m")], "device_id int, zone_name string, date_order string, video_clock string, model_name string")
    rows = [(i, 1 if not t[2:] else t[2], t[0], t[1], None, None, i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "reading_id bigint, device_id int, detected_date string, date_source string, video_metadata_date string, filename_date string, read_at int")
    found = resolve_readings(frame, devices).collect()
    return {r.reading_id: (r.chosen.instant_us if r.chosen else None, r.determinate) for r in found}


def test_instants_by_device(spark):
    texts = [
        ("2021:07:01 12:00:00", "exif"), ("2021:07:01 12:00:00", "Filesystem-Modified"), ("2021:07:01 12:00:00", "VIDEO METADATA"), ("2021-03-28 02:30:00", "exif"), ("2021-10-31 02:30:00", "exif"),
        ("03/04/2021 00:00:00", "exif"), ("31/04/2021 00:00:00", "exif"), ("2021-07-01 12:00:00.1234567 +0200", "exif"), ("1625133600", None), ("2021-07-01", "exif"), ("", "exif"), (None, "exif"),
    ]
    got = _readings(spark, texts)
    noon = 1625133600000000
    assert got[0] == (noon, True) and got[1] == (noon + 7200_000_000, True) and got[2] == (noon, True)
    assert got[3] == (None, False) and got[4][1] is False and got[4][0] is not None
    assert got[5] == (1617400800000000, True) and got[6] == (None, False)
    assert got[7] == (noon + 123456, True) and got[8] == (noon, True)
    assert got[9] == (None, False) and got[10] == (None, False) and 11 not in got


def test_instants_without_device_or_zone(spark):
    got = _readings(spark, [("2021:07:01 12:00:00", "exif", 9), ("2021-07-01T12:00:00Z", "exif", 9), ("03/04/2021 10:00:00 Z", "exif", 9), ("2021:07:01 12:00:00", "filesystem_modified", 9)])
    assert got[0] == (None, False) and got[1] == (1625140800000000, True) and got[2][1] is False and got[3] == (1625140800000000, True)
    got = _readings(spark, [("2021:07:01 12:00:00", "exif"), ("2021:07:01 12:00:00", "filesystem modified"), ("2021:07:01 12:00:00", "video_metadata")], zone_name=None, video_clock="utc")
    assert got[0] == (None, False) and got[1] == (1625140800000000, True) and got[2] == (1625140800000000, True)


def test_ambiguous_values_are_chosen_by_their_neighbours(spark):
    """A device that writes day first and whose setting is unknown: both orders are possible up to the 12th of a month, and the first reading of an overlap is not always right."""
    moments = [datetime(2021, 2, 20, 10) + timedelta(days=3 * i, minutes=7 * i) for i in range(60)]
    texts = [(m.strftime("%d/%m/%Y %H:%M:%S"), "exif") for m in moments]
    got = _readings(spark, texts, date_order=None, zone_name="UTC")
    micros = [int(m.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000 for m in moments]
    assert sum(m.day <= 12 and m.day != m.month for m in moments) > 20
    assert [got[i][0] for i in range(60)] == micros and not any(determined for _, determined in got.values())
    month_first = [(m.strftime("%m/%d/%Y %H:%M:%S"), "exif") for m in moments]  # here the first candidate is the wrong one
    assert [v for v, _ in _readings(spark, month_first, date_order=None, zone_name="UTC").values()] == micros
    clock = [("2021-10-31 02:50:00", "exif"), ("2021-10-31 02:10:00", "exif"), ("2021-10-31 03:05:00", "exif")]
    assert [v for v, _ in _readings(spark, clock).values()] == [1635641400000000, 1635642600000000, 1635645900000000]  # the second is after the change


def test_no_readings(spark):
    frame = spark.createDataFrame([], "reading_id bigint, device_id int, detected_date string, date_source string, video_metadata_date string, filename_date string, read_at int")
    devices = spark.createDataFrame([], "device_id int, zone_name string, date_order string, video_clock string")
    assert reading_candidates(frame, devices).count() == 0
    assert resolve_readings(frame, devices).count() == 0


def _trial(spark, rng, policy):
    stems = ["x", "y", "x_001", "x_002", "y_001"] if rng.random() < 0.5 else ["x", "y"]
    plan = [(f"/s/{i:02d}", f"/d/{rng.choice(stems)}.jpg", rng.choice(["h1", "h2", None])) for i in range(rng.randint(1, 9))]
    disk = [(f"/d/{s}.jpg", rng.choice(["h1", "h3"])) for s in stems if rng.random() < 0.2]
    return plan, disk


@pytest.mark.parametrize("policy", ["check_hash", "rename", "skip"])
def test_collisions_equal_the_sequential_rule(spark, policy):
    rng = random.Random(3)
    plans, disks, want = [], [], {}
    for t in range(25):
        plan, disk = _trial(spark, rng, policy)
        plan = [(f"{t}{s}", f"/{t}{d}", h) for s, d, h in plan]
        disk = [(f"/{t}{d}", h) for d, h in disk]
        done = resolve_in_order([p[0] for p in plan], [p[1] for p in plan], [p[2] for p in plan], dict(disk), policy)
        want |= {p[0]: d for p, d in zip(plan, done, strict=True)}
        plans += plan
        disks += disk
    got = resolve_collisions(spark.createDataFrame(plans, "source string, destination string, file_hash string"), spark.createDataFrame(disks, "destination string, file_hash string"), policy)
    assert {r.source: (r.final_destination, r.outcome) for r in got.collect()} == want


def test_collisions_of_a_hot_destination(spark):
    plan = [(f"/s/{i:05d}", "/d/hot.jpg", f"h{i}") for i in range(1200)]
    done = resolve_in_order([p[0] for p in plan], [p[1] for p in plan], [p[2] for p in plan], {})
    got = {r.source: (r.final_destination, r.outcome) for r in resolve_collisions(spark.createDataFrame(plan, "source string, destination string, file_hash string")).collect()}
    assert got == {p[0]: d for p, d in zip(plan, done, strict=True)}
    assert len({final for final, _ in got.values()}) == 1200 and got["/s/01000"] == ("/d/hot_1000.jpg", "renamed")


def test_collisions_beyond_four_digits(spark):
    names = {"plain": ["/d/hot.jpg"], "numbered": ["/e/x.jpg", "/e/x_001.jpg"], "later": ["/f/hot.jpg"], "on_disk": ["/g/hot.jpg"]}
    plan = [(f"/s/{group}/{i:05d}", wanted[i % len(wanted)], f"{group}{i}") for group, wanted in names.items() for i in range(10_010 * len(wanted))]
    plan += [("/s/later/10005x", "/f/hot_10002.jpg", "late"), ("/s/later/x", "/f/hot_10003.jpg", "later10003")]
    disk = [("/g/hot.jpg", "there"), ("/g/hot_10001.jpg", "there")]
    want = {}
    for group in names:
        part = sorted(p for p in plan if p[0].startswith(f"/s/{group}/"))
        want |= {p[0]: d for p, d in zip(part, resolve_in_order([p[0] for p in part], [p[1] for p in part], [p[2] for p in part], dict(disk)), strict=True)}
    got = resolve_collisions(spark.createDataFrame(plan, "source string, destination string, file_hash string"), spark.createDataFrame(disk, "destination string, file_hash string")).collect()
    assert {r.source: (r.final_destination, r.outcome) for r in got} == want and len(got) == len(plan)
    finals = [r.final_destination for r in got if r.final_destination]
    assert len(set(finals)) == len(finals) and not set(finals) & {d for d, _ in disk}
    assert want["/s/later/x"] == (None, "duplicate in batch") and want["/s/on_disk/10000"] == ("/g/hot_10002.jpg", "renamed")


def test_collision_scenarios(spark):
    plan = spark.createDataFrame([("a", "/d/photo.jpg", "A"), ("b", "/d/photo.jpg", "B"), ("c", "/d/photo.jpg", "B"), (None, "/d/q", "x")], "source string, destination string, file_hash string")
    got = {r.source: r.final_destination for r in resolve_collisions(plan).collect()}
    assert got == {"a": "/d/photo.jpg", "b": "/d/photo_001.jpg", "c": "/d/photo_002.jpg"}
    with pytest.raises(ValueError):
        resolve_collisions(plan, policy="fail")
    assert resolve_collisions(plan.limit(0)).count() == 0


def test_ranks_and_counters(spark):
    rows = [(k, i) for i in range(60) for k in ("hot", None, f"k{i % 7}")]
    got = ranked(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"]).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r.i, r.seq) for r in got if r.k == key)
        assert [s for _, s in mine] == list(range(1, len(mine) + 1))
    names = spark.createDataFrame([("a", "X.jpg"), ("b", "x.jpg"), ("c", "x.JPG"), ("d", "y.jpg")], "source string, name string")
    assert {r.source: r.counter for r in name_counters(names).collect()} == {"a": None, "b": 1, "c": 2, "d": None}


def test_salted_join(spark, monkeypatch):
    import darkroom.session as session

    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", -1)
    big = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("z", 2)], "k string, i int")
    small = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    assert salted_join(big, small, ["k"]).count() == 50
    assert salted_join(big, small, ["k"], "left").count() == 52
    assert salted_join(big, small.select("k"), ["k"], "left_semi").count() == 50
    assert salted_join(big, small.select("k"), ["k"], "left_anti").count() == 2


def test_duplicates_and_content(spark):
    files = spark.createDataFrame([("/a.jpg", 1, "h"), ("/b.JPG", 1, "h"), ("/b.JPG", 1, "h"), ("/c.png", 1, "h"), ("/d.jpg", 1, None), ("/e.jpg", 2, "i")], "path string, size_bytes bigint, file_hash string")
    assert {r.path: r.first_path for r in duplicate_members(files, path_column="path").collect()} == {"/a.jpg": "/a.jpg", "/b.JPG": "/a.jpg", "/c.png": "/a.jpg"}
    assert {r.path: r.match for r in same_content(files.distinct(), files).collect()} == {"/a.jpg": "/b.JPG", "/b.JPG": "/a.jpg", "/c.png": "/a.jpg"}
    found = {r.path: (r.match, r.status) for r in search_content(files.distinct(), files).collect()}
    assert found["/a.jpg"] == ("/b.JPG", "ok_existing_duplicate") and found["/c.png"] == (None, "missing_destination") and found["/d.jpg"][0] is None


def test_verify_ladder(spark):
    entries = spark.createDataFrame([("s1", "d1", "copy"), ("s2", "d2", "copy"), ("s3", None, "copy"), ("s9", "d1", "copy"), ("s4", "d4", "copy"), ("s5", "d5", "move"), ("s6", "d6", "skip")], "source_path string, destination_path string, operation string")
    sources = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "b"), ("s3", 1, "a"), ("s4", 1, None)], "path string, size_bytes bigint, file_hash string")
    targets = spark.createDataFrame([("d1", 1, "a"), ("d2", 2, "c"), ("d4", 1, "x")], "path string, size_bytes bigint, file_hash string")
    want = {"s1": "ok", "s2": "mismatch", "s3": "missing_destination", "s9": "missing_source", "s4": "error", "s5": "missing_source"}
    assert {r.source_path: r.status for r in verify(entries, sources, targets).collect()} == want
    assert {r.source_path: r.status for r in verify(entries, sources, targets, "quick").collect()} == want | {"s2": "ok", "s4": "ok"}
    with pytest.raises(ValueError):
        verify(entries, sources, targets, "crc")
    assert F is not None
