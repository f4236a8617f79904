"""Instants against a plain reading of the same rules with the standard library."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from darkroom.functions.instants import instants_of_wall_clock, with_readings

EPOCH = datetime(1970, 1, 1)
ZONES = ["Europe/Berlin", "America/St_Johns", "Australia/Adelaide", "Asia/Kathmandu", "America/New_York", "Pacific/Auckland", "UTC", "Australia/Lord_Howe"]


def us(moment: datetime) -> int:
    return (moment - EPOCH) // timedelta(microseconds=1)


def plain(local: datetime, zone: str) -> list[int]:
    out = set()
    for fold in (0, 1):
        aware = local.replace(tzinfo=ZoneInfo(zone), fold=fold)
        back = aware.astimezone(timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        if back == local:
            out.add(us(aware.astimezone(timezone.utc).replace(tzinfo=None)))
    return sorted(out)


def test_wall_clocks(spark):
    rng = random.Random(8)
    rows = []
    for zone in ZONES:
        for _ in range(150):
            local = datetime(rng.randint(2008, 2025), rng.choice([3, 4, 10, 11, 9]), rng.randint(1, 30), rng.randrange(5), rng.randrange(60), rng.randrange(60))
            rows.append((len(rows), us(local), zone, plain(local, zone)))
    frame = spark.createDataFrame([r[:3] for r in rows], "i int, w bigint, z string")
    got = {r.i: r.c for r in frame.select("i", instants_of_wall_clock(F.col("w"), F.col("z")).alias("c")).collect()}
    assert all(got[i] == want for i, _, _, want in rows)
    assert {len(want) for *_, want in rows} == {0, 1, 2}


NOON = us(datetime(2021, 3, 4, 12, 5, 6))
TEXTS = {
    "2021:03:04 12:05:06": NOON, "2021-03-04T12:05:06.123456789": NOON + 123456, "2021-03-04 12:05": NOON - 6_000_000, "04.03.2021 12:05:06": NOON, "4 Mar 2021 12:05:06": NOON, "Mar 4, 2021 12:05:06 PM": NOON, "Thu, 04 Mar 2021 12:05:06": NOON,
    "20210304_120506": NOON, "20210304120506": NOON, "20210304_120506789": NOON + 789_000, "2021-03-04-12-05-06": NOON, "2021-03-04 12.05.06": NOON, " 2021-03-04 12:05:06 ": NOON, "2021-03-04 12:05:06,5": NOON + 500_000, "Mar 4, 2021 12:05:06 AM": NOON - 12 * 3600 * 1_000_000,
}
FIXED = {
    "2021-03-04T12:05:06Z": NOON, "2021-03-04t12:05:06z": NOON, "20210304T120506Z": NOON, "2021-03-04 14:05:06+02": NOON, "2021-03-04 17:50:06 +0545": NOON, "2021-03-04 08:35:06-03:30": NOON, "2021-03-04 13:05:06 CET": NOON, "2021-03-04 07:05:06 EST": NOON,
    "2021-03-04 12:05:06 UTC+0": NOON, "2021-03-04 12:05:06 (UTC)": NOON, "Thu, 04 Mar 2021 12:05:06 GMT": NOON, "1614859506": NOON, "1614859506.25": NOON + 250_000, "1614859506000": NOON, "1614859506000000": NOON,
}
NONE = ["", " ", "2021", "2021-03", "2021-03-04", "20210304", "2021-02-29 10:00:00", "2021-13-01 00:00:00", "2021-03-04 24:00:00", "2021-03-04 12:60:00", "2021-03-04 12:05:60", "31.04.2021 10:00:00", "yesterday", "n/a", "    :  :     :  :  ", "2021-03-04 12:05:06 XYZ", "2021-03-04 12:05:06+25:00", "2021-03-04 13:05:06 PM", "2021-03-04 12:05:06 Mars/Base"]


def test_texts(spark):
    every = [*TEXTS, *FIXED, *NONE, "2021-03-04 12:05:06 [Europe/Berlin]", "03/04/2021 12:00:00", "13/04/2021 12:00:00", "x" * 100_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(every)] + [(-1, None)], "i int, t string")
    got = {(every[r.i] if r.i >= 0 else None): r.readings for r in with_readings(frame, "t").collect()}
    assert got[None] is None
    for text, want in TEXTS.items():
        assert [(r.wall_us, r.epoch_us) for r in got[text]] == [(want, None)], text
    for text, want in FIXED.items():
        assert [r.epoch_us for r in got[text]] == [want], text
    for text in [*NONE, "x" * 100_000]:
        assert got[text] == [], text
    assert got["2021-03-04 12:05:06 [Europe/Berlin]"][0].zone == "Europe/Berlin"
    assert [r.fmt for r in got["03/04/2021 12:00:00"]] == ["dmy", "mdy"] and [r.fmt for r in got["13/04/2021 12:00:00"]] == ["dmy"]
