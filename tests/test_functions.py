from datetime import datetime

import pytest
from pyspark.sql import functions as F

from darkroom.functions import dates, names, paths, tags


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def day(text):
    return datetime.fromisoformat(text) if text else None


NAMES = {
    "IMG_20240315_143000": "2024-03-15 14:30:00", "photo_20240315_143000": "2024-03-15 14:30:00", "20240315-143000": "2024-03-15 14:30:00",
    "Screenshot_20240315_143000": "2024-03-15 14:30:00", "IMG-20240315-WA0001": "2024-03-15", "vid-20240315-wa0001": "2024-03-15", "img_20240315": "2024-03-15",
    "photo_2024-03-15": "2024-03-15", "2024_03_15_vacation": "2024-03-15", "IMG_090831": "2009-08-31", "IMG_990831": "1999-08-31", "IMG_290101": "2029-01-01",
    "photo": None, "IMG_1234": None, "IMG_20240229_250000": "2024-02-29", "IMG_20241315_143000": None, "IMG_20230229": None, "20240315143000": None, "IMG_300101": "2030-01-01",
    "IMG_310101": None, "2024-02-30_20240301": "2024-03-01", "20240315_1430": "2024-03-15", "120315_x": "2012-03-15", "2100_12_31": "2100-12-31", "2101-01-01": None, "1989-12-31": None, "": None,
}
FOLDERS = {
    "2024-03-15": "2024-03-15", "2024.03.15": "2024-03-15", "20240315": "2024-03-15", "2024_03": "2024-03-01", "2023-12-25 Christmas": "2023-12-25", "Trip 2024_03_15": "2024-03-15",
    "2024_03 Trip": "2024-03-01", "Paris 2024": "2024-01-01", "2024-13-01": "2024-01-01", "2023-02-29": "2023-02-01", "Trip 2024.03.15": "2024-01-01", "Summer 1985": None, "123456": None,
}


def test_file_name_dates(spark):
    assert column(spark, [*NAMES, None], dates.filename_date) == [*map(day, NAMES.values()), None]
    assert column(spark, ["IMG_20240315"], lambda c: dates.filename_date(c, enabled=False)) == [None]


def test_folder_dates(spark):
    assert column(spark, [*FOLDERS, None], dates.folder_date) == [*map(day, FOLDERS.values()), None]
    assert column(spark, ["/a/2024-05-06/x/y/f.jpg", "/2024-05-06/a/b/c/f.jpg"], dates.nearest_folder_date) == [day("2024-05-06"), None]


def test_embedded_dates(spark):
    good = ["2024:03:15 14:30:00", "2024-03-15 14:30:00", "2024/03/15 14:30:00", " 2024:03:15 14:30:00 "]
    assert column(spark, good, dates.exif_date) == [datetime(2024, 3, 15, 14, 30)] * 4
    assert column(spark, ["2024:03:15 14:30", "0000:00:00 00:00:00", "", "x", None], dates.exif_date) == [datetime(2024, 3, 15, 14, 30), None, None, None, None]
    video = ["2024-03-15T14:30:00Z", "2024-03-15T14:30:00+00:00", "2024-03-15T14:30:00+0500", "2024-03-15 14:30:00", "2024:03:15 14:30:00", "15/03/2024 14:30:00"]
    assert column(spark, video, dates.video_date) == [datetime(2024, 3, 15, 14, 30)] * 6
    assert column(spark, ["2024-03-15T14:30:00.123456Z", "2024-03-15", "not a date", None], dates.video_date) == [datetime(2024, 3, 15, 14, 30, 0, 123456), datetime(2024, 3, 15), None, None]


def test_mismatch_floors_the_signed_difference(spark):
    frame = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' a, timestamp_ntz'2024-01-01 14:00:00' b")
    assert frame.select(dates.mismatch_days(F.col("a"), F.col("b")), dates.mismatch_days(F.col("b"), F.col("a"))).first()[:] == (1, 0)


def test_cascade_takes_the_first_source(spark):
    frame = spark.sql("select cast(null as timestamp_ntz) a, timestamp_ntz'2020-01-01 00:00:00' b")
    best = frame.select(dates.cascade({"exif": F.col("a"), "filesystem": F.col("b")}, ["exif", "filesystem"]).alias("x"), dates.cascade({"exif": F.col("a")}, ["exif"]).alias("y")).first()
    assert (best.x.source, best.y.source, best.y.date) == ("filesystem_modified", "unknown", None)
    with pytest.raises(ValueError):
        dates.cascade({}, ["exif"])


def test_paths(spark):
    given = ["/a/b.tar.gz", "/a/.bashrc", "/a/x.", "/a/IMG.JPG", "plain", None]
    assert column(spark, given, paths.suffix) == [".gz", "", "", ".JPG", "", None]
    assert column(spark, given, paths.stem) == ["b.tar", ".bashrc", "x.", "IMG", "plain", None]
    assert column(spark, ["/a/.b/c", "/a/b.c/d"], paths.is_hidden) == [True, False]
    assert column(spark, ["/a/b/c", "/c"], lambda c: paths.ancestor(c, 1)) == ["b", None]


def test_folders(spark):
    given = {"100APPLE": "in_ignore_list", "101ANDRO": "camera_generated", "DCIM": "in_ignore_list", "20240315": "camera_generated", "12-34": "numbers_only", "ab": "too_short", "": "empty", "???": "no_letters", "Paris 2022": "meaningful", "x" * 41: "too_long", "tosort": "in_ignore_list"}
    assert column(spark, [*given, None], lambda c: tags.classify_folder(c)["reason"]) == [*given.values(), "empty"]
    assert column(spark, ["tosort"], lambda c: tags.classify_folder(c, decision=F.lit("use"))["usable"]) == [True]
    assert column(spark, ["Keep"], lambda c: tags.classify_folder(c, ignored=["keep"], forced=["KEEP"])["reason"]) == ["in_force_list"]


def test_tags(spark):
    assert column(spark, [" Paris  Trip! ", "Été_à b", "__x__", "a" * 39 + "_b", None], tags.format_tag) == ["Paris_Trip", "Été_à_b", "x", "a" * 39, None]
    pairs = [("Paris_photo.jpg", "Paris", True), ("paris_photo.jpg", "PARIS", True), ("ParisTrip_001.jpg", "Paris_Trip", True), ("IMG_001.jpg", "Paris", False), ("", "Paris", False), ("prs_1.jpg", "paris", True), (None, "x", False), ("x.jpg", None, False)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.x for r in frame.select("i", tags.tag_in_name(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [p[2] for p in pairs]


def test_names(spark):
    frame = spark.sql("select '/a/IMG_1234.JPG' p, timestamp_ntz'2024-03-15 14:30:00' d")
    row = frame.select(
        names.new_name(F.col("p"), F.col("d")), names.new_name(F.col("p"), F.col("d"), F.lit("Paris")), names.tagged_name(F.col("p"), F.lit("Paris")),
        names.new_name(F.col("p"), F.col("d"), counter=F.lit(3)), names.new_name(F.col("p"), F.col("d"), pattern="{original}_{counter}", counter=F.lit(12)),
        names.new_name(F.col("p"), F.col("d"), F.lit("Paris"), pattern="{tag}_{date}"), names.new_name(F.col("p"), F.col("d"), pattern="{date}_{counter}"),
    ).first()
    assert row[:] == ("20240315_143000.jpg", "20240315_143000_Paris.jpg", "IMG_1234_Paris.jpg", "20240315_143000_003.jpg", "IMG_1234_012.jpg", "Paris_20240315.jpg", "20240315_{counter}.jpg")
    with pytest.raises(ValueError):
        names.date_pattern("%Q")


def test_sizes(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1 << 20, 1 << 50], names.human_size, "bigint") == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "1.00 MB", "1.00 PB"]
    assert column(spark, [-1536, 10], names.signed_size, "bigint") == ["-1.5 KB", "10.0 B"]
