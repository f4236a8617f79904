"""Capture-date expressions: parsing of names and metadata texts, the source cascade, destinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkroom.functions import paths

YEARS = (1990, 2100)

# The notations recognised in folder names, in the order in which they are tried.
FOLDER_PATTERNS = [
    (r"^(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"^(\d{4})_(\d{2})_(\d{2})", "ymd"),
    (r"^(\d{4})\.(\d{2})\.(\d{2})", "ymd"),
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", "ymd"),
    (r"^(\d{4})-(\d{2})(?!\d)", "ym"),
    (r"^(\d{4})_(\d{2})(?!\d)", "ym"),
    (r"^(\d{4})\.(\d{2})(?!\d)", "ym"),
    (r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"(\d{4})_(\d{2})_(\d{2})", "ymd"),
    (r"(\d{4})-(\d{2})(?!\d)", "ym"),
    (r"(?:^|\D)(\d{4})(?:\D|$)", "y"),
]
# The notations recognised in file names, in the order in which they are tried.
FILENAME_PATTERNS = [
    (r"(\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})", "ymdhms"),
    (r"(?i)IMG-(\d{4})(\d{2})(\d{2})-WA\d+", "ymd"),
    (r"(?i)VID-(\d{4})(\d{2})(\d{2})-WA\d+", "ymd"),
    (r"(?i)IMG[_-](\d{4})(\d{2})(\d{2})(?!\d)", "ymd"),
    (r"(?:^|[^0-9])(\d{4})(\d{2})(\d{2})(?!\d)", "ymd"),
    (r"(\d{4})-(\d{2})-(\d{2})", "ymd"),
    (r"(\d{4})_(\d{2})_(\d{2})", "ymd"),
    (r"(?i)IMG[_-](\d{2})(\d{2})(\d{2})(?!\d)", "yymmdd"),
    (r"^(\d{2})(\d{2})(\d{2})(?!\d)", "yymmdd"),
]
# Formats of embedded dates.
EXIF_FORMATS = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd HH:mm", "yyyy-MM-dd HH:mm"]
VIDEO_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd"]
# The usual order of date sources, and the folder structures.
DEFAULT_PRIORITY = ["exif", "video_metadata", "filename", "filesystem", "folder_name"]
FOLDER_STRUCTURES = {"YYYY": "yyyy", "YYYY/MM": "yyyy/MM", "YYYY/MM/DD": "yyyy/MM/dd"}


def _stamp(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def expand_two_digit_year(yy: Column, cutoff: int = 30) -> Column:
    return F.when(yy <= cutoff, yy + 2000).otherwise(yy + 1900)


def parse_pattern(text: Column, pattern: str, kind: str, cutoff: int = 30) -> Column:
    """Date of the first match of one pattern; null if there is none or the date or time is impossible."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    year = part(1)
    if kind == "yymmdd":
        year = expand_two_digit_year(part(1).try_cast("int"), cutoff).cast("string")
    month = part(2) if kind != "y" else F.lit("01")
    day = part(3) if kind in ("ymd", "ymdhms", "yymmdd") else F.lit("01")
    clock = F.concat_ws(":", part(4), part(5), part(6)) if kind == "ymdhms" else F.lit("00:00:00")
    return F.when(text.rlike(pattern) & year.try_cast("int").between(*YEARS), _stamp(F.concat(F.concat_ws("-", year, month, day), F.lit(" "), clock)))


def filename_date(file_stem: Column, cutoff: int = 30, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*[parse_pattern(file_stem, p, k, cutoff) for p, k in FILENAME_PATTERNS])


def folder_date(folder: Column) -> Column:
    return F.coalesce(*[parse_pattern(folder, p, k) for p, k in FOLDER_PATTERNS])


def nearest_folder_date(path: Column, levels: int = 3) -> Column:
    """Date of the nearest of the folders above a file that has one. The cascade of patterns is written once, over an array of the
    names: repeated for each level it would outgrow the size of a generated method."""
    above = F.array(*[paths.ancestor(path, i) for i in range(1, levels + 1)])
    return F.get(F.filter(F.transform(above, folder_date), lambda x: x.isNotNull()), F.lit(0))


_SHAPES = {"yyyy": r"\d{4}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}


def _parse_format(text: Column, fmt: str) -> Column:
    shape = "^"
    i = 0
    while i < len(fmt):
        token = next((t for t in _SHAPES if fmt.startswith(t, i)), None)
        shape += _SHAPES[token] if token else fmt[i]
        i += len(token) if token else 1
    return F.when(text.rlike(shape + "$"), F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))


def exif_date(text: Column) -> Column:
    """Embedded still-image date; the zero date and other texts give null."""
    return F.coalesce(*[_parse_format(F.trim(text), f) for f in EXIF_FORMATS])


def video_date(text: Column) -> Column:
    """Container date with its offset dropped, not applied; fractions of seconds are kept with ISO notation."""
    trimmed = F.trim(text)
    iso = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(?:Z|[+-]\d{2}:?\d{2})$"
    parsed = F.when(trimmed.rlike(iso), _stamp(F.concat_ws(" ", F.regexp_extract(trimmed, iso, 1), F.regexp_extract(trimmed, iso, 2))))
    return F.coalesce(parsed, *[_parse_format(trimmed, f) for f in VIDEO_FORMATS])


def best_exif(original: Column, taken: Column, digitised: Column) -> Column:
    return F.coalesce(original, taken, digitised)


def cascade(candidates: dict[str, Column], priority: Sequence[str] = tuple(DEFAULT_PRIORITY)) -> Column:
    """``struct<date, source>`` of the first source in priority order that has a date; source ``unknown`` if none has."""
    labels = {"filesystem": "filesystem_modified"}
    unknown = [s for s in priority if s not in candidates]
    if unknown:
        raise ValueError(f"date sources without a column: {unknown}")
    found = [F.when(candidates[s].isNotNull(), F.struct(candidates[s].cast("timestamp_ntz").alias("date"), F.lit(labels.get(s, s)).alias("source"))) for s in priority]
    return F.coalesce(*found, F.struct(F.lit(None).cast("timestamp_ntz").alias("date"), F.lit("unknown").alias("source")))


def mismatch_days(detected: Column, from_name: Column) -> Column:
    """Absolute value of the floored signed difference in days."""
    micros = F.timestamp_diff("MICROSECOND", from_name.cast("timestamp_ntz"), detected.cast("timestamp_ntz"))
    return F.abs(F.floor(micros / F.lit(86_400_000_000))).cast("int")


def destination_folder(date: Column, structure: str = "YYYY/MM", root: str | None = None) -> Column:
    relative = F.date_format(date, FOLDER_STRUCTURES.get(structure, FOLDER_STRUCTURES["YYYY/MM"]))
    return relative if root is None else F.concat_ws("/", F.lit(root.rstrip("/")), relative)


def full_destination(path: Column, date: Column, root: str, structure: str = "YYYY/MM", new_name: Column | None = None) -> Column:
    """Folder and file name; a new name without extension gets the lower-case one of the source."""
    name = paths.file_name(path) if new_name is None else F.when(paths.suffix(new_name) == "", F.concat(new_name, paths.extension(path))).otherwise(new_name)
    return F.when(date.isNotNull(), F.concat_ws("/", destination_folder(date, structure, root), name))


def age_text(then: Column, now: Column) -> Column:
    """Age in days, hours or minutes, ``just now`` below a minute."""
    seconds = F.timestamp_diff("SECOND", then.cast("timestamp_ntz"), now.cast("timestamp_ntz"))

    def unit(size: int, name: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {name}(s) ago"))

    return F.when(seconds >= 86400, unit(86400, "day")).when(seconds >= 3600, unit(3600, "hour")).when(seconds >= 60, unit(60, "minute")).otherwise("just now")
