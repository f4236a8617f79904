"""Reading date texts of unknown notation: every valid interpretation of a value, as Column expressions only.

All arithmetic is on microseconds counted as if the wall clock were UTC, so nothing depends on the session time zone.
"""

from __future__ import annotations

from functools import cache
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
_BLANKS = "[\\s\\u00a0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]+"

#: Zone abbreviations that mean one offset wherever they are written by a camera or phone (minutes east of UTC).
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2})([:.-])(\d{2})(?:\2(\d{2})(?:[.,](\d+))?)?\s*(?:([AaPp])\.?[Mm]\.?(?![A-Za-z]))?\s*(.*)"
#: Notations of a date text, tried in this order.
PATTERNS = {
    "epoch_s": r"^(\d{9,10})(?:[.,](\d+))?$",
    "epoch_ms": r"^\d{13}$",
    "epoch_us": r"^\d{16}$",
    "epoch_ns": r"^\d{19}$",
    "compact14": r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})()\s*((?:[A-Za-z\[(+-].*)?)$",
    "compact": r"^(\d{4})(\d{2})(\d{2})[Tt_ -](\d{2})(\d{2})(\d{2})?(?:[.,]?(\d{1,9}))?\s*((?:[A-Za-z\[(+-].*)?)$",
    "ymd": r"^(\d{4})([-:/.])(\d{1,2})\2(\d{1,2})(?:[Tt]\s*|[ ,-]+)(\d.*)$",
    "dmy_dots": r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[Tt ,]+(\d.*)$",
    "slashes": r"^(\d{1,2})/(\d{1,2})/(\d{4})[Tt ,]+(\d.*)$",
    "day_name": r"^(?:[A-Za-z]{3,9}\.?,? +)?(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ ,-]+(\d{4}),?[Tt ]+(\d.*)$",
    "name_day": r"^(?:[A-Za-z]{3,9}\.?,? +)?([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4}),? +(\d.*)$",
}
_OFFSET = r"^(?:UTC|GMT)? *([+-])(\d{1,2}):?(\d{2})? *(?:\[[A-Za-z_/+-]+\])?$"
_ZONE = r"^[\[(]?([A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)[\])]?$"
_ABBREVIATION = r"^[\[(]?([A-Za-z]{1,5})[\])]?$"


@cache
def known_zones() -> tuple[str, ...]:
    """Region zone names that both this Python and any current JVM know."""
    return tuple(sorted(z for z in available_timezones() if "/" in z and not z.startswith(("SystemV/", "posix/", "right/", "Etc/GMT"))) + ["UTC"])


def clean(text: Column) -> Column:
    """Blanks of every kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def zone_or_null(zone: Column) -> Column:
    return F.when(zone.isin(*known_zones()), zone)


def zone_offset_us(zone: Column, instant_us: Column) -> Column:
    """Offset of a region zone at an instant. The zone must be known; null gives null."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant_us), zone)) - instant_us


def instants_of_wall_clock(local_us: Column, zone: Column) -> Column:
    """All instants at which the clocks of a zone show the reading, ascending: one as a rule, none in a gap, two in an overlap."""
    early = local_us - zone_offset_us(zone, local_us - F.lit(DAY_US))
    late = local_us - zone_offset_us(zone, local_us + F.lit(DAY_US))
    both = F.sort_array(F.array_distinct(F.array(early, late)))
    return F.when(local_us.isNull() | zone.isNull(), F.lit(None)).otherwise(
        F.filter(both, lambda c: c.isNotNull() & (c + zone_offset_us(zone, c) == local_us))
    )


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int"), F.lit(0))


def _micros(fraction: Column) -> Column:
    """Digits of a fraction of a second as microseconds; digits after the sixth are cut."""
    return F.rpad(F.substring(F.coalesce(fraction, F.lit("")), 1, 6), 6, "0").try_cast("bigint")


def staged(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row generator. Filters and projections on the new columns are then not inlined into their definitions;
    without it a chain of such columns, each used several times, multiplies in the optimizer."""
    made = F.struct(*[column.alias(name) for name, column in new.items()])
    return df.select("*", F.explode(F.array(made)).alias("__made")).select(*[c for c in df.columns if c not in new], "__made.*")


READING = "array<struct<fmt:string,wall_us:bigint,zone:string,epoch_us:bigint>>"


def with_readings(df: DataFrame, text: str, into: str = "readings") -> DataFrame:
    """Adds every interpretation of the date text in column ``text`` as ``array<struct<fmt, wall_us, zone, epoch_us>>``.

    ``fmt`` names the notation (``ymd``, ``dmy_dots``, ``dmy``, ``mdy``, ``name``, ``compact``, ``epoch``); a slash date gives both
    orders where both are possible dates. ``epoch_us`` is set when the text itself fixes the instant (an offset, ``Z``, an
    abbreviation or a count from 1970); otherwise ``wall_us`` is a wall-clock reading, in ``zone`` where the text names one. A text
    without a time of day, an impossible date or time, or one that is not understood gives an empty array; null gives null.
    """
    keep = df.columns
    c = F.col

    def pick(*pairs: tuple[str, int]) -> Column:
        out = None
        for kind, i in pairs:
            value = F.regexp_extract(c("__t"), PATTERNS[kind], i)
            out = F.when(c("__kind") == kind, value) if out is None else out.when(c("__kind") == kind, value)
        return out

    kind = None
    for name, pattern in PATTERNS.items():
        hit = c("__t").rlike(pattern)
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
    out = staged(df, {"__t": clean(c(text))})
    out = staged(out, {"__kind": kind})
    out = staged(
        out,
        {
            "__tail": pick(("ymd", 5), ("dmy_dots", 4), ("slashes", 4), ("day_name", 4), ("name_day", 4)),
            "__y": _int(pick(("ymd", 1), ("dmy_dots", 3), ("slashes", 3), ("day_name", 3), ("name_day", 3), ("compact14", 1), ("compact", 1))),
            "__a": pick(("ymd", 3), ("dmy_dots", 2), ("slashes", 2), ("day_name", 2), ("name_day", 1), ("compact14", 2), ("compact", 2)),
            "__b": _int(pick(("ymd", 4), ("dmy_dots", 1), ("slashes", 1), ("day_name", 1), ("name_day", 2), ("compact14", 3), ("compact", 3))),
        },
    )
    clock = rf"^{_CLOCK}$"
    is_compact = c("__kind").startswith("compact")

    def part(clock_group: int, compact_group: int) -> Column:
        return F.when(is_compact, pick(("compact14", compact_group), ("compact", compact_group))).otherwise(F.regexp_extract(c("__tail"), clock, clock_group))

    out = staged(
        out,
        {
            "__m": F.when(c("__kind").isin("day_name", "name_day"), _month(c("__a"))).otherwise(_int(c("__a"))),
            "__h": _int(part(1, 4)),
            "__half": F.when(is_compact, F.lit("")).otherwise(F.upper(F.regexp_extract(c("__tail"), clock, 6))),
            "__min": _int(part(3, 5)),
            "__s": F.coalesce(_int(part(4, 6)), F.lit(0)),
            "__us": _micros(part(5, 7)),
            "__z": F.trim(part(7, 8)),
        },
    )
    hour = F.when(c("__half") == "", c("__h")).when(c("__h").between(1, 12), c("__h") % 12 + F.when(c("__half") == "P", 12).otherwise(0))
    short = F.nullif(F.upper(F.regexp_extract(c("__z"), _ABBREVIATION, 1)), F.lit(""))
    hours, minutes = _int(F.regexp_extract(c("__z"), _OFFSET, 2)), F.coalesce(_int(F.regexp_extract(c("__z"), _OFFSET, 3)), F.lit(0))
    numeric = F.when(
        (hours * 60 + minutes <= 14 * 60) & (minutes <= 59), F.when(F.regexp_extract(c("__z"), _OFFSET, 1) == "-", -1).otherwise(1) * (hours * 60 + minutes)
    )
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), short)
    out = staged(
        out,
        {
            "__clock": F.when(
                (hour <= 23) & (c("__min") <= 59) & (c("__s") <= 59),
                ((hour * 60 + c("__min")) * 60 + c("__s")).cast("bigint") * F.lit(1_000_000) + c("__us"),
            ),
            "__off": F.when(c("__z").rlike(_OFFSET), numeric).when(short.isNotNull(), named),
            "__region": F.when(c("__z").rlike(_ZONE), zone_or_null(F.regexp_extract(c("__z"), _ZONE, 1))),
        },
    )

    def wall(year: Column, month: Column, day: Column) -> Column:
        """Microseconds from 1970 by the calendar's arithmetic; null for a day that the month lacks."""
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        y = year - F.when(month <= 2, 1).otherwise(0)  # years from March on, so that the leap day is the last
        days = y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + F.floor(((month + 9) % 12 * 153 + 2) / 5) + day - 719469
        return F.when(month.between(1, 12) & (day >= 1) & (day <= length) & (year >= 1), days.cast("bigint") * F.lit(DAY_US) + c("__clock"))

    digits = c("__t")
    counted = (
        F.when(c("__kind") == "epoch_s", F.regexp_extract(digits, PATTERNS["epoch_s"], 1).try_cast("bigint") * F.lit(1_000_000) + _micros(F.regexp_extract(digits, PATTERNS["epoch_s"], 2)))
        .when(c("__kind") == "epoch_ms", digits.try_cast("bigint") * F.lit(1_000))
        .when(c("__kind") == "epoch_us", digits.try_cast("bigint"))
        .when(c("__kind") == "epoch_ns", F.substring(digits, 1, 16).try_cast("bigint"))
    )
    out = staged(out, {"__w1": wall(c("__y"), c("__m"), c("__b")), "__w2": F.when(c("__kind") == "slashes", wall(c("__y"), c("__b"), c("__m"))), "__n": counted})
    understood = (c("__z") == "") | c("__off").isNotNull() | c("__region").isNotNull()

    def reading(fmt: Column, wall_us: Column) -> Column:
        made = F.struct(
            fmt.alias("fmt"),
            wall_us.alias("wall_us"),
            F.when(c("__off").isNull(), c("__region")).alias("zone"),
            (wall_us - c("__off").cast("bigint") * F.lit(60_000_000)).alias("epoch_us"),
        )
        return F.when(wall_us.isNotNull() & understood, made)

    notation = F.when(c("__kind") == "slashes", "dmy").when(is_compact, "compact").when(c("__kind").isin("day_name", "name_day"), "name").otherwise(c("__kind"))
    epoch = F.struct(F.lit("epoch").alias("fmt"), F.lit(None).cast("bigint").alias("wall_us"), F.lit(None).cast("string").alias("zone"), c("__n").alias("epoch_us"))
    all_of = F.array(F.when(c("__n").isNotNull(), epoch), reading(notation, c("__w1")), reading(F.lit("mdy"), c("__w2")))
    found = F.when(c("__t").isNotNull(), F.filter(all_of, lambda r: r.isNotNull())).cast(READING)
    return staged(out, {into: found}).select(*keep, into)
