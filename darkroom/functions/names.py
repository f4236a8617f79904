"""New file names and size texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkroom.functions import paths
from darkroom.functions.tags import NAME_TAG_LENGTH, format_tag

_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%I": "hh", "%p": "a", "%f": "SSSSSS", "%%": "%"}


def date_pattern(strftime: str) -> str:
    """A strftime format as a Spark date pattern; unknown directives are refused."""
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%":
            directive = strftime[i : i + 2]
            if directive not in _STRFTIME:
                raise ValueError(f"unsupported date directive {directive!r}")
            out += _STRFTIME[directive]
            i += 2
        else:
            ch = strftime[i]
            out += "''" if ch == "'" else f"'{ch}'" if ch.isalpha() else ch
            i += 1
    return out


def _cleaned(name: Column, path: Column, lowercase: bool) -> Column:
    plain = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_|_$", "")
    return F.concat(plain, paths.extension(path) if lowercase else paths.suffix(path))


def new_name(
    path: Column,
    date: Column,
    tag: Column | None = None,
    counter: Column | None = None,
    pattern: str = "{date}_{time}",
    date_format: str = "%Y%m%d",
    time_format: str = "%H%M%S",
    tag_format: str = "_{tag}",
    lowercase_ext: bool = True,
) -> Column:
    """A file name from a pattern of ``{date} {time} {original} {tag} {counter}``; null without a date. Placeholders are filled one after
    the other; a null counter leaves ``{counter}`` as it stands."""
    none = F.lit(None).cast("string")
    mark = format_tag(tag, NAME_TAG_LENGTH) if tag is not None else none
    has_tag = F.coalesce(tag, F.lit("")) != "" if tag is not None else F.lit(False)
    out = F.replace(F.replace(F.replace(F.lit(pattern), F.lit("{date}"), F.date_format(date, date_pattern(date_format))), F.lit("{time}"), F.date_format(date, date_pattern(time_format))), F.lit("{original}"), paths.stem(path))
    inner = F.replace(out, F.lit("{tag}"), F.when(has_tag, mark).otherwise(""))
    outer = F.when(has_tag, F.concat(out, F.replace(F.lit(tag_format), F.lit("{tag}"), mark))).otherwise(out)
    out = F.when(out.contains("{tag}"), inner).otherwise(outer)
    if counter is not None:
        number = F.lpad(counter.cast("string"), 3, "0")
        number = F.when(counter > 999, counter.cast("string")).otherwise(number)
        counted = F.when(out.contains("{counter}"), F.replace(out, F.lit("{counter}"), number)).otherwise(F.concat(out, F.lit("_"), number))
        out = F.when(counter.isNull(), out).otherwise(counted)
    return _cleaned(out, path, lowercase_ext)


def tagged_name(path: Column, tag: Column, lowercase_ext: bool = True) -> Column:
    """The original name with the tag appended."""
    return _cleaned(F.concat_ws("_", paths.stem(path), format_tag(tag, NAME_TAG_LENGTH)), path, lowercase_ext)


def needs_rename(path: Column, expected: Column) -> Column:
    return F.lower(paths.file_name(path)) != F.lower(expected)


_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _size_text(size: Column, digits: int) -> Column:
    out = None
    for power, unit in enumerate(_UNITS):
        text = F.format_string(f"%.{digits}f {unit}", size / F.lit(float(1024**power)))
        if power == len(_UNITS) - 1:
            return out.otherwise(text)
        small = F.abs(size) < F.lit(1024 ** (power + 1))
        out = F.when(small, text) if out is None else out.when(small, text)
    return out


def human_size(size: Column) -> Column:
    """Size with two decimals, in steps of 1024."""
    return _size_text(size, 2)


def signed_size(size: Column) -> Column:
    """Size with one decimal, by its absolute value."""
    return _size_text(size, 1)


def clipped(text: Column, limit: int = 37) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)
