"""Folder classification and tag expressions."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.functions import paths

# Folder names that never serve as a tag unless the configuration has its own list.
IGNORED_FOLDERS = [
    "tosort", "unsorted", "misc", "backup", "temp", "tmp", "download", "downloads", "dcim", "camera", "pictures",
    "photos", "images", "100apple", "100andro", "camera roll", "new folder", "untitled", "unknown", "other", "various",
    "screenshot", "screenshots", "inbox", "import", "imported", "exports", "export", "shared", "public", "private",
]
# Names that cameras give to folders.
CAMERA_PATTERNS = [r"(?i)^\d{3}[A-Z]{5}$", r"^\d{3}_\d{4}$", r"(?i)^IMG_\d+$", r"(?i)^DSC_?\d+$", r"(?i)^DCIM$", r"^\d{8}$"]
TAG_LENGTH, NAME_TAG_LENGTH = 40, 30
_EDGES = r"^[_-]+|[_-]+$"


def numbers_only(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[-_./\s]", "").rlike(r"^\d+$")


def classify_folder(
    name: Column,
    ignored: Sequence[str] = tuple(IGNORED_FOLDERS),
    forced: Sequence[str] = (),
    min_length: int = 3,
    max_length: int = TAG_LENGTH,
    decision: Column | None = None,
) -> Column:
    """``struct<usable, reason>``. ``decision`` is the rule's (``use``/``ignore``/null) and comes before the lists."""
    plain = F.lower(F.trim(name))
    steps: list[tuple[Column, bool, str]] = [(F.coalesce(name, F.lit("")) == "", False, "empty")]
    if decision is not None:
        steps += [(decision == "use", True, "in_rules_use_list"), (decision == "ignore", False, "in_rules_ignore_list")]
    if forced:
        steps.append((plain.isin(*[f.lower() for f in forced]), True, "in_force_list"))
    steps += [
        (plain.isin(*[i.lower() for i in (ignored or IGNORED_FOLDERS)]), False, "in_ignore_list"),
        (F.length(name) < min_length, False, "too_short"),
        (F.length(name) > max_length, False, "too_long"),
        (F.lit(False), False, "camera_generated"),
        (numbers_only(name), False, "numbers_only"),
        (~name.rlike(r"\p{L}"), False, "no_letters"),
    ]
    camera = F.lit(False)
    for pattern in CAMERA_PATTERNS:
        camera = camera | name.rlike(pattern)
    out = None
    for test, usable, reason in steps:
        test = camera if reason == "camera_generated" else test
        value = F.struct(F.lit(usable).alias("usable"), F.lit(reason).alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit(True).alias("usable"), F.lit("meaningful").alias("reason")))


def format_tag(name: Column, max_length: int = TAG_LENGTH, alias: Column | None = None) -> Column:
    """Blanks to underscores, other characters than letters, digits, ``_`` and ``-`` dropped, ends trimmed, cut to length."""
    words = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_")
    kept = F.regexp_replace(F.regexp_replace(words, r"(?U)[^\w\-]", ""), _EDGES, "")
    cut = F.when(F.length(kept) > max_length, F.regexp_replace(F.substring(kept, 1, max_length), r"[_-]+$", "")).otherwise(kept)
    return cut if alias is None else F.coalesce(alias, cut)


def nearest_tag(path: Column, levels: int = 3, **rules: object) -> Column:
    """Formatted tag of the nearest usable of the folders above a file."""
    found = []
    for level in range(1, levels + 1):
        folder = paths.ancestor(path, level)
        found.append(F.when(classify_folder(folder, **rules)["usable"], format_tag(folder)))  # type: ignore[arg-type]
    return F.coalesce(*found)


@F.pandas_udf(T.BooleanType())
def _tag_in_name(names: pd.Series, tags: pd.Series, threshold: pd.Series) -> pd.Series:
    out = []
    for name, tag, least in zip(names, tags, threshold, strict=True):
        if not name or not tag:
            out.append(False)
            continue
        low_tag = tag.lower()
        dot = name.rfind(".")
        stem = name[:dot] if 0 < dot < len(name) - 1 else name
        pieces = [p for p in regex.split(r"[-_\s]+", stem) if len(p) >= 2]
        out.append(low_tag in name.lower() or any(SequenceMatcher(None, p.lower(), low_tag).ratio() >= least for p in [*pieces, stem]))
    return pd.Series(out, dtype=bool)


def tag_in_name(name: Column, tag: Column, threshold: float = 0.75) -> Column:
    """Whether a tag stands in a file name, exactly or nearly (longest-common-blocks ratio)."""
    return _tag_in_name(name, tag, F.lit(threshold))
