"""Operation plans and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions import dates, names, paths
from darkroom.operators import collisions

# The columns of an export, in order.
COLUMNS = [
    "path", "filename", "size_bytes", "extension", "date_taken", "date_source", "year", "month", "target_path", "filename_date", "date_mismatch",
    "date_mismatch_days", "video_metadata_date", "error_category", "source_folder_name", "folder_tags", "folder_tag_reasons", "folder_tag",
    "folder_tag_reason", "folder_tag_usable", "proposed_destination_folder", "proposed_filename", "proposed_target_path", "file_hash", "is_duplicate", "duplicate_of",
]


def iso_text(moment: Column) -> Column:
    """ISO text; microseconds only where there are some."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", moment) == moment, whole).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def joined_path(folder: Column, name: Column, path: Column) -> Column:
    return F.when(folder.isNotNull(), F.concat(folder, F.lit("/"), F.coalesce(name, paths.file_name(path))))


def named(dated: DataFrame, rename: bool, tag_names: bool, naming: dict | None = None) -> DataFrame:
    """Adds ``planned_name``. Renamed files get names by the pattern, unique over the whole plan; a pattern with ``{counter}`` has the counter in its place, else it is appended.
    ``naming``: pattern, date_format, time_format, tag_format and lowercase_ext of ``names.new_name``."""
    path, day, naming = F.col("source_path"), F.col("detected_date"), naming or {}
    tag = F.get("folder_tags", F.lit(0)) if tag_names else None
    if not rename:
        if tag is None:
            return dated.withColumn("planned_name", paths.file_name(path))
        tagged = names.tagged_name(path, tag, naming.get("lowercase_ext", True))
        return dated.withColumn("planned_name", F.when(tag.isNotNull(), tagged).otherwise(paths.file_name(path)))
    base = dated.withColumn("__base", names.new_name(path, day, tag, **naming))
    wanted = base.select(path.alias("source"), F.col("__base").alias("name"))
    if "{counter}" in naming.get("pattern", ""):
        counters = collisions.name_counters(wanted).groupBy(F.col("source").alias("source_path")).agg(F.max("counter").alias("__counter"))
        return base.join(counters, "source_path", "left").withColumn("planned_name", names.new_name(path, day, tag, counter=F.col("__counter"), **naming)).drop("__base", "__counter")
    unique = collisions.unique_names(wanted).select(F.col("source").alias("source_path"), F.col("unique_name").alias("planned_name"))
    return base.join(unique, "source_path", "left").drop("__base")


def plan_operations(
    files: DataFrame, root: str, structure: str = "YYYY/MM", operation: str = "copy", rename: bool = False, tag_names: bool = False, naming: dict | None = None
) -> DataFrame:
    """Every file with its planned operation: dated ones go to their folder, undated ones are skipped with a reason. Names as in ``named``."""
    path, day = F.col("source_path"), F.col("detected_date")
    name = F.col("planned_name")
    dated = named(files.filter(day.isNotNull()), rename, tag_names, naming).select("source_path", F.lit(operation).alias("operation"), dates.full_destination(path, day, root, structure, name).alias("destination_path"), F.lit(None).cast("string").alias("reason"))
    undated = files.filter(day.isNull()).select("source_path", F.lit("skip").alias("operation"), F.lit(None).cast("string").alias("destination_path"), F.lit("No date detected").alias("reason"))
    return dated.unionByName(undated)


def export_rows(files: DataFrame) -> DataFrame:
    """The 26 export columns, values as they are."""
    path, day = F.col("source_path"), F.col("detected_date")
    made = {
        "path": path,
        "filename": paths.file_name(path),
        "extension": paths.extension(path),
        "date_taken": iso_text(day),
        "year": F.date_format(day, "yyyy"),
        "month": F.date_format(day, "MM"),
        "target_path": joined_path(F.col("destination_folder"), F.col("destination_filename"), path),
        "filename_date": iso_text(F.col("filename_date")),
        "video_metadata_date": iso_text(F.col("video_metadata_date")),
        "folder_tag": F.get("folder_tags", F.lit(0)),
        "folder_tag_reason": F.get("folder_tag_reasons", F.lit(0)),
        "folder_tag_usable": F.coalesce(F.size("folder_tags") > 0, F.lit(False)),
        "proposed_target_path": joined_path(F.col("proposed_destination_folder"), F.col("proposed_filename"), path),
    }
    return files.select(*[made.get(c, F.col(c)).alias(c) for c in COLUMNS])


def csv_rows(files: DataFrame) -> DataFrame:
    """Export rows as texts: nulls empty, lists joined by a bar, booleans as True/False, zero mismatch days empty."""
    rows = export_rows(files)
    out = []
    for field in rows.schema:
        c, kind = F.col(field.name), field.dataType.simpleString()
        if kind == "boolean":
            text = F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False")
        elif kind.startswith("array"):
            text = F.coalesce(F.array_join(c, "|"), F.lit(""))
        elif field.name == "date_mismatch_days":
            text = F.when(F.coalesce(c, F.lit(0)) == 0, "").otherwise(c.cast("string"))
        else:
            text = F.coalesce(c.cast("string"), F.lit(""))
        out.append(text.alias(field.name))
    return rows.select(*out)


def json_rows(files: DataFrame) -> DataFrame:
    """One JSON object per file, nulls written out."""
    rows = export_rows(files)
    return rows.select("path", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
