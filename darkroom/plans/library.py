"""Queries over the library tables: one per operator, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.config import Scan
from darkroom.functions import dates, names, paths, tags
from darkroom.functions.instants import staged
from darkroom.operators import collisions, discovery, duplicates, exporting, reports, verification
from darkroom.session import broadcast_if_small, table

QUERIES: dict = {}
ORACLES: dict = {}
IMAGES, VIDEOS, RAWS = (list(kind) for kind in (Scan().image_extensions, Scan().video_extensions, Scan().raw_extensions))

# --- SQL fragments for DuckDB -----------------------------------------------------------------------------------------
NAME = "regexp_extract(source_path, '([^/]*)$', 1)"
SUF = f"regexp_extract({NAME}, '^.*[^.](\\.[^.]+)$', 1)"
STEM = f"left({NAME}, length({NAME}) - length({SUF}))"
EXT = f"lower({SUF})"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _folder(level: int) -> str:
    return f"nullif(string_split(source_path, '/')[-{level + 1}], '')"


def _sql_pattern(text: str, pattern: str, kind: str) -> str:
    re2 = pattern.replace(r"(?!\d)", r"(?:\D|$)")
    part = lambda i: f"regexp_extract({text}, '{re2}', {i})"
    year = part(1)
    if kind == "yymmdd":
        year = f"CAST(CASE WHEN try_cast({part(1)} AS INT) <= 30 THEN try_cast({part(1)} AS INT) + 2000 ELSE try_cast({part(1)} AS INT) + 1900 END AS VARCHAR)"
    month = part(2) if kind != "y" else "'01'"
    day = part(3) if kind in ("ymd", "ymdhms", "yymmdd") else "'01'"
    clock = f"{part(4)} || ':' || {part(5)} || ':' || {part(6)}" if kind == "ymdhms" else "'00:00:00'"
    return f"CASE WHEN regexp_matches({text}, '{re2}') AND try_cast({year} AS INT) BETWEEN 1990 AND 2100 THEN try_cast({year} || '-' || {month} || '-' || {day} || ' ' || {clock} AS TIMESTAMP) END"


def _sql_filename_date(text: str) -> str:
    return "coalesce(" + ", ".join(_sql_pattern(text, p, k) for p, k in dates.FILENAME_PATTERNS) + ")"


def _sql_folder_date(text: str) -> str:
    return "coalesce(" + ", ".join(_sql_pattern(text, p, k) for p, k in dates.FOLDER_PATTERNS) + ")"


def _sql_classify(text: str, decision: str | None = None) -> tuple[str, str]:
    plain = f"lower(trim({text}, ' '))"
    rules = f"WHEN {decision} = 'use' THEN 'in_rules_use_list' WHEN {decision} = 'ignore' THEN 'in_rules_ignore_list'" if decision else ""
    camera = " OR ".join(f"regexp_matches({text}, '{p}')" for p in tags.CAMERA_PATTERNS)
    blanks = "\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{85}\\x0b"
    reason = f"""CASE WHEN coalesce({text}, '') = '' THEN 'empty' {rules} WHEN {plain} IN {_in(tags.IGNORED_FOLDERS)} THEN 'in_ignore_list'
      WHEN length({text}) < 3 THEN 'too_short' WHEN length({text}) > 40 THEN 'too_long' WHEN {camera} THEN 'camera_generated'
      WHEN regexp_matches(regexp_replace({text}, '[-_./{blanks}]', '', 'g'), '^[0-9]+$') THEN 'numbers_only'
      WHEN NOT regexp_matches({text}, '\\pL') THEN 'no_letters' ELSE 'meaningful' END"""
    return f"({reason}) IN ('meaningful', 'in_rules_use_list')", reason


_SPACE = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{85}\\x0b]"


def _sql_tag(text: str, length: int = 40) -> str:
    words = f"regexp_replace(regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', '_', 'g')"
    kept = f"regexp_replace(regexp_replace({words}, '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}\\-]', '', 'g'), '^[_-]+|[_-]+$', '', 'g')"
    return f"(CASE WHEN length({kept}) > {length} THEN regexp_replace(left({kept}, {length}), '[_-]+$', '') ELSE {kept} END)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_records")


def file_type(ext):
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video").when(ext.isin(*RAWS), "raw").otherwise("unknown")


_SQL_TYPE = f"CASE WHEN {EXT} IN {_in(IMAGES)} THEN 'image' WHEN {EXT} IN {_in(VIDEOS)} THEN 'video' WHEN {EXT} IN {_in(RAWS)} THEN 'raw' ELSE 'unknown' END"


# --- projections and filters ------------------------------------------------------------------------------------------
@query("q_file_type", f"SELECT {_SQL_TYPE} AS kind, {EXT} AS ext, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file_records GROUP BY ALL")
def q_file_type(spark, d):
    ext = paths.extension(F.col("source_path"))
    return files(spark, d).groupBy(file_type(ext).alias("kind"), ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query("q_supported_filter", f"SELECT file_id, source_path FROM file_records WHERE {EXT} IN {_in(IMAGES + VIDEOS + RAWS)}")
def q_supported_filter(spark, d):
    return files(spark, d).filter(paths.extension(F.col("source_path")).isin(*IMAGES, *VIDEOS, *RAWS)).select("file_id", "source_path")


@query("q_hidden_filter", "SELECT file_id FROM file_records WHERE regexp_matches('/' || source_path, '/\\.')")
def q_hidden_filter(spark, d):
    return files(spark, d).filter(paths.is_hidden(F.col("source_path"))).select("file_id")


@query("q_error_category", f"SELECT file_id, CASE WHEN detected_date IS NULL THEN CASE {_SQL_TYPE} WHEN 'video' THEN 'no_video_metadata' WHEN 'image' THEN 'no_exif_date' WHEN 'raw' THEN 'no_exif_date' ELSE 'no_date_found' END END AS category FROM file_records")
def q_error_category(spark, d):
    kind = file_type(paths.extension(F.col("source_path")))
    category = F.when(F.col("detected_date").isNull(), F.when(kind == "video", "no_video_metadata").when(kind.isin("image", "raw"), "no_exif_date").otherwise("no_date_found"))
    return files(spark, d).select("file_id", category.alias("category"))


# --- dates ------------------------------------------------------------------------------------------------------------
@query("q_filename_date", f"SELECT file_id, {NAME} AS name, {_sql_filename_date(STEM)} AS name_date FROM file_records")
def q_filename_date(spark, d):
    return files(spark, d).select("file_id", paths.file_name(F.col("source_path")).alias("name"), dates.filename_date(paths.stem(F.col("source_path"))).alias("name_date"))


@query("q_two_digit_year", "SELECT file_id, CAST(file_id % 100 AS INT) AS yy, CAST(CASE WHEN file_id % 100 <= 30 THEN 2000 + file_id % 100 ELSE 1900 + file_id % 100 END AS INT) AS year FROM file_records")
def q_two_digit_year(spark, d):
    yy = (F.col("file_id") % 100).cast("int")
    return files(spark, d).select("file_id", yy.alias("yy"), dates.expand_two_digit_year(yy).alias("year"))


@query("q_folder_date", f"SELECT source_folder_name, {_sql_folder_date('source_folder_name')} AS folder_date, count(*) AS files FROM file_records GROUP BY ALL")
def q_folder_date(spark, d):
    counted = files(spark, d).groupBy("source_folder_name").agg(F.count(F.lit(1)).alias("files"))
    return counted.select("source_folder_name", dates.folder_date(F.col("source_folder_name")).alias("folder_date"), "files")


@query("q_nearest_folder_date", f"SELECT file_id, coalesce({', '.join(_sql_folder_date(_folder(i)) for i in (1, 2, 3))}) AS folder_date FROM file_records")
def q_nearest_folder_date(spark, d):
    return files(spark, d).select("file_id", dates.nearest_folder_date(F.col("source_path")).alias("folder_date"))


_CASCADE = f"""
WITH c AS (SELECT file_id, source_path, {_SQL_TYPE} AS kind, CASE WHEN has_exif THEN detected_date END AS e, video_metadata_date AS v,
  {_sql_filename_date(STEM)} AS n, {_sql_folder_date(_folder(1))} AS f, CAST(ingested_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS m FROM file_records),
g AS (SELECT *, CASE WHEN kind <> 'video' THEN e END AS e2, CASE WHEN kind NOT IN ('image', 'raw') THEN v END AS v2 FROM c)
SELECT file_id, coalesce(n, f, e2, v2, m) AS best_date,
  CASE WHEN n IS NOT NULL THEN 'filename' WHEN f IS NOT NULL THEN 'folder_name' WHEN e2 IS NOT NULL THEN 'exif' WHEN v2 IS NOT NULL THEN 'video_metadata'
       WHEN m IS NOT NULL THEN 'filesystem_modified' ELSE 'unknown' END AS best_source FROM g"""


@query("q_date_cascade", _CASCADE)
def q_date_cascade(spark, d):
    path = F.col("source_path")
    kind = file_type(paths.extension(path))
    base = files(spark, d).select("file_id", "source_path", "video_metadata_date", F.when(F.col("has_exif"), F.col("detected_date")).alias("exif"), kind.alias("kind"), F.to_utc_timestamp(F.col("ingested_at"), F.current_timezone()).alias("mtime"))
    sources = {
        "filename": dates.filename_date(paths.stem(path)),
        "folder_name": dates.nearest_folder_date(path, 1),
        "exif": F.when(F.col("kind") != "video", F.col("exif")),
        "video_metadata": F.when(~F.col("kind").isin("image", "raw"), F.col("video_metadata_date")),
        "filesystem": F.col("mtime").cast("timestamp_ntz"),
    }
    best = dates.cascade(sources, ["filename", "folder_name", "exif", "video_metadata", "filesystem"])
    return base.select("file_id", best.alias("best")).select("file_id", F.col("best.date").alias("best_date"), F.col("best.source").alias("best_source"))


@query("q_deep_date_cascade", _CASCADE.replace(f"{_sql_folder_date(_folder(1))} AS f", f"coalesce({', '.join(_sql_folder_date(_folder(i)) for i in (1, 2, 3))}) AS f"))
def q_deep_date_cascade(spark, d):
    """The cascade with the folder date of the nearest of three levels, as a scan takes it."""
    path = F.col("source_path")
    base = files(spark, d).select("file_id", "source_path", "video_metadata_date", F.when(F.col("has_exif"), F.col("detected_date")).alias("exif"), file_type(paths.extension(path)).alias("kind"), F.to_utc_timestamp(F.col("ingested_at"), F.current_timezone()).alias("mtime"))
    base = staged(base, {"folder_date": dates.nearest_folder_date(path), "name_date": dates.filename_date(paths.stem(path))})
    sources = {
        "filename": F.col("name_date"),
        "folder_name": F.col("folder_date"),
        "exif": F.when(F.col("kind") != "video", F.col("exif")),
        "video_metadata": F.when(~F.col("kind").isin("image", "raw"), F.col("video_metadata_date")),
        "filesystem": F.col("mtime").cast("timestamp_ntz"),
    }
    best = dates.cascade(sources, list(sources))
    return base.select("file_id", best.alias("best")).select("file_id", F.col("best.date").alias("best_date"), F.col("best.source").alias("best_source"))


def _sql_formats(text: str, formats: list[str]) -> str:
    shapes = {"yyyy": "[0-9]{4}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}"}
    codes = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
    out = []
    for f in formats:
        shape, code = f, f
        for k in shapes:
            shape, code = shape.replace(k, shapes[k]), code.replace(k, codes[k])
        out.append(f"CASE WHEN regexp_matches({text}, '^{shape}$') THEN try_strptime({text}, '{code}') END")
    return ", ".join(out)


@query("q_exif_date_parse", f"SELECT detected_date AS value, coalesce({_sql_formats('trim(detected_date, chr(32))', dates.EXIF_FORMATS)}) AS parsed, count(*) AS readings FROM date_readings GROUP BY ALL")
def q_exif_date_parse(spark, d):
    counted = table(spark, d, "date_readings").groupBy(F.col("detected_date").alias("value")).agg(F.count(F.lit(1)).alias("readings"))
    return counted.select("value", dates.exif_date(F.col("value")).alias("parsed"), "readings")


_ISO = "^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]{1,6})?)(?:Z|[+-][0-9]{2}:?[0-9]{2})$"


@query("q_video_date_parse", f"""SELECT value, coalesce(CASE WHEN regexp_matches(t, '{_ISO}') THEN try_cast(regexp_extract(t, '{_ISO}', 1) || ' ' || regexp_extract(t, '{_ISO}', 2) AS TIMESTAMP) END,
  {_sql_formats('t', dates.VIDEO_FORMATS)}) AS parsed, count(*) AS readings FROM (SELECT video_metadata_date AS value, trim(video_metadata_date, chr(32)) AS t FROM date_readings) GROUP BY ALL""")
def q_video_date_parse(spark, d):
    counted = table(spark, d, "date_readings").groupBy(F.col("video_metadata_date").alias("value")).agg(F.count(F.lit(1)).alias("readings"))
    return counted.select("value", dates.video_date(F.col("value")).alias("parsed"), "readings")


@query("q_date_mismatch", "SELECT file_id, CAST(abs(floor(date_diff('microsecond', filename_date, detected_date) / 86400000000.0)) AS INT) AS days FROM file_records WHERE filename_date IS NOT NULL AND detected_date IS NOT NULL")
def q_date_mismatch(spark, d):
    return files(spark, d).filter("filename_date is not null and detected_date is not null").select("file_id", dates.mismatch_days(F.col("detected_date"), F.col("filename_date")).alias("days"))


@query("q_destination_folder", "SELECT file_id, strftime(detected_date, '%Y') AS by_year, strftime(detected_date, '%Y/%m') AS by_month, strftime(detected_date, '%Y/%m/%d') AS by_day FROM file_records")
def q_destination_folder(spark, d):
    day = F.col("detected_date")
    return files(spark, d).select("file_id", *[dates.destination_folder(day, s).alias(a) for s, a in (("YYYY", "by_year"), ("YYYY/MM", "by_month"), ("YYYY/MM/DD", "by_day"))])


@query("q_full_destination", f"SELECT file_id, '/sorted/' || strftime(detected_date, '%Y/%m') || '/' || {NAME} AS destination FROM file_records")
def q_full_destination(spark, d):
    return files(spark, d).select("file_id", dates.full_destination(F.col("source_path"), F.col("detected_date"), "/sorted").alias("destination"))


# --- tags and names ---------------------------------------------------------------------------------------------------
_USABLE, _REASON = _sql_classify("source_folder_name")


@query("q_classify_folder", f"SELECT source_folder_name, {_USABLE} AS usable, {_REASON} AS reason, count(*) AS files FROM file_records GROUP BY ALL")
def q_classify_folder(spark, d):
    counted = files(spark, d).groupBy("source_folder_name").agg(F.count(F.lit(1)).alias("files"))
    verdict = tags.classify_folder(F.col("source_folder_name"))
    return counted.select("source_folder_name", verdict["usable"].alias("usable"), verdict["reason"].alias("reason"), "files")


_RUSABLE, _RREASON = _sql_classify("f.source_folder_name", "r.decision")


@query("q_tag_rules", f"""WITH f AS (SELECT source_folder_name, count(*) AS files FROM file_records GROUP BY ALL), r AS (SELECT folder_name, min(decision) AS decision, min(alias) AS alias FROM tag_rules GROUP BY folder_name)
SELECT f.source_folder_name, {_RUSABLE} AS usable, {_RREASON} AS reason, CASE WHEN {_RUSABLE} THEN coalesce(r.alias, {_sql_tag('f.source_folder_name')}) END AS tag, f.files FROM f LEFT JOIN r ON r.folder_name = f.source_folder_name""")
def q_tag_rules(spark, d):
    rules = table(spark, d, "tag_rules").groupBy("folder_name").agg(F.min("decision").alias("decision"), F.min("alias").alias("alias"))
    counted = files(spark, d).groupBy("source_folder_name").agg(F.count(F.lit(1)).alias("files"))
    joined = counted.join(broadcast_if_small(rules), counted["source_folder_name"] == rules["folder_name"], "left")
    verdict = tags.classify_folder(F.col("source_folder_name"), decision=F.col("decision"))
    tag = F.when(verdict["usable"], tags.format_tag(F.col("source_folder_name"), alias=F.col("alias")))
    return joined.select("source_folder_name", verdict["usable"].alias("usable"), verdict["reason"].alias("reason"), tag.alias("tag"), "files")


@query("q_format_tag", f"SELECT source_folder_name, {_sql_tag('source_folder_name')} AS tag, {_sql_tag('source_folder_name', 30)} AS name_tag FROM file_records WHERE source_folder_name IS NOT NULL GROUP BY ALL")
def q_format_tag(spark, d):
    folder = F.col("source_folder_name")
    return files(spark, d).filter(folder.isNotNull()).select("source_folder_name").distinct().select("source_folder_name", tags.format_tag(folder).alias("tag"), tags.format_tag(folder, 30).alias("name_tag"))


def _sql_nearest_tag() -> str:
    out = []
    for level in (1, 2, 3):
        usable, _ = _sql_classify(_folder(level))
        out.append(f"CASE WHEN {usable} THEN {_sql_tag(_folder(level))} END")
    return "coalesce(" + ", ".join(out) + ")"


@query("q_nearest_tag", f"SELECT file_id, {_sql_nearest_tag()} AS tag FROM file_records")
def q_nearest_tag(spark, d):
    return files(spark, d).select("file_id", tags.nearest_tag(F.col("source_path")).alias("tag"))


@query("q_tag_in_filename")
def q_tag_in_filename(spark, d):
    pairs = files(spark, d).select(paths.file_name(F.col("source_path")).alias("name"), tags.format_tag(F.col("source_folder_name")).alias("tag")).distinct()
    return pairs.select("name", "tag", tags.tag_in_name(F.col("name"), F.col("tag")).alias("present"))


@query("q_should_add_tag")
def q_should_add_tag(spark, d):
    pairs = files(spark, d).select("source_path", paths.file_name(F.col("source_path")).alias("name"), tags.nearest_tag(F.col("source_path")).alias("tag")).distinct()
    return pairs.select("source_path", "tag", (F.col("tag").isNotNull() & ~tags.tag_in_name(F.col("name"), F.col("tag"))).alias("add"))


_DATED = "strftime(detected_date, '%Y%m%d_%H%M%S')"
_NTAG = _sql_tag("source_folder_name", 30)
_SQUEEZE = "regexp_replace(regexp_replace({}, '_+', '_', 'g'), '^_|_$', '', 'g')"
_RENAMED = f"{_SQUEEZE.format(_DATED)} || {EXT}"
_RENAMED_TAG = _SQUEEZE.format(f"({_DATED} || CASE WHEN coalesce(source_folder_name, '') <> '' THEN '_' || {_NTAG} ELSE '' END)") + f" || {EXT}"


@query("q_rename", f"SELECT file_id, {_RENAMED} AS plain, {_RENAMED_TAG} AS tagged, {_SQUEEZE.format(_DATED + chr(32) + '||' + chr(32) + chr(39) + '_007' + chr(39))} || {EXT} AS counted FROM file_records")
def q_rename(spark, d):
    path, day = F.col("source_path"), F.col("detected_date")
    return files(spark, d).select("file_id", names.new_name(path, day).alias("plain"), names.new_name(path, day, F.col("source_folder_name")).alias("tagged"), names.new_name(path, day, counter=F.lit(7)).alias("counted"))


@query("q_tag_only_name", f"SELECT file_id, {_SQUEEZE.format('(' + STEM + chr(32) + '||' + chr(32) + chr(39) + '_' + chr(39) + chr(32) + '||' + chr(32) + _NTAG + ')')} || {EXT} AS name FROM file_records WHERE source_folder_name IS NOT NULL")
def q_tag_only_name(spark, d):
    return files(spark, d).filter("source_folder_name is not null").select("file_id", names.tagged_name(F.col("source_path"), F.col("source_folder_name")).alias("name"))


@query("q_needs_rename", f"SELECT file_id, lower({NAME}) <> lower({_RENAMED}) AS needed FROM file_records")
def q_needs_rename(spark, d):
    return files(spark, d).select("file_id", names.needs_rename(F.col("source_path"), names.new_name(F.col("source_path"), F.col("detected_date"))).alias("needed"))


@query("q_human_size", """SELECT scan_id, bytes, CASE WHEN bytes < 1024 THEN printf('%.2f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024.0) WHEN bytes < 1073741824 THEN printf('%.2f MB', bytes / 1048576.0)
  WHEN bytes < 1099511627776 THEN printf('%.2f GB', bytes / 1073741824.0) ELSE printf('%.2f TB', bytes / 1099511627776.0) END AS size_text,
  CASE WHEN bytes < 1024 THEN printf('%.1f B', -bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', -bytes / 1024.0) WHEN bytes < 1073741824 THEN printf('%.1f MB', -bytes / 1048576.0)
  WHEN bytes < 1099511627776 THEN printf('%.1f GB', -bytes / 1073741824.0) ELSE printf('%.1f TB', -bytes / 1099511627776.0) END AS freed_text
FROM (SELECT scan_id, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file_records GROUP BY scan_id)""")
def q_human_size(spark, d):
    sums = files(spark, d).groupBy("scan_id").agg(F.sum("size_bytes").alias("bytes"))
    return sums.select("scan_id", "bytes", names.human_size(F.col("bytes")).alias("size_text"), names.signed_size(-F.col("bytes")).alias("freed_text"))


@query("q_clipped_name", f"SELECT file_id, CASE WHEN length({NAME}) > 37 THEN left({NAME}, 34) || '...' ELSE {NAME} END AS shown FROM file_records")
def q_clipped_name(spark, d):
    return files(spark, d).select("file_id", names.clipped(paths.file_name(F.col("source_path"))).alias("shown"))


# --- content, duplicates, collisions ----------------------------------------------------------------------------------
@query("q_content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def q_content_hash(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


_ONE = "SELECT DISTINCT file_hash, source_path AS path FROM file_records WHERE file_hash IS NOT NULL AND source_path IS NOT NULL"


@query("q_duplicate_groups", f"SELECT file_hash, count(*) AS copies, min(path) AS first_path FROM ({_ONE}) GROUP BY file_hash HAVING count(*) > 1")
def q_duplicate_groups(spark, d):
    return duplicates.duplicate_groups(files(spark, d))


@query("q_duplicate_members", f"WITH o AS ({_ONE}), g AS (SELECT file_hash, min(path) AS first_path FROM o GROUP BY file_hash HAVING count(*) > 1) SELECT path, file_hash, first_path FROM o JOIN g USING (file_hash)")
def q_duplicate_members(spark, d):
    return duplicates.duplicate_members(files(spark, d))


@query("q_same_content", """WITH l AS (SELECT DISTINCT source_path AS path, size_bytes, file_hash FROM file_records WHERE source_path IS NOT NULL)
SELECT a.path, a.size_bytes, a.file_hash, min(b.path) AS match FROM l a JOIN l b ON a.size_bytes = b.size_bytes AND a.file_hash = b.file_hash AND a.path <> b.path GROUP BY ALL""")
def q_same_content(spark, d):
    listing = files(spark, d).filter("source_path is not null").select(F.col("source_path").alias("path"), "size_bytes", "file_hash").distinct()
    return duplicates.same_content(listing, listing).select("path", "size_bytes", "file_hash", "match")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    dest = F.concat(F.lit("/sorted/"), F.col("library_id").cast("string"), F.lit("/"), dates.destination_folder(F.col("detected_date")), F.lit("/"), names.new_name(F.col("source_path"), F.col("detected_date"), date_format="%Y%m%d", time_format="%H"))
    return files(spark, d).filter("detected_date is not null and source_path is not null").select(F.col("source_path").alias("source"), dest.alias("destination"), "file_hash").filter("destination is not null")


_SQL_PLAN = f"""plan AS (SELECT source_path AS source, '/sorted/' || library_id || '/' || strftime(detected_date, '%Y/%m') || '/' || strftime(detected_date, '%Y%m%d_%H') || {EXT} AS destination, min(file_hash) AS file_hash
  FROM file_records WHERE detected_date IS NOT NULL AND source_path IS NOT NULL AND library_id IS NOT NULL GROUP BY 1, 2)"""


@query("q_conflict_pairs", f"WITH {_SQL_PLAN} SELECT source, destination, first_source FROM (SELECT source, destination, min(source) OVER (PARTITION BY destination) AS first_source FROM plan) WHERE source <> first_source")
def q_conflict_pairs(spark, d):
    return collisions.conflicts(_plan(spark, d).groupBy("source", "destination").agg(F.min("file_hash").alias("file_hash")))


@query("q_collisions", f"""WITH {_SQL_PLAN}, h AS (SELECT *, first_value(source) OVER w AS fs, first_value(file_hash) OVER w AS fh FROM plan WINDOW w AS (PARTITION BY destination ORDER BY source)),
o AS (SELECT *, CASE WHEN source = fs THEN 'copy' WHEN file_hash = fh THEN 'duplicate in batch' ELSE 'renamed' END AS outcome FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY destination, outcome ORDER BY source) AS n FROM o)
SELECT source, destination, outcome, CASE outcome WHEN 'copy' THEN destination WHEN 'renamed' THEN regexp_replace(destination, '(\\.[^./]+)?$', '') || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') || regexp_extract(destination, '(\\.[^./]+)$', 1) END AS final_destination FROM r""")
def q_collisions(spark, d):
    return collisions.resolve_collisions(_plan(spark, d))


@query("q_collisions_exact")
def q_collisions_exact(spark, d):
    plan = files(spark, d).filter("detected_date is not null").select(
        F.col("source_path").alias("source"),
        F.concat(F.lit("/sorted/"), dates.destination_folder(F.col("detected_date"), "YYYY"), F.lit("/"), F.regexp_replace(paths.file_name(F.col("source_path")), r"\d(\d{3})(\.[^.]+)?$", "_$1$2")).alias("destination"),
        "file_hash",
    )
    return collisions.resolve_collisions(plan)


_POLICIES = ("check_hash", "rename", "skip")
_SQL_YEARS = f"""plan AS (SELECT source_path AS source, '/all/' || strftime(detected_date, '%Y') || {EXT} AS destination, min(file_hash) AS file_hash FROM file_records WHERE detected_date IS NOT NULL AND source_path IS NOT NULL GROUP BY 1, 2),
disk AS (SELECT '/all/' || strftime(filename_date, '%Y') || {EXT} AS destination, min(file_hash) AS disk_hash FROM file_records WHERE filename_date IS NOT NULL AND date_mismatch GROUP BY 1)"""


@query("q_collision_policies", f"""WITH {_SQL_YEARS}, h AS (SELECT p.*, d.destination IS NOT NULL AS there, d.disk_hash, first_value(source) OVER w AS fs, first_value(file_hash) OVER w AS fh FROM plan p LEFT JOIN disk d USING (destination) WINDOW w AS (PARTITION BY destination ORDER BY source)),
o AS (SELECT *, CASE WHEN NOT there AND source = fs THEN 'copy' WHEN policy = 'skip' THEN 'collision skipped' WHEN policy = 'check_hash' AND there AND file_hash = disk_hash THEN 'duplicate of existing file'
  WHEN policy = 'check_hash' AND NOT there AND file_hash = fh THEN 'duplicate in batch' ELSE 'renamed' END AS outcome FROM h, (SELECT unnest(['check_hash', 'rename', 'skip']) AS policy)),
r AS (SELECT *, row_number() OVER (PARTITION BY policy, destination, outcome ORDER BY source) AS n FROM o)
SELECT policy, source, outcome, CASE outcome WHEN 'copy' THEN destination WHEN 'renamed' THEN regexp_replace(destination, '(\\.[^./]+)?$', '') || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') || regexp_extract(destination, '(\\.[^./]+)$', 1) END AS final_destination FROM r""")
def q_collision_policies(spark, d):
    """Few destinations that a large share of all files want, some of them on disk already, under each policy."""
    year = lambda day: F.concat(F.lit("/all/"), F.date_format(day, "yyyy"), paths.extension(F.col("source_path")))
    plan = files(spark, d).filter("detected_date is not null and source_path is not null").select(F.col("source_path").alias("source"), year("detected_date").alias("destination"), "file_hash")
    disk = files(spark, d).filter("filename_date is not null and date_mismatch").select(year("filename_date").alias("destination"), "file_hash")
    out = None
    for policy in _POLICIES:
        one = collisions.resolve_collisions(plan, disk, policy).select(F.lit(policy).alias("policy"), "source", "outcome", "final_destination")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_conflict_counter", f"""WITH n AS (SELECT DISTINCT source_path AS source, {_RENAMED} AS name FROM file_records WHERE source_path IS NOT NULL AND detected_date IS NOT NULL),
r AS (SELECT source, name, row_number() OVER (PARTITION BY lower(name) ORDER BY source, name) AS k FROM n) SELECT source, name, CASE WHEN k > 1 THEN k - 1 END AS counter FROM r""")
def q_conflict_counter(spark, d):
    wanted = files(spark, d).filter("detected_date is not null").select(F.col("source_path").alias("source"), names.new_name(F.col("source_path"), F.col("detected_date")).alias("name"))
    return collisions.name_counters(wanted)


# --- verification and cleanup -----------------------------------------------------------------------------------------
def _listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sources = files(spark, d).select(F.col("source_path").alias("path"), "size_bytes", "file_hash")
    checked = table(spark, d, "verify_entries")
    there = checked.filter("actual_destination_path is not null").select(F.col("actual_destination_path").alias("path"), F.length("destination_hash").cast("bigint").alias("size_bytes"), F.col("destination_hash").alias("file_hash"))
    return sources, there


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return discovery.run_entries(table(spark, d, "apply_runs"))


_SQL_VERIFY = """e AS (SELECT run_id, x.source_path, x.destination_path, x.operation FROM (SELECT run_id, unnest(entries) AS x FROM apply_runs)),
s AS (SELECT source_path AS path, min(size_bytes) AS z, min(file_hash) AS h FROM file_records WHERE source_path IS NOT NULL GROUP BY 1),
t AS (SELECT actual_destination_path AS path, min(length(destination_hash)) AS z, min(destination_hash) AS h FROM verify_entries WHERE actual_destination_path IS NOT NULL GROUP BY 1),
v AS (SELECT e.run_id, e.source_path, e.destination_path, CASE WHEN s.path IS NULL THEN 'missing_source' WHEN t.path IS NULL THEN 'missing_destination'
   WHEN s.h IS NULL OR t.h IS NULL THEN 'error' WHEN s.h = t.h THEN 'ok' ELSE 'mismatch' END AS status, s.h AS source_hash, t.h AS destination_hash,
   CASE WHEN s.path IS NULL THEN 'missing_source' WHEN t.path IS NULL THEN 'missing_destination' WHEN s.z = t.z THEN 'ok' ELSE 'mismatch' END AS quick
   FROM e LEFT JOIN s ON s.path = e.source_path LEFT JOIN t ON t.path = e.destination_path WHERE e.operation = 'copy'
 UNION ALL SELECT run_id, source_path, destination_path, 'missing_source', NULL, NULL, 'missing_source' FROM e WHERE operation = 'move')"""


@query("q_verify_status", f"WITH {_SQL_VERIFY} SELECT run_id, source_path, destination_path, status, source_hash, destination_hash FROM v")
def q_verify_status(spark, d):
    return verification.verify(_entries(spark, d).select("run_id", "source_path", "destination_path", "operation"), *_listings(spark, d))


@query("q_quick_verify", f"WITH {_SQL_VERIFY} SELECT run_id, quick AS status, count(*) AS entries FROM v GROUP BY ALL")
def q_quick_verify(spark, d):
    return verification.verify(_entries(spark, d).select("run_id", "source_path", "destination_path", "operation"), *_listings(spark, d), "quick").groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("entries"))


_SIZED = """z AS (SELECT file_hash, min(size_bytes) AS size_bytes FROM file_records WHERE file_hash IS NOT NULL GROUP BY 1),
t AS (SELECT actual_destination_path AS path, min(z.size_bytes) AS size_bytes, min(destination_hash) AS file_hash FROM verify_entries LEFT JOIN z ON z.file_hash = destination_hash WHERE actual_destination_path IS NOT NULL GROUP BY 1)"""


def _sized_destinations(spark: SparkSession, d: str) -> DataFrame:
    """The verified destinations with the size of the file whose content they have."""
    sizes = files(spark, d).filter("file_hash is not null").groupBy("file_hash").agg(F.min("size_bytes").alias("size_bytes"))
    there = table(spark, d, "verify_entries").filter("actual_destination_path is not null").select(F.col("actual_destination_path").alias("path"), F.col("destination_hash").alias("file_hash"))
    return there.join(sizes, "file_hash", "left").groupBy("path").agg(F.min("size_bytes").alias("size_bytes"), F.min("file_hash").alias("file_hash"))


@query("q_sizes_verify", f"""WITH {_SIZED}, e AS (SELECT DISTINCT source_path, expected_destination_path AS destination_path FROM verify_entries), s AS (SELECT source_path AS path, min(size_bytes) AS size_bytes FROM file_records WHERE source_path IS NOT NULL GROUP BY 1)
SELECT e.source_path, e.destination_path, CASE WHEN s.path IS NULL THEN 'missing_source' WHEN t.path IS NULL THEN 'missing_destination' WHEN s.size_bytes = t.size_bytes THEN 'ok' ELSE 'mismatch' END AS status
FROM e LEFT JOIN s ON s.path = e.source_path LEFT JOIN t ON t.path = e.destination_path""")
def q_sizes_verify(spark, d):
    """Quick verification of every expected copy by sizes."""
    entries = table(spark, d, "verify_entries").select("source_path", F.col("expected_destination_path").alias("destination_path"), F.lit("copy").alias("operation")).distinct()
    return verification.verify(entries, _listings(spark, d)[0], _sized_destinations(spark, d), "quick").select("source_path", "destination_path", "status")


_EXT_OF = "lower(regexp_extract({}, '[^./](\\.[^./]+)$', 1))"


@query("q_found_by_content", f"""WITH {_SIZED}, f AS (SELECT DISTINCT source_path AS path, {_EXT_OF.format('source_path')} AS ext, size_bytes, file_hash FROM file_records WHERE source_path IS NOT NULL)
SELECT f.path, min(t.path) AS match, CASE WHEN min(t.path) IS NULL THEN 'missing_destination' ELSE 'ok_existing_duplicate' END AS status FROM f LEFT JOIN t ON f.ext = {_EXT_OF.format('t.path')} AND f.size_bytes = t.size_bytes AND f.file_hash = t.file_hash AND f.path <> t.path
GROUP BY f.path, f.size_bytes, f.file_hash""")
def q_found_by_content(spark, d):
    """Every file looked for by content among the verified destinations."""
    listing = files(spark, d).filter("source_path is not null").select(F.col("source_path").alias("path"), "size_bytes", "file_hash").distinct()
    return verification.search_content(listing, _sized_destinations(spark, d))


@query("q_same_content_elsewhere", f"""WITH {_SIZED}, f AS (SELECT DISTINCT source_path AS path, size_bytes, file_hash FROM file_records WHERE source_path IS NOT NULL)
SELECT f.path, f.size_bytes, f.file_hash, min(t.path) AS match FROM f JOIN t ON f.size_bytes = t.size_bytes AND f.file_hash = t.file_hash AND f.path <> t.path GROUP BY ALL""")
def q_same_content_elsewhere(spark, d):
    listing = files(spark, d).filter("source_path is not null").select(F.col("source_path").alias("path"), "size_bytes", "file_hash").distinct()
    return duplicates.same_content(listing, _sized_destinations(spark, d)).select("path", "size_bytes", "file_hash", "match")


_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in verification.STATUSES)


@query("q_verify_summary", f"SELECT verify_id, {_COUNTS} FROM verify_entries GROUP BY verify_id")
def q_verify_summary(spark, d):
    return verification.status_counts(table(spark, d, "verify_entries"), ["verify_id"])


@query("q_content_search", """WITH f AS (SELECT DISTINCT source_path AS path, lower(regexp_extract(source_path, '[^./](\\.[^./]+)$', 1)) AS ext, size_bytes, file_hash FROM file_records WHERE source_path IS NOT NULL)
SELECT a.path, min(b.path) AS match, CASE WHEN min(b.path) IS NULL THEN 'missing_destination' ELSE 'ok_existing_duplicate' END AS status FROM f a LEFT JOIN f b ON a.ext = b.ext AND a.size_bytes = b.size_bytes AND a.file_hash = b.file_hash AND a.path <> b.path GROUP BY a.path, a.size_bytes, a.file_hash""")
def q_content_search(spark, d):
    listing = files(spark, d).filter("source_path is not null").select(F.col("source_path").alias("path"), "size_bytes", "file_hash").distinct()
    return verification.search_content(listing, listing)


@query("q_collision_probe", """SELECT e.run_id, e.destination_path, t.path IS NOT NULL AS taken, coalesce(s.h = t.h, false) AS same FROM (SELECT DISTINCT run_id, x.source_path, x.destination_path FROM (SELECT run_id, unnest(entries) AS x FROM apply_runs)) e
LEFT JOIN (SELECT source_path AS path, min(file_hash) AS h FROM file_records WHERE source_path IS NOT NULL GROUP BY 1) s ON s.path = e.source_path LEFT JOIN (SELECT actual_destination_path AS path, min(destination_hash) AS h FROM verify_entries WHERE actual_destination_path IS NOT NULL GROUP BY 1) t ON t.path = e.destination_path
WHERE e.destination_path IS NOT NULL""")
def q_collision_probe(spark, d):
    sources, there = _listings(spark, d)
    wanted = _entries(spark, d).select("run_id", "source_path", "destination_path").distinct().filter("destination_path is not null")
    s = sources.filter("path is not null").groupBy(F.col("path").alias("source_path")).agg(F.min("file_hash").alias("sh"))
    t = there.groupBy(F.col("path").alias("destination_path")).agg(F.min("file_hash").alias("th"), F.lit(True).alias("found"))
    joined = wanted.join(s, "source_path", "left").join(t, "destination_path", "left")
    return joined.select("run_id", "destination_path", F.coalesce("found", F.lit(False)).alias("taken"), F.coalesce(F.col("sh") == F.col("th"), F.lit(False)).alias("same"))


@query("q_hash_matches_any", "SELECT DISTINCT file_id FROM file_records WHERE file_hash IN (SELECT destination_hash FROM verify_entries WHERE destination_hash IS NOT NULL)")
def q_hash_matches_any(spark, d):
    wanted = table(spark, d, "verify_entries").select(F.col("destination_hash").alias("file_hash")).filter("file_hash is not null").distinct()
    return files(spark, d).join(wanted, "file_hash", "left_semi").select("file_id").distinct()


_ELIGIBLE = "SELECT * FROM verify_entries WHERE status IN ('ok', 'ok_existing_duplicate') AND hash_algorithm = 'sha256'"


@query("q_cleanup_eligible", f"WITH c AS ({_ELIGIBLE}) SELECT entry_id, source_path, status FROM c WHERE source_path IN (SELECT source_path FROM file_records WHERE source_path IS NOT NULL) AND (coalesce(actual_destination_path, expected_destination_path) IS NULL OR coalesce(actual_destination_path, expected_destination_path) IN (SELECT actual_destination_path FROM verify_entries WHERE actual_destination_path IS NOT NULL))")
def q_cleanup_eligible(spark, d):
    return verification.still_there(verification.cleanup_eligible(table(spark, d, "verify_entries")), *_listings(spark, d)).select("entry_id", "source_path", "status")


@query("q_cleanup_totals", f"""WITH c AS ({_ELIGIBLE}), p AS (SELECT DISTINCT source_path FROM c), z AS (SELECT source_path, max(size_bytes) AS z FROM file_records GROUP BY 1)
SELECT count(*) AS candidates, count(z.z) AS deletable, CAST(coalesce(sum(z.z), 0) AS BIGINT) AS bytes_freed, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(z.z) * 10000.0 / count(*)) END AS BIGINT) AS success_basis_points FROM p LEFT JOIN z USING (source_path)""")
def q_cleanup_totals(spark, d):
    wanted = verification.cleanup_eligible(table(spark, d, "verify_entries")).select("source_path").distinct()
    sizes = files(spark, d).groupBy("source_path").agg(F.max("size_bytes").alias("z"))
    n, done = F.count(F.lit(1)), F.count("z")
    rate = F.when(n == 0, F.lit(0)).otherwise(F.floor(done * 10000.0 / n)).cast("bigint")
    return wanted.join(sizes, "source_path", "left").agg(n.alias("candidates"), done.alias("deletable"), F.coalesce(F.sum("z"), F.lit(0)).alias("bytes_freed"), rate.alias("success_basis_points"))


# --- reports ----------------------------------------------------------------------------------------------------------
@query("q_scan_summary", """SELECT scan_id, count(*) AS files, count(detected_date) AS dated, count(*) - count(detected_date) AS undated, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE date_mismatch) AS mismatches,
 count(*) FILTER (WHERE is_duplicate) AS duplicates, count(error_category) AS with_errors FROM file_records GROUP BY scan_id""")
def q_scan_summary(spark, d):
    return reports.file_measures(files(spark, d), ["scan_id"])


@query("q_statistics", """SELECT count(*) AS files, count(detected_date) AS dated, count(*) - count(detected_date) AS undated, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE date_mismatch) AS mismatches,
 count(*) FILTER (WHERE is_duplicate) AS duplicates, count(error_category) AS with_errors FROM file_records""")
def q_statistics(spark, d):
    return reports.file_measures(files(spark, d))


@query("q_by_source", "SELECT date_source AS value, count(*) AS files FROM file_records WHERE detected_date IS NOT NULL GROUP BY 1")
def q_by_source(spark, d):
    return reports.count_by(files(spark, d).filter("detected_date is not null"), F.col("date_source"))


@query("q_by_year", "SELECT strftime(detected_date, '%Y') AS value, count(*) AS files FROM file_records WHERE detected_date IS NOT NULL GROUP BY 1")
def q_by_year(spark, d):
    return reports.count_by(files(spark, d).filter("detected_date is not null"), F.date_format("detected_date", "yyyy"))


@query("q_by_extension", f"SELECT coalesce(nullif({EXT}, ''), 'no_extension') AS value, count(*) AS files FROM file_records GROUP BY 1")
def q_by_extension(spark, d):
    return reports.count_by(files(spark, d), F.coalesce(F.nullif(paths.extension(F.col("source_path")), F.lit("")), F.lit("no_extension")))


@query("q_year_extension", f"SELECT strftime(detected_date, '%Y') AS year, coalesce(nullif({EXT}, ''), 'no_extension') AS ext, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file_records GROUP BY 1, 2")
def q_year_extension(spark, d):
    ext = F.coalesce(F.nullif(paths.extension(F.col("source_path")), F.lit("")), F.lit("no_extension"))
    return files(spark, d).groupBy(F.date_format("detected_date", "yyyy").alias("year"), ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query("q_error_categories", "SELECT category AS value, count(*) AS files FROM (SELECT CASE WHEN error_category IS NOT NULL THEN error_category WHEN detected_date IS NULL THEN 'no_date_found' END AS category FROM file_records UNION ALL SELECT 'date_mismatch' FROM file_records WHERE date_mismatch) WHERE category IS NOT NULL GROUP BY 1")
def q_error_categories(spark, d):
    return reports.error_categories(files(spark, d))


@query("q_detected_tags", "SELECT scan_id, array_to_string(list_sort(list(DISTINCT tag)), chr(31)) AS tags FROM (SELECT scan_id, unnest(folder_tags) AS tag FROM file_records) WHERE tag IS NOT NULL AND tag <> '' GROUP BY scan_id")
def q_detected_tags(spark, d):
    return reports.detected_tags(files(spark, d)).select("scan_id", F.array_join("tags", "\x1f").alias("tags"))


@query("q_tag_listing", """WITH t AS (SELECT DISTINCT tag, source_path FROM (SELECT unnest(folder_tags) AS tag, source_path FROM file_records) WHERE tag IS NOT NULL AND tag <> '' AND source_path IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY source_path) AS n FROM t) SELECT tag, count(*) AS files, array_to_string(list(source_path ORDER BY source_path) FILTER (WHERE n <= 3), chr(31)) AS samples FROM r GROUP BY tag""")
def q_tag_listing(spark, d):
    return reports.listing_with_samples(files(spark, d).select(F.explode("folder_tags").alias("tag"), "source_path").filter("tag <> ''"), "tag", 3).select("tag", "files", F.array_join("samples", "\x1f").alias("samples"))


@query("q_ignored_listing", f"""WITH t AS (SELECT DISTINCT source_folder_name AS folder, {_REASON} AS reason, source_path FROM file_records WHERE NOT ({_USABLE}) AND source_folder_name IS NOT NULL AND source_path IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY source_path) AS n FROM t) SELECT folder, reason, count(*) AS files, array_to_string(list(source_path ORDER BY source_path) FILTER (WHERE n <= 3), chr(31)) AS samples FROM r GROUP BY folder, reason""")
def q_ignored_listing(spark, d):
    folders = files(spark, d).select(F.col("source_folder_name").alias("folder"), "source_path").filter("folder is not null")
    listed = reports.listing_with_samples(folders.filter(~tags.classify_folder(F.col("folder"))["usable"]), "folder", 3)
    return listed.select("folder", tags.classify_folder(F.col("folder"))["reason"].alias("reason"), "files", F.array_join("samples", "\x1f").alias("samples"))


@query("q_scan_success", "SELECT scan_id, max(CASE WHEN total_files > 0 THEN CAST(floor(processed_files * 10000.0 / total_files) AS BIGINT) ELSE 0 END) AS success_basis_points FROM scan_results GROUP BY scan_id")
def q_scan_success(spark, d):
    rate = F.when(F.col("total_files") > 0, F.floor(F.col("processed_files") * 10000.0 / F.col("total_files"))).otherwise(F.lit(0)).cast("bigint")
    return table(spark, d, "scan_results").groupBy("scan_id").agg(F.max(rate).alias("success_basis_points"))


@query("q_scan_error_map", "SELECT key AS category, CAST(sum(value) AS BIGINT) AS errors FROM (SELECT unnest(map_entries(errors_by_category), recursive := true) FROM scan_results) GROUP BY 1")
def q_scan_error_map(spark, d):
    return table(spark, d, "scan_results").select(F.explode("errors_by_category").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("errors"))


# --- runs -------------------------------------------------------------------------------------------------------------
@query("q_run_discovery", "SELECT run_id, created_at, source_root, destination_root, mode, CASE mode WHEN 'dry_run' THEN 'dry-run' WHEN 'live_copy' THEN 'copy' WHEN 'live_move' THEN 'move' ELSE mode END AS mode_text FROM apply_runs WHERE coalesce(mode, 'dry_run') <> 'dry_run' AND starts_with(source_root, '/vault') ORDER BY created_at DESC NULLS LAST, run_id DESC LIMIT 20")
def q_run_discovery(spark, d):
    return discovery.discover_runs(table(spark, d, "apply_runs"), source_prefix="/vault")


@query("q_verification_discovery", """SELECT verify_id, min(run_id) AS run_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'ok_existing_duplicate') AS duplicates, count(*) FILTER (WHERE status = 'mismatch') AS mismatches,
 count(*) FILTER (WHERE status IN ('missing_destination', 'missing_source')) AS missing, count(*) AS total FROM verify_entries GROUP BY verify_id ORDER BY verify_id DESC LIMIT 20""")
def q_verification_discovery(spark, d):
    return discovery.discover_verifications(table(spark, d, "verify_entries"))


@query("q_run_lookup", "SELECT run_id, mode, source_root FROM apply_runs WHERE run_id = (SELECT max(run_id) FROM apply_runs)")
def q_run_lookup(spark, d):
    return discovery.latest_run(table(spark, d, "apply_runs")).select("run_id", "mode", "source_root")


@query("q_run_summary", """SELECT run_id, count(*) AS total_files, count(*) FILTER (WHERE operation = 'copy') AS copied_files, count(*) FILTER (WHERE operation = 'move') AS moved_files, count(*) FILTER (WHERE operation = 'skip') AS skipped_files
FROM (SELECT run_id, e.operation FROM (SELECT run_id, unnest(entries) AS e FROM apply_runs)) GROUP BY run_id""")
def q_run_summary(spark, d):
    return discovery.run_summary(_entries(spark, d))


@query("q_verifiable_entries", "SELECT run_id, e.source_path, e.destination_path, e.operation FROM (SELECT run_id, unnest(entries) AS e FROM apply_runs) WHERE e.operation IN ('copy', 'move') AND e.destination_path IS NOT NULL")
def q_verifiable_entries(spark, d):
    return _entries(spark, d).filter("operation in ('copy', 'move') and destination_path is not null").select("run_id", "source_path", "destination_path", "operation")


@query("q_run_file_name", "SELECT run_id, run_id || CASE WHEN mode = 'dry_run' THEN '_apply_dryrun.json' ELSE '_apply.json' END AS file_name FROM apply_runs")
def q_run_file_name(spark, d):
    return table(spark, d, "apply_runs").select("run_id", discovery.run_file_name(F.col("run_id"), F.col("mode")).alias("file_name"))


@query("q_scan_age", """SELECT scan_id, CASE WHEN s >= 86400 THEN CAST(floor(s / 86400.0) AS BIGINT) || ' day(s) ago' WHEN s >= 3600 THEN CAST(floor(s / 3600.0) AS BIGINT) || ' hour(s) ago' WHEN s >= 60 THEN CAST(floor(s / 60.0) AS BIGINT) || ' minute(s) ago' ELSE 'just now' END AS age
FROM (SELECT scan_id, CAST(trunc(date_diff('microsecond', scan_timestamp, TIMESTAMP '2026-01-01 00:00:00') / 1000000.0) AS BIGINT) AS s FROM scan_results)""")
def q_scan_age(spark, d):
    return table(spark, d, "scan_results").select("scan_id", dates.age_text(F.col("scan_timestamp"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("age"))


# --- plan and export --------------------------------------------------------------------------------------------------
@query("q_plan_union", f"""SELECT source_path, 'copy' AS operation, '/sorted/' || strftime(detected_date, '%Y/%m') || '/' || {NAME} AS destination_path, NULL AS reason FROM file_records WHERE detected_date IS NOT NULL
UNION ALL SELECT source_path, 'skip', NULL, 'No date detected' FROM file_records WHERE detected_date IS NULL""")
def q_plan_union(spark, d):
    return exporting.plan_operations(files(spark, d), "/sorted")


_ISOTS = lambda c: f"CASE WHEN {c} IS NULL THEN NULL WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
_EXPORT = f"""SELECT source_path AS path, {NAME} AS filename, size_bytes, {EXT} AS extension, {_ISOTS('detected_date')} AS date_taken, date_source, strftime(detected_date, '%Y') AS year, strftime(detected_date, '%m') AS month,
 destination_folder || '/' || coalesce(destination_filename, {NAME}) AS target_path, {_ISOTS('filename_date')} AS filename_date, date_mismatch, CAST(date_mismatch_days AS BIGINT) AS date_mismatch_days, {_ISOTS('video_metadata_date')} AS video_metadata_date, error_category,
 source_folder_name, folder_tags[1] AS folder_tag, folder_tag_reasons[1] AS folder_tag_reason, coalesce(len(folder_tags), 0) > 0 AS folder_tag_usable, proposed_destination_folder, proposed_filename,
 proposed_destination_folder || '/' || coalesce(proposed_filename, {NAME}) AS proposed_target_path, file_hash, is_duplicate, duplicate_of FROM file_records"""


@query("q_export_rows", _EXPORT)
def q_export_rows(spark, d):
    return exporting.export_rows(files(spark, d)).drop("folder_tags", "folder_tag_reasons").withColumn("date_mismatch_days", F.col("date_mismatch_days").cast("bigint"))


@query("q_csv_rows", f"""SELECT source_path AS path, coalesce({_ISOTS('detected_date')}, '') AS date_taken, coalesce(strftime(detected_date, '%Y'), '') AS year, CASE WHEN coalesce(date_mismatch, false) THEN 'True' ELSE 'False' END AS date_mismatch,
 CASE WHEN coalesce(date_mismatch_days, 0) = 0 THEN '' ELSE CAST(date_mismatch_days AS VARCHAR) END AS date_mismatch_days, coalesce(array_to_string(folder_tags, '|'), '') AS folder_tags, coalesce(file_hash, '') AS file_hash FROM file_records""")
def q_csv_rows(spark, d):
    return exporting.csv_rows(files(spark, d)).select("path", "date_taken", "year", "date_mismatch", "date_mismatch_days", "folder_tags", "file_hash")


@query("q_csv_all_columns", f"""SELECT path, filename, coalesce(CAST(size_bytes AS VARCHAR), '') AS size_bytes, extension, coalesce(date_taken, '') AS date_taken, coalesce(date_source, '') AS date_source, coalesce(year, '') AS year, coalesce(month, '') AS month,
 coalesce(target_path, '') AS target_path, coalesce(filename_date, '') AS filename_date, CASE WHEN coalesce(date_mismatch, false) THEN 'True' ELSE 'False' END AS date_mismatch, CASE WHEN coalesce(date_mismatch_days, 0) = 0 THEN '' ELSE CAST(date_mismatch_days AS VARCHAR) END AS date_mismatch_days,
 coalesce(video_metadata_date, '') AS video_metadata_date, coalesce(error_category, '') AS error_category, coalesce(source_folder_name, '') AS source_folder_name, coalesce(array_to_string(tags, '|'), '') AS folder_tags, coalesce(array_to_string(reasons, '|'), '') AS folder_tag_reasons,
 coalesce(folder_tag, '') AS folder_tag, coalesce(folder_tag_reason, '') AS folder_tag_reason, CASE WHEN folder_tag_usable THEN 'True' ELSE 'False' END AS folder_tag_usable, coalesce(proposed_destination_folder, '') AS proposed_destination_folder, coalesce(proposed_filename, '') AS proposed_filename,
 coalesce(proposed_target_path, '') AS proposed_target_path, coalesce(file_hash, '') AS file_hash, CASE WHEN coalesce(is_duplicate, false) THEN 'True' ELSE 'False' END AS is_duplicate, coalesce(duplicate_of, '') AS duplicate_of
FROM ({_EXPORT.replace(" FROM file_records", ", folder_tags AS tags, folder_tag_reasons AS reasons FROM file_records")})""")
def q_csv_all_columns(spark, d):
    return exporting.csv_rows(files(spark, d))


@query("q_json_rows")
def q_json_rows(spark, d):
    return exporting.json_rows(files(spark, d))


@query("q_sample_plan", f"""WITH r AS (SELECT file_id, source_path, detected_date, row_number() OVER (ORDER BY source_path, file_id, detected_date) AS n FROM file_records WHERE detected_date IS NOT NULL)
SELECT file_id, source_path, '/sorted/' || strftime(detected_date, '%Y/%m') AS proposed_folder FROM r WHERE n <= 50""")
def q_sample_plan(spark, d):
    first = files(spark, d).filter("detected_date is not null").orderBy("source_path", "file_id", "detected_date").limit(50)
    return first.select("file_id", "source_path", dates.destination_folder(F.col("detected_date"), "YYYY/MM", "/sorted").alias("proposed_folder"))


@query("q_rule_upsert", "SELECT folder_name, CASE WHEN rule_id % 7 = 0 THEN 'ignore' ELSE decision END AS decision, CASE WHEN rule_id % 7 = 0 THEN NULL ELSE alias END AS alias FROM tag_rules")
def q_rule_upsert(spark, d):
    rules = table(spark, d, "tag_rules")
    changes = rules.filter("rule_id % 7 = 0").select("folder_name", F.lit("ignore").alias("decision"), F.lit(None).cast("string").alias("alias"))
    return discovery.upsert_rules(rules.select("folder_name", "decision", "alias"), changes)


@query("q_rule_changes", f"""WITH c AS (SELECT DISTINCT source_folder_name AS folder_name, CASE WHEN {_USABLE} THEN 'use' ELSE 'ignore' END AS decision, NULL AS alias FROM file_records WHERE source_folder_name IS NOT NULL)
SELECT folder_name, decision, alias FROM tag_rules WHERE folder_name NOT IN (SELECT folder_name FROM c) UNION ALL SELECT folder_name, decision, alias FROM c""")
def q_rule_changes(spark, d):
    """The rules after every folder name of the library has been decided anew; most of them have no rule yet."""
    names_seen = files(spark, d).filter("source_folder_name is not null").select(F.col("source_folder_name").alias("folder_name")).distinct()
    decided = F.when(tags.classify_folder(F.col("folder_name"))["usable"], "use").otherwise("ignore")
    changes = names_seen.select("folder_name", decided.alias("decision"), F.lit(None).cast("string").alias("alias"))
    return discovery.upsert_rules(table(spark, d, "tag_rules").select("folder_name", "decision", "alias"), changes)


@query("q_file_op_checks", """SELECT entry_id, CASE WHEN s.source_path IS NULL THEN 'source does not exist' WHEN t.p IS NOT NULL THEN 'destination already exists' ELSE 'ready' END AS verdict FROM verify_entries v
LEFT JOIN (SELECT DISTINCT source_path FROM file_records) s ON s.source_path = v.source_path LEFT JOIN (SELECT DISTINCT actual_destination_path AS p FROM verify_entries WHERE actual_destination_path IS NOT NULL) t ON t.p = v.expected_destination_path""")
def q_file_op_checks(spark, d):
    v = table(spark, d, "verify_entries")
    s = files(spark, d).select("source_path", F.lit(True).alias("have")).distinct()
    t = v.filter("actual_destination_path is not null").select(F.col("actual_destination_path").alias("expected_destination_path"), F.lit(True).alias("taken")).distinct()
    joined = v.select("entry_id", "source_path", "expected_destination_path").join(s, "source_path", "left").join(t, "expected_destination_path", "left")
    return joined.select("entry_id", F.when(F.col("have").isNull(), "source does not exist").when(F.col("taken"), "destination already exists").otherwise("ready").alias("verdict"))
