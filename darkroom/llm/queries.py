"""Queries of the training-data operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm.canonical import map_rows, map_to_events
from darkroom.llm.leakage import find_passages, leaked_items
from darkroom.llm.lookalikes import find_disguised_by_field, one_form
from darkroom.llm.mixing import mix
from darkroom.llm.ngrams import ngram_counts, term_marks
from darkroom.llm.subjects import assign_subjects, composition
from darkroom.session import table


def _tag_marks(spark: SparkSession, d: str) -> DataFrame:
    files = term_marks(table(spark, d, "file_records"), "file_id", "folder_tags", 3, 0.03)
    scans = term_marks(table(spark, d, "scan_results"), "scan_id", "folder_tags_detected", 3, 0.40)
    return files.select(F.lit("folder_tags").alias("field_name"), "*").unionByName(scans.select(F.lit("folder_tags_detected").alias("field_name"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags too rare or too common to sort by."""
    return _tag_marks(spark, d).filter(F.col("mark").isNotNull()).select("field_name", F.col("term").alias("tag"), "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every tag."""
    return _tag_marks(spark, d).select("field_name", F.col("term").alias("tag"), "occurrences", "records", "mark")


def p1_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and files of every run of one to three neighbouring tags."""
    counts = ngram_counts(table(spark, d, "file_records"), "file_id", "folder_tags", 3)
    return counts.select(F.array_join("ngram", "\x1f").alias("ngram"), F.col("n").cast("bigint").alias("n"), "occurrences", "records")


_TAGS = """
WITH t AS (SELECT 'folder_tags' AS field_name, file_id AS record, unnest(folder_tags) AS tag FROM file_records
  UNION ALL SELECT 'folder_tags_detected', scan_id, unnest(folder_tags_detected) FROM scan_results),
n AS (SELECT 'folder_tags' AS field_name, count(DISTINCT file_id) * 0.03 AS most FROM file_records
  UNION ALL SELECT 'folder_tags_detected', count(DISTINCT scan_id) * 0.40 FROM scan_results),
c AS (SELECT field_name, tag, count(*) AS occurrences, count(DISTINCT record) AS records FROM t WHERE tag IS NOT NULL AND tag <> '' GROUP BY ALL),
m AS (SELECT c.*, CASE WHEN records < 3 THEN 'rare' WHEN records > most THEN 'common' END AS mark FROM c JOIN n USING (field_name))
"""

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p1_ngrams": p1_ngrams}
ORACLES = {
    "p1_found": _TAGS + "SELECT field_name, tag, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TAGS + "SELECT field_name, tag, occurrences, records, mark FROM m",
    "p1_ngrams": """
WITH f AS (SELECT file_id, list_filter(folder_tags, lambda x: x IS NOT NULL AND x <> '') AS l FROM file_records WHERE folder_tags IS NOT NULL),
p AS (SELECT file_id, l, unnest(range(1, len(l) + 1)) AS i FROM f),
g AS (SELECT file_id, unnest([1, 2, 3]) AS n, i, l FROM p)
SELECT array_to_string(l[i:i + n - 1], chr(31)) AS ngram, CAST(n AS BIGINT) AS n, count(*) AS occurrences, count(DISTINCT file_id) AS records
FROM g WHERE i + n - 1 <= len(l) GROUP BY ALL""",
}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Folder names and tags that look like a rule's text but are stored in other characters."""
    files = table(spark, d, "file_records")
    use = table(spark, d, "tag_rules").filter("decision = 'use'")
    rows = lambda field, value: files.select(F.lit(field).alias("field"), F.col("file_id").alias("record"), value.alias("value"))
    texts = lambda field, text: use.select(F.lit(field).alias("field"), F.col("rule_id").alias("target_id"), text.alias("text"))
    found = find_disguised_by_field(
        rows("source_folder_name", F.col("source_folder_name")).unionByName(rows("folder_tags", F.explode("folder_tags"))),
        texts("source_folder_name", F.col("folder_name")).unionByName(texts("folder_tags", F.coalesce("alias", "folder_name"))),
    )
    return found.select(F.col("record").alias("file_id"), F.col("field").alias("field_name"), F.col("target_id").alias("rule_id"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct folder name that is changed by bringing it to the consistent form."""
    rules = table(spark, d, "tag_rules").select(F.col("folder_name").alias("text"))
    return one_form(table(spark, d, "file_records"), "source_folder_name", rules).filter(F.col("value") != F.col("form"))


QUERIES |= {"p2_found": p2_found, "p2_forms": p2_forms}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The rule that each free-typed folder name stands for, 0 if there is none."""
    rules = table(spark, d, "tag_rules")
    mapped = map_rows(table(spark, d, "file_records"), "file_id", "source_folder_name", rules.select("folder_name"), rules.filter("decision = 'use'"))
    return mapped.select(F.col("record").alias("file_id"), "rule_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The free-typed folder names that stand for no rule, with the files that carry them."""
    rules = table(spark, d, "tag_rules")
    files = table(spark, d, "file_records").select("file_id", F.col("source_folder_name").alias("value"))
    mapped = map_to_events(files.join(rules.select(F.col("folder_name").alias("value")), "value", "left_anti"), "value", rules.filter("decision = 'use'"))
    counts = files.groupBy("value").agg(F.countDistinct("file_id").alias("files"))
    return counts.join(mapped.filter("rule_id = 0"), "value").select("value", "files")


QUERIES |= {"p5_found": p5_found, "p5_unmatched": p5_unmatched}


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that carry a held-out passage, wholly or partly."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items that leaked, with the posts that carry them."""
    return leaked_items(_leaks(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in the mixture."""
    return mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mix_targets"))[1]


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The drawn posts, one row a copy."""
    return mix(table(spark, d, "documents"), "doc_id", "source", "text", table(spark, d, "mix_targets"))[0]


QUERIES |= {"p6_found": p6_found, "p6_leaked_items": p6_leaked_items, "p7_mixture": p7_mixture, "p7_report": p7_report}


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_examples"), table(spark, d, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts with the subjects they are about."""
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject."""
    return composition(table(spark, d, "documents"), "doc_id", "text", _subjects(spark, d))


QUERIES |= {"p8_found": p8_found, "p8_composition": p8_composition}
