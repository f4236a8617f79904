import json
import re
from difflib import SequenceMatcher
from pathlib import PurePosixPath

import pytest

from darkroom.operators import exporting

from darkroom.plans import registry
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    want = connect(data).sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries whose result must hold these values of a column on the smallest tables, so that equality with SQL is not equality of nothing.
CASES = {
    "q_collision_policies": ("outcome", {"copy", "renamed", "collision skipped", "duplicate of existing file"}), "q_sizes_verify": ("status", {"ok", "mismatch", "missing_destination"}),
    "q_found_by_content": ("status", {"ok_existing_duplicate", "missing_destination"}), "q_rule_changes": ("decision", {"use", "ignore"}), "q_deep_date_cascade": ("best_source", {"filename", "folder_name"}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_has_cases(spark, data, name):
    column, values = CASES[name]
    assert {r[0] for r in registry.QUERIES[name](spark, data).select(column).distinct().collect()} >= values


def test_same_content_has_cases(spark, data):
    assert registry.QUERIES["q_same_content_elsewhere"](spark, data).count() > 0


def test_tags_in_names_equal_the_plain_rule(spark, data):
    def present(name, tag):
        if not name or not tag:
            return False
        name, tag = name.lower(), tag.lower()
        stem = PurePosixPath(name).stem
        return tag in name or any(SequenceMatcher(None, p, tag).ratio() >= 0.75 for p in [stem, *(p for p in re.split(r"[-_\s]+", stem) if len(p) >= 2)])

    got = registry.QUERIES["q_tag_in_filename"](spark, data).collect()
    assert got and all(r.present == present(r.name, r.tag) for r in got)
    added = registry.QUERIES["q_should_add_tag"](spark, data).collect()
    assert added and all(r["add"] == (r.tag is not None and not present(r.source_path.rsplit("/", 1)[1], r.tag)) for r in added)


def test_json_rows_hold_the_export_rows(spark, data):
    files = spark.read.parquet(f"{data}/file_records.parquet")
    want = {(r.path, r.file_hash, r.date_taken, tuple(r.folder_tags or ()), r.is_duplicate) for r in exporting.export_rows(files).collect()}
    documents = [json.loads(r.json) for r in registry.QUERIES["q_json_rows"](spark, data).collect()]
    assert {(x["path"], x["file_hash"], x["date_taken"], tuple(x["folder_tags"] or ()), x["is_duplicate"]) for x in documents} == want and all(list(x) == exporting.COLUMNS for x in documents)


def test_numbered_collisions_equal_a_plain_rule(spark, data):
    rows = sorted((r.source, r.destination, r.final_destination, r.outcome) for r in registry.QUERIES["q_collisions_exact"](spark, data).collect())
    taken = {}
    hashes = {r.source_path: r.h for r in spark.read.parquet(f"{data}/file_records.parquet").groupBy("source_path").agg({"file_hash": "min"}).withColumnRenamed("min(file_hash)", "h").collect()}
    plans = {}
    for source, destination, final, outcome in rows:
        plans.setdefault(destination, []).append((source, final, outcome))
        if destination not in taken:
            want = (destination, "copy")
        elif hashes[source] is not None and hashes[source] == hashes[taken[destination]]:
            want = (None, "duplicate in batch")
        else:
            path, n = PurePosixPath(destination), 1
            while str(new := path.with_name(f"{path.stem}_{n:03d}{path.suffix}")) in taken:
                n += 1
            want = (str(new), "renamed")
        assert (final, outcome) == want, source
        if want[0]:
            taken[want[0]] = source


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
