import pytest

from darkroom.llm import queries
from tests.oracle import connect, rows

FOUND = {
    "p1_found": {"field_name": "string", "tag": "string", "mark": "string"}, "p2_found": {"file_id": "bigint", "field_name": "string", "rule_id": "bigint"}, "p5_found": {"file_id": "bigint", "rule_id": "bigint"},
    "p6_found": {"doc_id": "bigint", "item_id": "bigint"}, "p8_found": {"doc_id": "bigint", "subject": "string"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    frame = queries.QUERIES[name](spark, data)
    if name in FOUND:
        assert dict(frame.dtypes) == FOUND[name]
    got = frame.toPandas()
    if name in queries.ORACLES:
        assert rows(got) == rows(connect(data).sql(queries.ORACLES[name]).df())
    if name in FOUND:
        assert not got.duplicated().any() and got.notna().all().all()
    assert len(got) > 0
