"""Declared schemas and vocabularies."""

import pytest

from foliospark import schemas


@pytest.mark.parametrize("name", sorted(schemas.TABLE_DDL))
def test_schemas_parse(spark, name):
    schema = schemas.table_schema(name)
    assert {"created_at", "updated_at"} <= set(schema.names)
    assert spark.createDataFrame([], schema).count() == 0


def test_violations_are_found(spark):
    rows = spark.createDataFrame([(1, "failed"), (2, "FAILED"), (3, None)], "id int, status string")
    found = schemas.vocabulary_violations(rows, "files").collect()
    assert [r.id for r in found] == [2, 3]


def test_read_view_hides_the_vector(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id int, embedding array<float>")
    assert schemas.read_view(rows).columns == ["id"]
