"""Queries against their SQL on odd tables."""

from collections import Counter

import duckdb
import pytest

from gradeveil.plans import catalogue, registry  # noqa: F401 registers the queries


@pytest.fixture
def differing(spark, tmp_path):
    def compare(query, name, rows, schema):
        """Rows that only the query has, and rows that only its SQL has."""
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        got = registry.QUERIES[query](spark, str(tmp_path))
        connection = duckdb.connect()
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        expected = Counter(connection.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[query]})").fetchall())
        found = Counter(map(tuple, got.collect()))
        return found - expected, expected - found

    return compare


@pytest.mark.parametrize("texts", [[], ["nothing", None], ["from 10.0.0.1"], ["a.b@example.org from 10.0.0.1, 4111 1111 1111 1111"]])
def test_rollup_has_categories_without_findings(differing, texts):
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    assert differing("category_rollup_by_grade", "documents", rows, "doc_id long, text string, lang string, source string") == (Counter(), Counter())


@pytest.mark.parametrize("grade", [1, 2, 3])
def test_redacted_documents_with_null_texts(differing, grade):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "nothing"), (5, "a.b@example.org from 10.0.0.1, 4111 1111 1111 1111")]
    assert differing(f"redact_documents_g{grade}", "documents", rows, "doc_id long, text string") == (Counter(), Counter())


def test_redacted_pages_with_null_texts(differing):
    rows = [(1, None), (2, ""), (3, "<p> </p>"), (4, "<p>nothing</p>"), (5, "<p>a.b@example.org from 10.0.0.1</p><script>4111 1111 1111 1111</script>")]
    assert differing("redact_pages", "pages", rows, "page_id long, html string") == (Counter(), Counter())
