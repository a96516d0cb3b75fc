"""The pipeline against plain versions of its stages, and the queries against their SQL."""

from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gradeveil.llm import queries
from gradeveil.llm.common import written
from gradeveil.llm.encoding import default_vocabulary

from . import brute

SF = "/root/testdata/sf0.001"
BENCHMARK = [(1, " ".join(f"bench{k}" for k in range(30)))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    line = "a line that stands in very many of all the documents"
    rows = []
    for i in range(40):
        text = " ".join(f"doc{i}word{k}" for k in range(60))
        rows.append((i, f"{text}\n{line}" if i % 3 == 0 else text, "en", "s", len(text)))
    rows[5] = (5, rows[4][1] + " more", "en", "s", 0)
    rows[9] = (9, f"{rows[9][1]} {BENCHMARK[0][1]}", "en", "s", 0)
    rows += [(50, "too short", "en", "s", 9), (51, None, "en", "s", None), (52, "again " * 100, "en", "s", 600)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return f"file://{base}", rows


def test_stages(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]

    def after(name, docs):
        out = written(stages[name](spark, docs, sf_dir), name)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return out, [(r.doc_id, r.text) for r in out.collect()] if name != "packing" else None

    expected = [(i, t) for i, t, *_ in rows if (c := brute.rule_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    docs, got = after("quality_rules", docs)
    assert Counter(got) == Counter(expected)
    expected = [(i, t) for i, t, *_ in brute.lines_kept(expected)]
    docs, got = after("line_dedup", docs)
    assert Counter(got) == Counter(expected)
    expected = [d for d, (_, c) in zip(expected, brute.components(expected, 5), strict=True) if d[0] == c]
    docs, got = after("near_dedup", docs)
    assert Counter(got) == Counter(expected) and 5 not in dict(got)
    expected = [d for d in expected if BENCHMARK[0][1] not in d[1]]
    docs, got = after("decontamination", docs)
    assert Counter(got) == Counter(expected) and 9 not in dict(got)
    packed, _ = after("packing", docs)
    tokenizer = Tokenizer.from_file(default_vocabulary())
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected}
    assert {r.doc_id: r.length for r in packed.collect()} == lengths
    assert {(r.doc_id, r.length) for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(lengths.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = connection.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(expected)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
