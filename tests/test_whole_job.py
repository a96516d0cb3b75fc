"""Queries on rows that earlier versions left out."""

import hashlib

import pytest

import __spark_entry__  # noqa: F401 registers the queries
from gradeveil.plans import catalogue, registry


@pytest.fixture
def table(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_document_secrets_of_whole_texts(spark, table):
    card = "Number 4111 1111 1111 1111\nValid thru 12/29\nCVV 123"
    far = "\n".join([card, *["filler"] * 30, card])
    texts = {
        1: card,
        2: "\n".join([*["filler"] * 11, card]),  # lines 12 to 14
        3: "\n".join(f"{'x' * 250} {line}" for line in card.split("\n")),
        4: far,  # two cards
        5: "\n".join(["filler"] * 40),
        6: None,
        7: "",
    }
    path = table("documents", list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n_documents, r.n_secrets) for r in registry.QUERIES["document_secrets"](spark, path).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (2, 6), 5: (0, 0), 6: (0, 0), 7: (0, 0)}


def test_forms_have_all_boxes(spark, table):
    path = table("embeddings", [(i, [0.1 * (k + 1) for k in range(8)], i % 3) for i in range(50)], "vec_id long, embedding array<float>, label int")
    got = {r.picture: [e.id for e in r.elements] for r in catalogue._elements(spark, path).collect()}
    assert got == {p: [f"e_{i:016d}" for i in range(20 * p, min(20 * p + 20, 50))] for p in range(3)}
    for name in ("structural_plan", "form_plan", "guarded_plan", "observation_violations"):
        assert registry.QUERIES[name](spark, path).count() == 3


def test_hash_of_spaced_digits(spark, table):
    texts = {1: "card 4 1 1 1\t1", 2: "a @ b . c", 3: "plain", 4: None}
    path = table("documents", list(texts.items()), "doc_id long, text string")
    joined = {1: "card 41111", 2: "a@b.c", 3: "plain"}
    got = {r.doc_id: r.digest for r in registry.QUERIES["normalized_text_hash"](spark, path).collect()}
    assert got == {**{k: hashlib.sha256(t.encode()).hexdigest() for k, t in joined.items()}, 4: None}


def test_known_values_are_whole(spark, table):
    values = {1: "An opening that many a text shares, sixty characters and more, " + "then the end", 2: "short value"}
    texts = {10: f"x {values[1].upper()} y", 11: values[1][:-1] + "t", 12: "a Short Value", 13: None}
    table("benchmark", list(values.items()), "item_id long, text string")
    path = table("documents", list(texts.items()), "doc_id long, text string")
    brute = {(k, i) for k, t in texts.items() for i, v in values.items() if v.lower() in (t or "").lower()}
    got = {(r.doc_id, r.canary_id) for r in registry.QUERIES["known_value_hits"](spark, path).collect()}
    assert got == brute == {(10, 1), (12, 2)}


def test_label_coverage_has_all_missing_ids(spark, table):
    table("labels", [(i, 1, 0) for i in range(0, 1000, 4)], "doc_id long, quality int, toxic int")
    path = table("documents", [(i, "t") for i in range(1000)], "doc_id long, text string")
    rows = registry.QUERIES["label_coverage"](spark, path).collect()
    assert [(r.total, r.observed) for r in rows if r.total is not None] == [(1000, 250)]
    assert sorted(r.missing for r in rows if r.total is None) == [i for i in range(1000) if i % 4]
