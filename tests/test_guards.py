"""The cheap tests before patterns: whatever a pattern matches passes its guard."""

import pytest
from pyspark.sql import functions as F

from gradeveil.functions import guards, policy
from gradeveil.operators import spans, texts
from gradeveil.plans.text_queries import FLOOR_CASES, PATTERN_CASES

PATTERNS = [(p, "client") for p in policy.CLIENT] + [(p, "server") for p in policy.SHARED + policy.SERVER_FLOOR]


@pytest.mark.parametrize(
    "pattern,literals,digits",
    [
        (r"gh[pousr]_[A-Za-z0-9]{20,}", [{"_"}, {"gh"}], 0),
        (r"\b(?:dob|birth date)\s*[:=-]\s*(?:\d{1,2}[/-]){2}\d{2,4}", [set(":=-"), {"dob", "birth date"}], 4),
        (r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", [], 13),
        (r"(?:a|b+c)?x", [{"x"}], 0),
        (r"[\p{L}]+", [], 0),
        (r"(?:full name|name)", [{"name"}], 0),
    ],
)
def test_what_a_pattern_needs(pattern, literals, digits):
    assert guards.required(pattern) == (literals, digits)


def test_no_match_without_what_is_needed(spark):
    """On all documents, pages' texts and written-out cases, also in capitals and with letters that match a-z."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    cases = spark.createDataFrame([(c[0].replace("#", "7"),) for c in PATTERN_CASES + FLOOR_CASES], "text string")
    some = docs.unionByName(cases).unionByName(cases.select(F.upper("text").alias("text"))).unionByName(cases.select(F.translate("text", "sik", "ſıK").alias("text")))
    fold, signs = guards.folded(F.col("text")), guards.signs_in(F.col("text"))
    digits = guards.digits_in(signs)
    missed = [F.count_if(F.col("text").rlike(policy.java_pattern(p, profile)) & ~guards.may_match(fold, signs, digits, p.regex)).alias(f"{i}") for i, (p, profile) in enumerate(PATTERNS)]
    hits = [F.count_if(F.col("text").rlike(policy.java_pattern(p, profile))).alias(f"h{i}") for i, (p, profile) in enumerate(PATTERNS)]
    row = some.agg(*missed, *hits).first()
    assert all(row[f"{i}"] == 0 for i in range(len(PATTERNS)))
    assert all(row[f"h{i}"] > 0 for i in range(len(PATTERNS)))


def test_a_token_of_letters_is_hidden_everywhere(spark):
    df = spark.createDataFrame([("token ghp_abcdefghijklmnopqrstuvwxyzabcd here",)], "text string")
    assert spans.redacted(df, grade=1).first().redacted == "token [REDACTED:SECRET] here"
    assert texts.dlp_blocked(df, ["text"], 1).first().blocked
    assert texts.rejected_by_floor(df, "text", 1).first().rejected
