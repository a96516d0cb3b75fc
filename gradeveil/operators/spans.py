"""Findings in texts: all matches of a profile's patterns with offsets, overlaps resolved, graded and redacted.

A finding is a struct of start, end (half open, in code points), kind, category and min_grade. Everything is done per
row with built-in expressions; a pattern is tried only on texts that hold a literal or a digit which it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeveil.functions import guards, policy
from gradeveil.functions.columns import bound

FINDING = "struct<start:int,end:int,kind:string,category:string,min_grade:int>"


def normalized(text: Column) -> Column:
    """Blanks squeezed to one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"[{policy.BLANKS}]+", " "))


def matches(text: Column, regex: str | Column) -> Column:
    """All matches of a regex with offsets: an array of struct<start,end>."""
    pattern = F.lit(regex) if isinstance(regex, str) else regex

    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def before(parts: Column, n: Column) -> Column:
                return F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))

            def span(x: Column, i: Column) -> Column:
                start = before(gaps, i + 1) + before(found, i)
                return F.struct(start.cast("int").alias("start"), (start + F.length(x)).cast("int").alias("end"))

            return F.transform(found, span)

        return bound(F.split(text, pattern, -1), with_gaps)

    return bound(F.regexp_extract_all(text, pattern, F.lit(0)), place)


def _finding(span: Column, kind: Column, category: Column, min_grade: Column, ord_: Column) -> Column:
    # this order of fields is that in which overlaps are resolved
    return F.struct(span["start"].alias("start"), min_grade.alias("min_grade"), (span["start"] - span["end"]).alias("minus_length"), ord_.alias("ord"), span["end"].alias("end"), kind.alias("kind"), category.alias("category"))


def _listed(values: Sequence) -> Column:
    return F.array(*map(F.lit, values))


def _hits(text: Column, fold: Column, signs: Column, digits: Column, patterns: Sequence[policy.Pattern]) -> Column:
    """Numbers of the patterns that match, from 1. Each is tested as a literal, which Spark compiles once."""
    tested = (guards.may_match(fold, signs, digits, p.regex) & text.rlike(policy.java_pattern(p, "client")) for p in patterns)
    return F.filter(F.array(*(F.when(t, F.lit(i + 1)) for i, t in enumerate(tested))), lambda i: i.isNotNull())


def _candidates(text: Column, hits: Column, patterns: Sequence[policy.Pattern]) -> Column:
    """All matches of the patterns with these numbers. They are looked up by number, so that the plan has one matching
    expression and not one per pattern."""
    regexes = [policy.java_pattern(p, "client") for p in patterns]
    categories = [policy.category_of(p.kind) for p in patterns]

    def of(i: Column) -> Column:
        def found(d: Column) -> Column:
            return F.transform(matches(text, d["regex"]), lambda s: _finding(s, d["kind"], d["category"], d["grade"], i))

        pick = lambda values, name: F.element_at(_listed(values), i).alias(name)
        return bound(F.struct(pick(regexes, "regex"), pick([p.kind for p in patterns], "kind"), pick(categories, "category"), pick([policy.MINIMUM_GRADES[c] for c in categories], "grade")), found)

    return F.flatten(F.transform(hits, of))


def _known(text: Column, known: Column) -> Column:
    """Places of known values of three characters and more, any letter case, left to right without overlap."""
    needles = F.filter(F.transform(known, lambda v: F.trim(v)), lambda v: F.length(v) >= 3)
    category = policy.category_of("KNOWN")
    fixed = F.lit("KNOWN"), F.lit(category), F.lit(policy.MINIMUM_GRADES[category])
    return F.flatten(F.transform(needles, lambda v, i: F.transform(matches(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(v), F.lit(r"\E"))), lambda s: _finding(s, *fixed, i + 1000))))


def resolved(candidates: Column) -> Column:
    """Greedy resolution of overlaps, by start, then grade, then length, then order of patterns: a candidate that
    overlaps accepted ones replaces all of them if it is stronger than each, and is dropped otherwise."""

    def step(accepted: Column, c: Column) -> Column:
        def over(a: Column) -> Column:
            return (a["start"] < c["end"]) & (c["start"] < a["end"])

        def decide(overlaps: Column) -> Column:
            strongest = F.array_min(F.transform(overlaps, lambda a: a["min_grade"]))
            return (
                F.when(F.size(overlaps) == 0, F.concat(accepted, F.array(c)))
                .when(c["min_grade"] < strongest, F.concat(F.filter(accepted, lambda a: ~over(a)), F.array(c)))
                .otherwise(accepted)
            )

        return bound(F.filter(accepted, over), decide)

    ordered = F.sort_array(candidates)
    accepted = F.aggregate(ordered, F.slice(ordered, 1, 0), step)
    shaped = F.transform(accepted, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["kind"].alias("kind"), a["category"].alias("category"), a["min_grade"].alias("min_grade")))
    return F.sort_array(shaped)


def with_findings(df: DataFrame, text: str = "text", *, known: str | None = None, out: str = "findings", patterns: Sequence[policy.Pattern] = tuple(policy.CLIENT)) -> DataFrame:
    """df with an array of resolved findings in the text as it stands; `known`: a column with an array of values that
    are to be found too. A null text has no findings."""
    t = F.col(text)
    df = df.withColumn("__fold", guards.folded(t)).withColumn("__signs", guards.signs_in(t)).withColumn("__digits", guards.digits_in(F.col("__signs")))
    df = df.withColumn("__hits", _hits(t, F.col("__fold"), F.col("__signs"), F.col("__digits"), patterns))
    df = df.withColumn("__candidates", F.when(F.size("__hits") > 0, _candidates(t, F.col("__hits"), patterns)))
    if known:
        extra = F.when(F.size(known) > 0, _known(t, F.col(known)))
        df = df.withColumn("__candidates", F.when(extra.isNotNull() & F.col("__candidates").isNotNull(), F.concat("__candidates", extra)).otherwise(F.coalesce(F.col("__candidates"), extra)))
    some = F.when(F.size("__candidates") > 0, resolved(F.col("__candidates")))
    return df.withColumn(out, F.coalesce(some, F.array().cast(f"array<{FINDING}>"))).drop("__candidates", "__hits", "__fold", "__signs", "__digits")


def for_grade(findings: Column, grade: int | Column) -> Column:
    """The findings that are hidden at a grade."""
    limit = F.lit(grade) if isinstance(grade, int) else grade
    return F.filter(findings, lambda f: f["min_grade"] <= limit)


def spliced(text: Column, findings: Column) -> Column:
    """text with each finding, in order and without overlap, replaced by its placeholder."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, f: Column) -> Column:
        put = F.concat(acc["done"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), F.lit("[REDACTED:"), f["kind"], F.lit("]"))
        return F.struct(f["end"].alias("at"), put.alias("done"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, start, step, finish))


def redacted(df: DataFrame, text: str = "text", *, grade: int = 3, known: str | None = None, max_length: int | None = None, out: str = "redacted", findings: str = "findings") -> DataFrame:
    """df with its text normalised and redacted at a grade, then clipped, and the findings that were replaced.

    Detection sees the whole text, so that clipping leaves no part of a value. Null texts stay null."""
    df = df.withColumn("__text", normalized(F.col(text)))
    df = with_findings(df, "__text", known=known, out=findings).withColumn(findings, for_grade(F.col(findings), grade))
    done = spliced(F.col("__text"), F.col(findings))
    return df.withColumn(out, F.substring(done, 1, max_length) if max_length else done).drop("__text")


def value_only(findings: Column, text: Column) -> Column:
    """Findings of labelled kinds, cut to what stands behind the first colon or equals sign."""
    # Kinds whose pattern has a label.
    labelled = ["SECRET", "BANK_ACCOUNT", "UPI", "DOB", "PASSPORT", "NAME", "USERNAME", "EMPLOYEE_ID", "ACCOUNT_ID", "ADDRESS"]

    def narrowed(f: Column) -> Column:
        found = F.substring(text, f["start"] + 1, f["end"] - f["start"])
        value = F.regexp_extract(found, f"(?s)^[^:=]*[:=][{policy.BLANKS}]*(.*)$", 1)
        start = F.when(f["kind"].isin(labelled) & (F.length(value) > 0), f["end"] - F.length(value)).otherwise(f["start"])
        return f.withField("start", start)

    return F.transform(findings, narrowed)
