"""Quality rules for documents and, from their failures, verdicts on whole hosts. Only DataFrame functions.

The rules are measured once per document and written. Failures are summed by host (partial sums before the
shuffle), a beta prior is fitted to all hosts' failure rates by the method of moments, each host's rate is shrunk
towards it, and the hosts' verdicts are joined back to the documents. That join broadcasts the hosts only while there
are few of them (counted before); beyond, it is salted on the documents' side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeveil.llm.common import free_prefix, written

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Hosts that are broadcast at most; counted before.
BROADCAST_HOSTS = 20_000
SALTS = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words found twice or more. Windows are compared by 64-bit hashes; only texts
    in which a hash occurs twice sort them with their places."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(F.size(words) > 3, hashes)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once also where lambdas in `then` refer to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _covered(hashes: Column) -> Column:
    """Words that the windows whose hash occurs twice cover: 3 for each, less what the next one covers too."""

    def places(placed: Column) -> Column:
        def hash_at(k: Column) -> Column:
            return F.when(k >= 0, F.get(placed, k))["h"]

        twice = F.transform(placed, lambda x, k: F.when(x["h"].eqNullSafe(hash_at(k - 1)) | x["h"].eqNullSafe(hash_at(k + 1)), x["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bound(_bound(placed, places), covered)


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules use, as long columns. A null text has no words and no lines."""
    own = free_prefix(docs.columns)
    words, lines_, hashes = (F.col(f"`{own}{c}`") for c in ("words", "lines", "hashes"))
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.drop(*COUNTS).withColumn(f"{own}words", _words(t)).withColumn(f"{own}lines", lines)
    step = step.withColumn(f"{own}hashes", _repeat_words(words))
    repeated = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(hashes)).otherwise(F.lit(0))
    return (
        step.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, f"{BLANK}+", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
        .drop(f"{own}words", f"{own}lines", f"{own}hashes")
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(measured: DataFrame, *, host: str = "source", failed: str = "base_failed", max_rate: float = 0.9) -> DataFrame:
    """One row per host: documents, failures, the shrunk rate (failures + a) / (documents + a + b) and rejected.

    a and b are the beta prior whose mean and variance are those of the hosts' rates, weighted by documents; where
    the rates vary no more than chance explains, the prior is as strong as all documents of the mean host; a
    single host is its own prior. Null hosts are one host."""
    hosts = written(measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(failed).cast("long")).alias("failures")), "hosts")
    rate = F.col("failures") / F.col("documents")
    n, f, k, squares = hosts.agg(F.sum("documents"), F.sum("failures"), F.count(F.lit(1)), F.sum(F.col("documents") * rate * rate)).first()
    mean, strength = _prior(n or 1, f or 0, k or 1, squares or 0.0)
    shrunk = (F.col("failures") + mean * strength) / (F.col("documents") + strength)
    return hosts.select("host", "documents", "failures", shrunk.alias("rate"), (shrunk > max_rate).alias("rejected"))


def _prior(n: int, failures: int, hosts: int, squares: float) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior. squares: sum of documents times squared rate."""
    mean = failures / n
    # variance of the rates less what binomial sampling adds
    spread = max(squares / n - mean * mean - mean * (1 - mean) * hosts / n, 0.0)
    return mean, min(max(mean * (1 - mean) / spread - 1, 1.0), n / hosts) if spread > 0 else n / hosts


def apply_rules(docs: DataFrame, *, host: str = "source", text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.9, keep_text: bool = True) -> DataFrame:
    """docs, all columns kept, with the counts, base_failed, host_rate (double) and kept.

    kept is false if the document fails a base rule or its host is rejected. A null or empty text fails the word rule,
    long ones are read whole; null hosts are one host; repeated rows count each; there are no ties to break; no rows
    give no rows. Columns of docs with the names of added ones are replaced, all others kept, whatever their names.
    keep_text: whether the text is in the result and in the written table."""
    added = (*COUNTS, "base_failed", "host_rate", "kept")
    measured = rule_counts(docs.drop(*(c for c in docs.columns if c.lower() in added)), text)
    measured = written(measured.withColumn("base_failed", base_failed(min_words, max_repeat_percent)).drop(*([] if keep_text else [text])), "measured")
    own = free_prefix(measured.columns)
    hosts = host_verdicts(measured, host=host, max_rate=max_rate)
    rows = hosts.select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias(f"{own}host"), F.col("host").isNull().alias(f"{own}none"), F.col("rate").alias("host_rate"), F.col("rejected").alias(f"{own}rejected"))
    keyed = measured.withColumn(f"{own}host", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))).withColumn(f"{own}none", F.col(f"`{host}`").isNull())
    on = [f"{own}host", f"{own}none"]
    if rows.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(rows), on, "left")
    else:
        salts = rows.withColumn(f"{own}salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # by the row's place in the written table, as repeated rows would all have one hash
        salted = keyed.withColumn(f"{own}salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(salts, [*on, f"{own}salt"], "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col(f"{own}rejected"), F.lit(False))
    return joined.withColumn("kept", kept).select(*(F.col(f"`{c}`") for c in measured.columns), "host_rate", "kept")
