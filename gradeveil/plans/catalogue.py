"""Named queries over the standard tables, with the equivalent SQL where there is one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g
from gradeveil.functions import policy
from gradeveil.functions.columns import luhn
from gradeveil.operators import boxes, classify, documents, evaluation, reports, spans, texts, validation
from gradeveil.plans.registry import ORACLE_SQL, query
from gradeveil.plans.registry import table as _t
from gradeveil.sources import readers
from gradeveil.streaming import stateful

ALIAS_KEY = b"gradeveil demonstration key"


# Texts. The standard tables hold e-mail addresses, card numbers and IP addresses, so their SQL knows these three.

NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
EMAIL = r"'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'"
CARD = r"'\b(?:\d[ -]?){12,18}\d\b'"
IP = r"'\b(?:\d{1,3}\.){3}\d{1,3}\b'"
KINDS = {"EMAIL": EMAIL, "CARD": CARD, "IP": IP}


def _redacted_sql(table: str, columns: str, kinds: list[str], text: str = NORMAL) -> str:
    done = "t"
    for k in kinds:
        done = f"regexp_replace({done}, {KINDS[k]}, '[REDACTED:{k}]', 'g')"
    count = " + ".join(f"len(regexp_extract_all(t, {KINDS[k]}))" for k in kinds)
    return f"SELECT {columns}, ({count})::INTEGER AS n_findings, {done} AS redacted FROM (SELECT *, {text} AS t FROM {table})"


def _number(findings: str, text: str) -> Column:
    """How many findings a text has; null for a null text, as in the SQL."""
    return F.when(F.col(text).isNotNull(), F.size(findings)).alias("n_findings")


def _redact(grade: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = spans.redacted(_t(spark, sf_dir, "documents").select("doc_id", "text"), grade=grade)
        return done.select("doc_id", _number("findings", "text"), "redacted")

    run.__name__ = f"redact_documents_g{grade}"
    query(_redacted_sql("documents", "doc_id", ["CARD"] if grade == 1 else list(KINDS)))(run)


for _grade in (1, 2, 3):
    _redact(_grade)


def _findings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per finding in the documents' normalised texts."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", *columns, spans.normalized(F.col("text")).alias("text"))
    # an outer explode, as a filter on the findings would have them computed twice
    found = spans.with_findings(docs).select("doc_id", *columns, "text", F.explode_outer("findings").alias("f"))
    return found.where("f is not null")


EXPLODED = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS kind, unnest(regexp_extract_all({NORMAL}, {p})) AS value FROM documents" for k, p in KINDS.items())
CATEGORIES = "CASE kind WHEN 'EMAIL' THEN 'contact' WHEN 'CARD' THEN 'financial' ELSE 'network' END"


@query(f"SELECT kind, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ({EXPLODED}) GROUP BY kind")
def pii_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("f.kind").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"))


@query(f"SELECT doc_id, kind, value, count(*) AS n FROM ({EXPLODED}) GROUP BY ALL")
def pii_findings_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.substring(F.col("text"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    return _findings(spark, sf_dir).groupBy("doc_id", "f.kind", value.alias("value")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, source, kind, count(*) AS findings FROM ({EXPLODED}) GROUP BY ALL")
def pii_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, "lang", "source").groupBy("lang", "source", "f.kind").agg(F.count("*").alias("findings"))


@query(f"SELECT g.grade, c.category, count(e.value) AS hidden FROM (VALUES (1), (2), (3)) g(grade) CROSS JOIN (VALUES ('contact', 2), ('financial', 1), ('network', 2)) c(category, min_grade) LEFT JOIN (SELECT *, {CATEGORIES} AS category FROM ({EXPLODED})) e ON e.category = c.category AND c.min_grade <= g.grade GROUP BY ALL")
def category_rollup_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir).select("f.category", "f.min_grade", F.lit(1).alias("n"))
    # the categories of the SQL have rows where nothing is found too
    zeros = spark.createDataFrame([(c, policy.MINIMUM_GRADES[c], 0) for c in ("contact", "financial", "network")], "category string, min_grade int, n int")
    counts = found.unionByName(zeros).groupBy("category", "min_grade").agg(F.sum("n").alias("n"))
    grades = spark.createDataFrame([(1,), (2,), (3,)], "grade int")
    # a handful of categories by three grades
    return counts.join(F.broadcast(grades)).select("grade", "category", F.when(F.col("min_grade") <= F.col("grade"), F.col("n")).otherwise(F.lit(0)).alias("hidden"))


@query(f"SELECT doc_id, round(coalesce(sum(length(value)), 0) / length(any_value(t)), 6) AS masked FROM (SELECT doc_id, {NORMAL} AS t FROM documents) LEFT JOIN ({EXPLODED}) USING (doc_id) GROUP BY doc_id HAVING length(any_value(t)) > 0")
def masked_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", spans.normalized(F.col("text")).alias("text")).where("length(text) > 0")
    hidden = F.aggregate("findings", F.lit(0), lambda s, f: s + f["end"] - f["start"])
    return spans.with_findings(docs).select("doc_id", F.round(hidden / F.length("text"), 6).alias("masked"))


@query(rf"SELECT doc_id, digits, list_reduce(list_prepend(0, list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * c::INT > 9 THEN 2 * c::INT - 9 ELSE 2 * c::INT END ELSE c::INT END)), lambda a, b: a + b) % 10 = 0 AS valid, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all({NORMAL}, {CARD})), '[ -]', '', 'g') AS digits FROM documents) GROUP BY ALL")
def card_luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.substring(F.col("text"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    digits = _findings(spark, sf_dir).where("f.kind = 'CARD'").select("doc_id", F.regexp_replace(value, "[ -]", "").alias("digits"))
    return digits.groupBy("doc_id", "digits").agg(F.count("*").alias("n")).withColumn("valid", luhn(F.col("digits")))


JOINED_DIGITS = r"regexp_replace({}, '([0-9])[\s\v]+([0-9])', '\1\2', 'g')"


@query(rf"SELECT doc_id, sha256({JOINED_DIGITS.format(JOINED_DIGITS.format('t'))}) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{{2010}}-\x{{2015}}\x{{2212}}]', '-', 'g'), '[\s\v]*([@.])[\s\v]*', '\1', 'g') AS t FROM documents)")
def normalized_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL joins spaced digits in two passes, as a digit between two blanks takes part in two pairs."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.for_detection(F.col("text"), compatibility=False), 256).alias("digest"))


@query()
def normalized_nfkc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.for_detection(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, item_id AS canary_id, 'plain' AS form FROM documents JOIN benchmark b ON contains(lower(documents.text), lower(trim(b.text))) WHERE length(trim(b.text)) >= 3")
def known_value_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("canary_id"), F.col("text").alias("value"))
    return texts.canary_leaks(_t(spark, sf_dir, "documents"), values, "text", "doc_id")


@query("SELECT doc_id, item_id AS canary_id, CASE WHEN contains(documents.text, trim(b.text)) THEN 'plain' ELSE 'separated' END AS form FROM documents JOIN benchmark b ON contains(documents.text, trim(b.text)) OR contains(regexp_replace(upper(documents.text), '[^\\pL\\pN]', '', 'g'), regexp_replace(upper(trim(b.text)), '[^\\pL\\pN]', '', 'g'))")
def canary_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("canary_id"), F.col("text").alias("value"))
    return texts.canary_leaks(_t(spark, sf_dir, "documents"), values, "text", "doc_id", profile="verifier")


def _re2(p: policy.Pattern) -> str:
    """The pattern for a test of existence without lookaround: neighbours are consumed instead."""
    r = re.sub(r"\(\?<!(\[.*?\]|\\d)\)", lambda m: f"(?:^|[^{m[1].strip('[]')}])", p.regex)
    r = re.sub(r"\(\?!(\[.*?\]|\\d)\)", lambda m: f"(?:$|[^{m[1].strip('[]')}])", r)
    return ("(?i)" if p.ignore_case else "") + r.replace("'", "''")


def _floor(grade: int) -> None:
    patterns = [p for p in policy.SERVER_FLOOR if p.min_grade <= grade] + [p for p in policy.SHARED if policy.grade_of(p.kind) <= grade]
    hit = " OR ".join(f"regexp_matches(text, '{_re2(p)}')" for p in patterns)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hit = texts.floor_hit(F.col("text"), grade).isNotNull()
        return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(hit).alias("rejected"), F.count("*").alias("documents"))

    run.__name__ = f"server_floor_rejects_g{grade}"
    query(f"SELECT lang, count(*) FILTER ({hit}) AS rejected, count(*) AS documents FROM documents GROUP BY lang")(run)


for _grade in (1, 2, 3):
    _floor(_grade)


# Pages and conversations

STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
TEXT_ONLY = rf"trim(regexp_replace(regexp_replace({STRIPPED}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(_redacted_sql("pages", "page_id", list(KINDS), TEXT_ONLY))
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(readers.without_scripts(F.col("html")), r"(?s)<[^>]*>", " ")
    done = spans.redacted(_t(spark, sf_dir, "pages").select("page_id", plain.alias("text")))
    return done.select("page_id", _number("findings", "text"), "redacted")


@query(f"SELECT page_id, length(html) AS before, length({STRIPPED}) AS after FROM pages")
def page_scripts_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("before"), F.length(readers.without_scripts(F.col("html"))).cast("long").alias("after"))


def _hmac_sql(message: str) -> str:
    block = ALIAS_KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(f"SELECT page_id, 'https://site-' || {_hmac_sql('origin')}[:20] || '.invalid' AS alias FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]+')) AS origin FROM pages)")
def page_origin_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", texts.origin_alias(texts.origin_of(F.col("url")), ALIAS_KEY).alias("alias"))


def _tag_sql(names: str) -> str:
    return readers.TAG.format(f"(?:{names})").replace("'", "''")


@query(f"SELECT page_id, len(regexp_extract_all(html, '{_tag_sql('a')}')) AS links, len(regexp_extract_all(html, '{_tag_sql('p')}')) AS paragraphs, len(regexp_extract_all(html, '{_tag_sql('script|style')}')) AS scripts FROM pages")
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda names: F.size(readers.tags(F.col("html"), names)).cast("long")
    return _t(spark, sf_dir, "pages").select("page_id", count("a").alias("links"), count("p").alias("paragraphs"), count("script|style").alias("scripts"))


@query(f"SELECT page_id, len(list_filter(list_transform(regexp_split_to_array({STRIPPED}, '(?s)<[^>]*>'), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> '')) AS nodes FROM pages")
def page_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = readers.text_nodes(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.size(nodes).cast("long").alias("nodes"))


@query(f"SELECT page_id, i - 1 AS position, regexp_extract(tag, '(?i)\\shref\\s*=\\s*\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, unnest(ts) AS tag, generate_subscripts(ts, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_tag_sql('a')}') AS ts FROM pages))")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(readers.tags(F.col("html"), "a")).alias("position", "tag"))
    return rows.select("page_id", F.col("position").cast("long").alias("position"), F.coalesce(readers.attribute(F.col("tag"), "href"), F.lit("")).alias("href"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(t, '(?i)\\b(?:aadhaar|aadhar|uidai|passport|document)\\b') THEN 'document'
        WHEN regexp_matches(t, '(?i)\\b(?:person|portrait|face|selfie|human|headshot)\\b') THEN 'person' ELSE 'unknown' END AS kind
    FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t FROM pages)"""
)
def page_media_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return _t(spark, sf_dir, "pages").select("page_id", classify.media_kind(F.lit(None).cast("string"), title).alias("kind"))


@query(
    "SELECT conv_id, turn, '[' || upper(role) || '_' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || ']' AS handle, n_findings, redacted FROM ("
    + _redacted_sql("conversations", "conv_id, turn, role", list(KINDS))
    + ")"
)
def conversation_redacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spans.redacted(_t(spark, sf_dir, "conversations"))
    number = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return done.select("conv_id", "turn", F.concat(F.lit("["), F.upper("role"), F.lit("_"), number, F.lit("]")).alias("handle"), F.size("findings").alias("n_findings"), "redacted")


# Labels

PREDICTED = f"EXISTS (SELECT 1 FROM ({EXPLODED}) e WHERE e.doc_id = documents.doc_id)"
JUDGED = f"SELECT lang, toxic = 1 AS actual, {PREDICTED} AS predicted FROM documents JOIN labels USING (doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spans.with_findings(_t(spark, sf_dir, "documents").select("doc_id", "lang", spans.normalized(F.col("text")).alias("text")))
    flagged = docs.select("doc_id", "lang", (F.size("findings") > 0).alias("predicted"))
    return flagged.join(_t(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("toxic") == 1).alias("actual"), "predicted")


def _metrics_sql(group: str) -> str:
    keys = f"{group}, " if group else ""
    return f"""WITH s AS (SELECT {keys}count(*) FILTER (actual AND predicted) AS true_positives, count(*) FILTER (NOT actual AND predicted) AS false_positives,
        count(*) FILTER (actual AND NOT predicted) AS false_negatives, count(*) FILTER (NOT actual AND NOT predicted) AS tn FROM ({JUDGED}) {'GROUP BY ' + group if group else ''}),
    r AS (SELECT *, round(true_positives / nullif(true_positives + false_positives, 0), 6) AS precision, round(true_positives / nullif(true_positives + false_negatives, 0), 6) AS recall,
        true_positives / nullif(true_positives + false_positives, 0)::DOUBLE AS p, (true_positives + false_positives)::DOUBLE AS n, 1.96 AS z FROM s)
    SELECT {keys}tn, true_positives, false_positives, false_negatives, precision, recall,
        CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1,
        CASE WHEN n > 0 THEN round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0.0), 6) END AS precision_low,
        CASE WHEN n > 0 THEN round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1.0), 6) END AS precision_high
    FROM r"""


@query(_metrics_sql(""))
def label_eval_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir), [])


@query(_metrics_sql("lang"))
def wilson_interval_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir), ["lang"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS observed, NULL::BIGINT AS missing FROM documents UNION ALL SELECT NULL, NULL, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.coverage(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT g.grade, count(l.doc_id) AS observations FROM (VALUES (1), (2), (3)) g(grade) LEFT JOIN labels l ON quality + 1 = g.grade GROUP BY g.grade")
def observations_per_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.grade_counts(_t(spark, sf_dir, "labels").select((F.col("quality") + 1).alias("grade")))


# Events

SUMMARY = "count(v) AS n, min(v) AS min, median(v) AS median, avg(v) AS mean, quantile_disc(v, 0.95) AS p95, max(v) AS max"
SECONDS = "epoch_us(ts) / 1e6"
ORDERED = f"SELECT user_id::VARCHAR AS key, event_id, {SECONDS} AS ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query(f"SELECT event_type, n, min, round(median, 6) AS median, round(mean, 6) AS mean, p95, max FROM (SELECT event_type, {SUMMARY.replace('(v', '(value')} FROM events GROUP BY event_type)")
def event_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(_t(spark, sf_dir, "events"), "value", ["event_type"]))


@query(f"SELECT l_returnflag, n, min, round(median, 6) AS median, round(mean, 6) AS mean, p95, max FROM (SELECT l_returnflag, {SUMMARY.replace('(v', '(l_extendedprice')} FROM lineitem GROUP BY l_returnflag)")
def lineitem_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("SELECT event_id, '[' || upper(event_type) || '_' || row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) || ']' AS handle FROM events")
def event_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    numbered = reports.numbered(events, ["event_type"], ["ts", "event_id"], "day", "number")
    return numbered.select("event_id", F.concat(F.lit("["), F.upper("event_type"), F.lit("_"), "number", F.lit("]")).alias("handle"))


@query("SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.event_counters(_t(spark, sf_dir, "events"))


def _decided(spark: SparkSession, sf_dir: str, fold: str, **parameters) -> DataFrame:
    out = stateful.decisions(stateful.events_of(_t(spark, sf_dir, "events")), fold, **parameters)
    return out.select("key", "event_id", "decision", F.round("amount", 3).alias("amount"))


@query(
    f"""WITH RECURSIVE e AS ({ORDERED}),
    s AS (SELECT key, event_id, rn, ts, [ts] AS log, 'allowed' AS decision, 0.0::DOUBLE AS amount FROM e WHERE rn = 1
        UNION ALL SELECT key, event_id, rn, ts, CASE WHEN len(kept) >= 3 THEN kept ELSE list_append(kept, ts) END, CASE WHEN len(kept) >= 3 THEN 'denied' ELSE 'allowed' END,
            CASE WHEN len(kept) >= 3 THEN greatest(1, trunc(kept[1] + 172800 - ts + 0.999))::DOUBLE ELSE 0.0 END
        FROM (SELECT e.key, e.event_id, e.rn, e.ts, list_filter(s.log, lambda t: t > e.ts - 172800) AS kept FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1))
    SELECT key, event_id, decision, amount FROM s"""
)
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "limiter", limit=3, window=172_800.0)


@query(
    f"""WITH RECURSIVE e AS ({ORDERED}),
    s AS (SELECT key, event_id, rn, ts + 43200 AS next, 0.0::DOUBLE AS amount FROM e WHERE rn = 1
        UNION ALL SELECT e.key, e.event_id, e.rn, greatest(e.ts, s.next) + 43200, greatest(e.ts, s.next) - e.ts FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1)
    SELECT key, event_id, 'reserved' AS decision, round(amount, 3) AS amount FROM s"""
)
def capture_gate_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "gate", gap=43_200.0)


@query(
    f"""WITH RECURSIVE e AS ({ORDERED}),
    s AS (SELECT key, event_id, rn, 'closed' AS state, (event_type = 'error')::INT AS failed, 0.0::DOUBLE AS until, 'called' AS decision, (event_type = 'error')::DOUBLE AS amount FROM e WHERE rn = 1
        UNION ALL SELECT key, event_id, rn,
            CASE WHEN held THEN state WHEN NOT bad THEN 'closed' WHEN state = 'open' OR failed + 1 >= 2 THEN 'open' ELSE state END,
            CASE WHEN held THEN failed WHEN bad THEN failed + 1 ELSE 0 END,
            CASE WHEN NOT held AND bad AND (state = 'open' OR failed + 1 >= 2) THEN ts + 259200 ELSE until END,
            CASE WHEN held THEN 'open' WHEN state = 'open' THEN 'probe' ELSE 'called' END,
            CASE WHEN held THEN until - ts WHEN bad THEN failed + 1 ELSE 0 END::DOUBLE
        FROM (SELECT e.key, e.event_id, e.rn, e.ts, s.state, s.failed, s.until, s.state = 'open' AND e.ts < s.until AS held, e.event_type = 'error' AS bad FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1))
    SELECT key, event_id, decision, round(amount, 3) AS amount FROM s"""
)
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "breaker", threshold=2, open_seconds=259_200.0)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _t(spark, sf_dir, "events").schema
    return stateful.events_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


@query(ORACLE_SQL["rate_limit_decisions"])
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stateful.replayed(stateful.decision_stream(_streamed(spark, sf_dir), "limiter", limit=3, window=172_800.0))
    return out.select("key", "event_id", "decision", F.round("amount", 3).alias("amount"))


@query(ORACLE_SQL["breaker_states"])
def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stateful.replayed(stateful.decision_stream(_streamed(spark, sf_dir), "breaker", threshold=2, open_seconds=259_200.0))
    return out.select("key", "event_id", "decision", F.round("amount", 3).alias("amount"))


@query(
    f"""WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY rn) >= 86400, false)::INT AS new FROM ({ORDERED})),
    i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY rn)::BIGINT AS session FROM m)
    SELECT key, session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM i GROUP BY key, session"""
)
def scroll_debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sessions(stateful.events_of(_t(spark, sf_dir, "events")), 86_400.0)


REVISED = f"SELECT *, sum((event_type = 'purchase')::INT) OVER w::BIGINT AS revision, bool_or(event_type = 'purchase') OVER w AS latched FROM ({ORDERED}) WINDOW w AS (PARTITION BY key ORDER BY rn)"


@query(f"SELECT key, event_id, revision, latched FROM ({REVISED})")
def revision_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.revisions(stateful.events_of(_t(spark, sf_dir, "events")), F.col("event_type") == "purchase").select("key", "event_id", "revision", "latched")


@query(f"SELECT key, event_id FROM (SELECT *, lag(revision) OVER (PARTITION BY key ORDER BY rn) AS b FROM ({REVISED})) WHERE revision = b")
def stable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.stable_pairs(stateful.revisions(stateful.events_of(_t(spark, sf_dir, "events")), F.col("event_type") == "purchase")).select("key", "event_id")


@query("SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def dedup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).dropDuplicates()


@query(f"SELECT event_id FROM events WHERE {SECONDS} <= (SELECT max({SECONDS}) FROM events) - 864000")
def job_ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stateful.events_of(_t(spark, sf_dir, "events"))
    now = events.agg(F.max("ts")).first()[0] or 0.0
    return stateful.expired(events, now, 864_000.0).select("event_id")


# Boxes, from the first numbers of the vectors

BOXES = "SELECT vec_id, vec_id // 20 AS picture, label, abs(embedding[1]::DOUBLE) * 1000 AS x, abs(embedding[2]::DOUBLE) * 1000 AS y, abs(embedding[3]::DOUBLE) * 800 + 1 AS w, abs(embedding[4]::DOUBLE) * 800 + 1 AS h, abs(embedding[5]::DOUBLE) AS score FROM embeddings"
COMMON = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    bounds = g.rect(n(1) * 1000, n(2) * 1000, n(3) * 800 + 1, n(4) * 800 + 1)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 20).alias("picture"), "label", bounds.alias("bounds"), n(5).alias("score"))


@query(f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({COMMON} / (a.w * a.h + b.w * b.h - {COMMON}), 6) AS iou FROM ({BOXES}) a JOIN ({BOXES}) b ON a.picture = b.picture AND a.vec_id < b.vec_id WHERE {COMMON} > 0")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select("picture", "vec_id", "bounds")
    both = boxes.pairs(b, b, ["picture"], F.col("l_vec_id") < F.col("r_vec_id"))
    overlap = both.where(g.intersection_area(F.col("l_bounds"), F.col("r_bounds")) > 0)
    return overlap.select(F.col("l_vec_id").alias("a_id"), F.col("r_vec_id").alias("b_id"), F.round(g.iou(F.col("l_bounds"), F.col("r_bounds")), 6).alias("iou"))


def _union_sql(rows: str) -> str:
    return f"""WITH b AS ({rows}), e AS (SELECT DISTINCT picture, unnest([x, x + w]) AS l FROM b),
    s AS (SELECT picture, l, lead(l) OVER (PARTITION BY picture ORDER BY l) AS r FROM e),
    c AS (SELECT s.picture, l, r, y AS t, y + h AS u FROM s JOIN b ON b.picture = s.picture AND b.x <= l AND b.x + b.w >= r),
    m AS (SELECT *, max(u) OVER (PARTITION BY picture, l ORDER BY t, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
    SELECT picture, round(sum((r - l) * greatest(u - greatest(t, coalesce(before, t)), 0)), 3) AS union_area FROM m GROUP BY picture"""


@query(_union_sql(BOXES))
def box_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.union_area(_boxes(spark, sf_dir), ["picture"]).select("picture", F.round("union_area", 3).alias("union_area"))


@query(_union_sql(f"SELECT a.picture, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS h FROM ({BOXES}) a JOIN ({BOXES}) b ON a.picture = b.picture AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND {COMMON} > 0"))
def box_intersection_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return boxes.intersection_of_unions(b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1"), ["picture"]).select("picture", F.round("union_area", 3).alias("union_area"))


@query(f"SELECT picture, least(100.0, round(100 * sum(w * h) / 1e6)) AS masked_percent FROM ({BOXES}) GROUP BY picture")
def box_masked_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _boxes(spark, sf_dir).groupBy("picture").agg(F.collect_list("bounds").alias("b"))
    return grouped.select("picture", g.masked_percent(F.col("b"), F.lit(1000), F.lit(1000)).alias("masked_percent"))


@query(
    f"""SELECT l_vec_id, r_vec_id, overlap FROM (SELECT a.vec_id AS l_vec_id, b.vec_id AS r_vec_id, round({COMMON} / least(a.w * a.h, b.w * b.h), 6) AS overlap,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY {COMMON} / least(a.w * a.h, b.w * b.h) DESC, b.vec_id) AS rank
    FROM ({BOXES}) a JOIN ({BOXES}) b ON a.picture = b.picture AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE {COMMON} / least(a.w * a.h, b.w * b.h) >= 0.5) WHERE rank = 1"""
)
def closest_hint_per_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select("picture", "vec_id", "bounds")
    best = boxes.nearest(b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1"), ["picture"], "vec_id", "vec_id", 0.5)
    return best.select("l_vec_id", "r_vec_id", F.round("overlap", 6).alias("overlap"))


def _truth_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _boxes(spark, sf_dir).select(F.col("picture").cast("string").alias("case_id"), F.col("vec_id").cast("string").alias("id"), (F.col("label") % 3).cast("string").alias("kind"), "bounds", F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("field"), (F.col("vec_id") % 2).alias("side"))
    t = b.where("side = 0").drop("side").withColumnRenamed("id", "annotation_id")
    return t, b.where("side = 1").drop("side").withColumnRenamed("id", "detection_id").withColumn("wildcard", F.col("kind") == "0")


@query()
def eval_matching_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths, predictions = _truth_and_predictions(spark, sf_dir)
    matches = evaluation.maximum_matching(evaluation.candidate_matches(truths, predictions, 0.1))
    return evaluation.detection_metrics(truths, predictions, matches, by_kind=True)


@query(
    f"""WITH b AS (SELECT *, label % 3 AS kind FROM ({BOXES}))
    SELECT a.picture::VARCHAR AS case_id, a.vec_id::VARCHAR AS annotation_id, b.vec_id::VARCHAR AS detection_id, round({COMMON} / (a.w * a.h + b.w * b.h - {COMMON}), 6) AS quality
    FROM b a JOIN b ON a.picture = b.picture AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND (b.kind = 0 OR a.kind = b.kind) WHERE {COMMON} / (a.w * a.h + b.w * b.h - {COMMON}) >= 0.1"""
)
def eval_candidate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.candidate_matches(*_truth_and_predictions(spark, sf_dir), 0.1).withColumn("quality", F.round("quality", 6))


# Joins with a rule

@query("SELECT picture, category, count(*) AS n FROM (SELECT vec_id // 20 AS picture, CASE label % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'financial' ELSE 'biometric' END AS category FROM embeddings) GROUP BY ALL")
def redaction_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("EMAIL"), F.lit("CARD"), F.lit("face"))
    rows = _boxes(spark, sf_dir).select("picture", F.element_at(kinds, (F.col("label") % 3 + 1).cast("int")).alias("kind"))
    return reports.category_counts(rows, ["picture"]).select("picture", F.explode("categories").alias("category", "n"))


@query(
    """SELECT a.o_custkey AS custkey, a.o_orderkey AS source_id, CASE WHEN count(b.o_orderkey) = 1 THEN min(b.o_orderkey) END AS target_id,
        CASE count(b.o_orderkey) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'transferred' ELSE 'ambiguous' END AS status
    FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey % 2 = 1 WHERE a.o_orderkey % 2 = 0 GROUP BY a.o_custkey, a.o_orderkey"""
)
def field_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_orderpriority").alias("label"))
    sources = orders.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "source_id").withColumn("value", F.lit("x"))
    targets = orders.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "target_id").withColumn("disabled", F.lit(False))
    return reports.transfers(sources, targets, ["custkey"]).select("custkey", "source_id", "target_id", "status")


@query("SELECT c_custkey, any_value(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) = 1")
def unique_match_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("o_orderkey")).where("n = 1").drop("n")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = _t(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) UNION ALL SELECT p_partkey + 1000000 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    suppliers = _t(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")
    parts = _t(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select((F.col("p_partkey") + 1_000_000).alias("s_suppkey"))
    return suppliers.unionByName(parts)


@query("SELECT picture, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY picture ORDER BY lo, hi) AS island FROM (SELECT picture, lo, hi, coalesce(lo > max(hi) OVER (PARTITION BY picture ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM (SELECT picture, x AS lo, x + w AS hi FROM (" + BOXES + ")))) GROUP BY picture, island")
def merged_box_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("picture", F.col("bounds.x").alias("lo"), g.right(F.col("bounds")).alias("hi"))
    return evaluation.merged_intervals(rows, ["picture"], "lo", "hi")


# Records. The tables hold none, so they are built from rows of the tables.

def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms: a picture's boxes as elements with labels, roles and states from their numbers."""
    b = _boxes(spark, sf_dir)
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))
    v = F.col("vec_id")
    label = pick(["I agree to the terms", "Submit form", "Full name [public] [filled]", "Back", "Continue", "[REDACTED:NAME]", "City [public]"], v)
    role = pick(["checkbox", "button", "textbox", "link", "button", "button", "combobox"], v)
    state = F.struct((v % 3 == 0).alias("disabled"), (v % 4 == 0).alias("checked"), (v % 7 == 2).alias("editable"), (v % 5 == 0).alias("required"))
    element = F.struct(F.concat(F.lit("e_"), F.lpad(v.cast("string"), 16, "0")).alias("id"), role.alias("role"), label.alias("label"), "bounds", state.alias("state"))
    grouped = b.groupBy("picture").agg(F.sort_array(F.collect_list(F.struct("vec_id", element.alias("e")))).alias("es"))
    task = pick(["Submit the form", "Fill in the name and submit", "Read the page", "Register now"], F.col("picture"))
    return grouped.select("picture", task.alias("task"), F.transform("es", lambda x: x["e"]).alias("elements"))


FOUND = "list_filter([CASE WHEN out THEN 'element_bounds' END, CASE WHEN picture % 5 NOT BETWEEN 1 AND 3 THEN 'grade' END{}], lambda c: c IS NOT NULL)"


@query(f"SELECT picture, {FOUND.format('')} AS client, {FOUND.format('')} AS server, {FOUND.format(', ' + repr('integer_bounds'))} AS verifier FROM (SELECT picture, bool_or(x + w > 900 OR y + h > 900) AS out FROM ({BOXES}) GROUP BY picture)")
def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _elements(spark, sf_dir)
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("picture").cast("string"), 12, "0"))
    image = F.struct(F.lit("image/png").alias("mime"), F.lit("iVBORw0KGgoAAAA").alias("dataBase64"), F.lit(900).alias("width"), F.lit(900).alias("height"))
    privacy = F.struct(F.lit("wasm").alias("detectorBackend"), F.lit("none").alias("visualFallback"), F.lit(False).alias("rawImageRetained"), (F.col("picture") % 5).cast("int").alias("grade"))
    page = F.struct(F.concat(F.lit("https://site-"), F.substring(F.sha2(uuid, 256), 1, 20), F.lit(".invalid")).alias("origin"), F.lit("A page").alias("title"))
    empty = F.array().cast(f"array<struct<kind:string,source:string,bounds:{validation.RECT},confidence:double>>")
    record = F.struct(F.lit("1.0").alias("schemaVersion"), uuid.alias("snapshotId"), uuid.alias("documentId"), page.alias("page"), "task", "elements", image.alias("image"), empty.alias("redactions"), privacy.alias("privacy"))
    rows = validation.parsed(forms.select("picture", F.to_json(record).alias("json")))
    return rows.select("picture", *(validation.observation_violations(F.col("json"), F.col("obs"), p).alias(p) for p in ("client", "server", "verifier")))


@query()
def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lines of card-shaped pictures."""
    found = documents.classify_texts(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select("id", F.size("documents").alias("n_documents"), F.size("secrets").alias("n_secrets"))
