"""Queries over sources: files that they write from the tables to the shared folder and read through the operators, markup,
ledgers, and models behind seams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeveil.functions import seams, shared
from gradeveil.plans.catalogue import STRIPPED, _tag_sql
from gradeveil.plans.registry import query, table
from gradeveil.sources import readers


def _written(rows: DataFrame, key: str) -> str:
    """Writes rows of key and value as one text file for each key; the folder."""
    folder = shared.working_folder(rows.sparkSession)
    rows.repartition(key).write.partitionBy(key).text(folder)
    return folder


NATION = """'{"key":' || n_nationkey || ',"name":"' || n_name || '"}'"""


def _nations(spark: SparkSession, sf_dir: str) -> str:
    value = F.concat(F.lit('{"key":'), "n_nationkey", F.lit(',"name":"'), "n_name", F.lit('"}'))
    return _written(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("part"), value.alias("value")), "part")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_objects(spark, _nations(spark, sf_dir), "key long, name string").select("key", "name")


@query(f"SELECT n_nationkey::VARCHAR AS part, length({NATION}) + 1 AS length, sha256({NATION} || chr(10)) AS sha256 FROM nation")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.file_digests(spark, _nations(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"/part=([0-9]+)/", 1).alias("part"), "length", "sha256")


@query("SELECT n_nationkey::VARCHAR AS part, CASE n_nationkey % 4 WHEN 1 THEN 'size' WHEN 2 THEN 'hash' ELSE 'missing' END AS error FROM nation WHERE n_nationkey % 4 > 0")
def locked_file_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("path").cast("int") % 4
    files = readers.file_digests(spark, _nations(spark, sf_dir)).withColumn("path", F.regexp_extract("path", r"/part=([0-9]+)/", 1))
    locked = files.withColumn("length", F.when(n == 1, F.col("length") + 1).otherwise(F.col("length"))).withColumn("sha256", F.when(n == 2, "x").otherwise(F.col("sha256")))
    return readers.lock_violations(locked, files.where(n < 3)).select(F.col("path").alias("part"), "error")


@query("""SELECT '{' || chr(10) || '  "customers": ' || (SELECT count(*) FROM customer) || ',' || chr(10) || '  "nations": ' || (SELECT count(*) FROM nation) || ',' || chr(10) || '  "title": "Größe"' || chr(10) || '}' || chr(10) AS text""")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared.working_folder(spark)}/report.json"
    counts = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))
    nations = table(spark, sf_dir, "nation").count()
    readers.write_report(counts.select(F.lit("Größe").alias("title"), F.lit(nations).alias("nations"), "customers"), path)
    return readers.raw_bytes(spark, path).select(F.col("content").cast("string").alias("text"))


@query("SELECT sum(tests)::BIGINT AS tests, sum(failures)::BIGINT AS failures, sum(errors)::BIGINT AS errors, sum(skipped)::BIGINT AS skipped FROM (SELECT count(*) AS tests, count(*) FILTER (n_nationkey % 3 = 0) AS failures, count(*) FILTER (n_nationkey % 5 = 0) AS errors, 2 AS skipped FROM nation GROUP BY n_regionkey)")
def suite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    suites = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("part")).agg(F.count("*").alias("t"), F.count_if(k % 3 == 0).alias("f"), F.count_if(k % 5 == 0).alias("e"))
    xml = F.format_string('<testsuites><testsuite name="s" tests="%d" failures="%d" errors="%d" skipped="2"><testcase name="a"/></testsuite></testsuites>', "t", "f", "e")
    return readers.test_counts(spark, _written(suites.select("part", xml.alias("value")), "part"))


@query("SELECT 'pkg-' || s_suppkey AS name, '1.' || s_suppkey % 10 || '.0' AS version FROM supplier UNION ALL SELECT '@scope/dep', '2.0.0'")
def npm_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit('"node_modules/pkg-'), "s_suppkey", F.lit('":{"version":"1.'), F.col("s_suppkey") % 10, F.lit('.0"}'))
    listed = table(spark, sf_dir, "supplier").agg(F.concat_ws(",", F.collect_list(entry)).alias("e"))
    lock = listed.select(F.lit("npm").alias("part"), F.concat(F.lit('{"packages":{"":{"version":"0"},"node_modules/pkg-1/node_modules/@scope/dep":{"version":"2.0.0"},'), "e", F.lit("}}")).alias("value"))
    return readers.lock_components(spark, _written(lock, "part"))


@query("SELECT 'lib' || n_nationkey AS name, '>=' || n_nationkey || '.0' AS version FROM nation")
def project_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit('"lib'), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "[extra]").otherwise(""), F.lit(">="), "n_nationkey", F.lit('.0"'))
    listed = table(spark, sf_dir, "nation").agg(F.concat_ws(",", F.collect_list(entry)).alias("e"))
    text = listed.select(F.lit("toml").alias("part"), F.concat(F.lit('[project] name = "x" dependencies = ['), "e", F.lit("]")).alias("value"))
    return readers.project_components(spark, _written(text, "part"))


@query(f"SELECT doc_id AS path FROM documents WHERE regexp_matches(text, '{readers.HIGH_CONFIDENCE_SECRET}') UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey % 3 < 2")
def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and a file for each customer of which two in three hold a secret."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("key AKIA"), F.lpad(k.cast("string"), 16, "0"))).when(k % 3 == 1, "-----BEGIN EC PRIVATE KEY-----").otherwise("ghp_short")
    made = table(spark, sf_dir, "customer").select((-k).alias("path"), text.alias("text"))
    return readers.secret_files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text").unionByName(made))


LEDGER = "SELECT o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'succeeded' ELSE 'pending' END AS state, (o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 0 END)::DOUBLE AS updated_at FROM orders"


def _ledger(spark: SparkSession, sf_dir: str) -> str:
    folder, k = f"{shared.working_folder(spark)}/ledger", F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.cast("string").alias("job_id"), F.lit("s").alias("snapshot_id"), F.lit("pending").alias("state"), F.lit(None).cast("string").alias("response_json"), F.lit(None).cast("string").alias("failure"), k.cast("double").alias("updated_at"))
    readers.append_jobs(jobs, folder)
    readers.append_jobs(jobs.where(k % 3 == 0).withColumn("state", F.lit("succeeded")).withColumn("updated_at", F.col("updated_at") + 1000), folder)
    return folder


@query(LEDGER)
def ledger_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.current_jobs(spark, _ledger(spark, sf_dir)).select("job_id", "state", "updated_at")


@query(f"SELECT * FROM ({LEDGER}) WHERE updated_at > 50000 - 49000")
def ledger_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.retained(readers.current_jobs(spark, _ledger(spark, sf_dir)), 50_000.0, 49_000.0).select("job_id", "state", "updated_at")


@query(f"SELECT * FROM ({LEDGER}) WHERE job_id = (SELECT max(o_orderkey)::VARCHAR FROM orders WHERE o_orderkey % 3 = 0)")
def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").agg(F.max("o_orderkey")).first()[0]
    return readers.job(spark, _ledger(spark, sf_dir), str(key)).select("job_id", "state", "updated_at")


@query(
    """SELECT c_custkey, path, value FROM (SELECT c_custkey, 'name' AS path, '"' || c_name || '"' AS value FROM customer
        UNION ALL SELECT c_custkey, 'nested.list[0]', c_custkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'nested.list[1].deep', 'true' FROM customer
        UNION ALL SELECT c_custkey, 'nested.none', 'null' FROM customer UNION ALL SELECT c_custkey, 'empty', '{}' FROM customer) WHERE c_custkey % 10 > 0"""
)
def flattened_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"name":"'), "c_name", F.lit('","nested":{"list":['), k, F.lit(',{"deep":true}],"none":null},"empty":{}'), F.when(k % 10 > 0, "}").otherwise(""))
    return readers.flattened(table(spark, sf_dir, "customer").select("c_custkey", text.alias("json")), "c_custkey", "json")


# Markup. The pages hold links only, so that every page gets a form of its own.

FORM = """'<form><input type="text" name="n' || page_id || '" value="v ' || page_id || '" aria-label="Full name"><input type=hidden name="h" value="x"><input type="password" name="p" value="secret"><textarea name=''t'' placeholder="Notes"></textarea><button title="Send">Go</button></form>'"""


def _with_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    parts = re.split(r"' \|\| page_id \|\| '", FORM.strip("'").replace("''", "'"))
    form = F.lit(parts[0])
    for part in parts[1:]:
        form = F.concat(form, page, F.lit(part))
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", form).alias("html"))


def _attribute_sql(name: str) -> str:
    found = rf"regexp_extract(tag, '(?is)\s{name}\s*=\s*(\"[^\"]*\"|''[^'']*''|[^\s>]+)', 1)"
    return rf"CASE WHEN {found} <> '' THEN regexp_replace({found}, '^[\"'']|[\"'']$', '', 'g') END"


def _tags_sql(names: str, without: str) -> str:
    return f"""SELECT page_id, i - 1 AS position, tag FROM (SELECT page_id, unnest(ts) AS tag, generate_subscripts(ts, 1) AS i FROM (
        SELECT page_id, list_filter(regexp_extract_all(html || {FORM}, '{_tag_sql(names)}'), lambda t: NOT regexp_matches(t, '{without}')) AS ts FROM pages))"""


HIDDEN = r"""(?i)\stype\s*=\s*["'']?hidden"""
KEPT = r"""(?i)\stype\s*=\s*["'']?(?:hidden|password|file|checkbox|radio|submit|button|image|reset)"""


@query(
    rf"""SELECT page_id, position, lower(regexp_extract(tag, '^<\s*([A-Za-z0-9]+)', 1)) AS tag, {_attribute_sql('name')} AS name, {_attribute_sql('type')} AS type, {_attribute_sql('id')} AS id,
        coalesce({_attribute_sql('aria-label')}, {_attribute_sql('placeholder')}, {_attribute_sql('title')}) AS label FROM ({_tags_sql(readers.INTERACTIVE, HIDDEN)}) WHERE position < 500"""
)
def page_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.interactive_elements(_with_form(spark, sf_dir), "page_id").withColumn("position", F.col("position").cast("long"))


@query(
    rf"""SELECT page_id, position, {_attribute_sql('name')} AS name, coalesce({_attribute_sql('aria-label')}, {_attribute_sql('placeholder')}, {_attribute_sql('name')}) AS label, {_attribute_sql('value')}[:1000] AS value
        FROM ({_tags_sql('input|textarea|select', KEPT)}) WHERE position < 100"""
)
def page_transfer_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.transferable_controls(_with_form(spark, sf_dir), "page_id").withColumn("position", F.col("position").cast("long"))


NODES = rf"list_filter(list_transform(regexp_split_to_array({STRIPPED}, '(?s)<[^>]*>'), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> '')"


@query(
    f"""SELECT page_id, len(kept) AS regions, coalesce(list_sum(list_transform(kept, lambda t: length(t))), 0)::BIGINT AS chars FROM (
        SELECT page_id, list_filter(cut, lambda t, i: list_sum(list_transform(cut[:i], lambda u: length(u))) <= 300) AS kept FROM (SELECT page_id, list_transform(({NODES})[:6], lambda t: t[:100]) AS cut FROM pages))"""
)
def page_text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = readers.text_nodes(F.col("html"))
    kept = readers.text_regions(nodes, regions=6, chars=300, each=100)
    size = F.aggregate("kept", F.lit(0), lambda s, t: s + F.length(t)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", kept.alias("kept")).select("page_id", F.size("kept").cast("long").alias("regions"), size.alias("chars"))


# Models behind seams: small ones of plain rules stand in for those that a user brings

class Rules:
    """A recogniser, detector and reasoner of plain rules."""

    def entities(self, text: str) -> list[dict]:
        return [{"entity": "PER", "score": 0.9} for _ in re.findall(r"#0*[1-9]", text)] + [{"entity": "MISC", "score": 0.5} for _ in re.findall("7", text)]

    def ocr(self, png: bytes) -> list[dict]:
        return [{"text": line, "confidence": len(line) / 100, "x": 0.0, "y": float(k), "width": 1.0, "height": 1.0} for k, line in enumerate(png.decode().split("0"))]

    def detect(self, png: bytes) -> list[dict]:
        return [{"label": "face", "score": (len(png) % 10) / 10, "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}]

    def ready(self) -> bool:
        return True

    def reason(self, observation: str) -> dict | None:
        return {"type": "scroll", "direction": "down", "amount": len(observation)} if observation[-1] != "0" else None


@query("SELECT c_custkey, c_custkey > 0 AND regexp_matches(c_name, '#0*[1-9]') AS person, length(c_name) - length(replace(c_name, '7', '')) AS sevens FROM customer")
def seam_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seams.recognised_entities(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", Rules)
    count = lambda name: F.size(F.filter("entities", lambda e: e["entity"] == name)).cast("long")
    return found.select("c_custkey", (count("PER") > 0).alias("person"), count("MISC").alias("sevens"))


@query("SELECT c_custkey, len(string_split(c_name, '0')) AS lines, round(length(c_name) % 10 / 10, 6) AS score FROM customer")
def seam_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("png"))
    read = seams.detected_boxes(seams.recognised_lines(pictures, "png", Rules), "png", Rules)
    return read.select("c_custkey", F.size("lines").cast("long").alias("lines"), F.round(F.col("boxes")[0]["score"], 6).alias("score"))


@query("SELECT c_custkey, CASE WHEN c_name NOT LIKE '%0' THEN 'scroll' END AS type, (CASE WHEN c_name NOT LIKE '%0' THEN length(c_name) END)::INTEGER AS amount FROM customer")
def seam_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = seams.reasoned(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", Rules)
    return answered.select("c_custkey", "action.type", "action.amount")


@query(
    """SELECT n_nationkey AS n, round(s, 6) AS scale, ((64 - greatest(1, round_even(w * s, 0))::INTEGER) // 2)::DOUBLE AS left_pad, ((64 - greatest(1, round_even(h * s, 0))::INTEGER) // 2)::DOUBLE AS top_pad
    FROM (SELECT n_nationkey, 10 + n_nationkey AS w, 40 - n_nationkey AS h, least(64 / (10 + n_nationkey), 64 / (40 - n_nationkey)) AS s FROM nation)"""
)
def letterbox_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for n in batch["n"]:
                tensor, scale, left, top = seams.letterbox(np.zeros((40 - n, 10 + n, 3), np.uint8), 64)
                assert tensor.shape == (3, 64, 64)
                out.append((n, round(scale, 6), left, top))
            yield pd.DataFrame(out, columns=["n", "scale", "left_pad", "top_pad"])

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n")).mapInPandas(run, "n int, scale double, left_pad double, top_pad double")
