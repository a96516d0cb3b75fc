"""Queries over records: requests, actions, settings, evaluation results, reports, state machines and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeveil.functions import policy
from gradeveil.operators import evaluation, reports, texts, validation
from gradeveil.plans import planners
from gradeveil.plans.catalogue import BOXES, CATEGORIES, EXPLODED, ORDERED, _decided, _elements, _findings
from gradeveil.plans.registry import ORACLE_SQL, case_query, query, table
from gradeveil.streaming import stateful

# Requests and settings

ADMITTED = "CASE WHEN k % 7 = 0 THEN 403 WHEN coalesce(k % 5, 0) = 0 THEN 401 WHEN k % 3 = 0 THEN 405 WHEN k % 11 = 0 THEN 429 WHEN k % 13 = 0 THEN 415 WHEN k % 2 = 0 AND k > 1000 THEN 413 ELSE 200 END"


@query(f"SELECT k, {ADMITTED}::INTEGER AS status FROM (SELECT o_orderkey AS k FROM orders)")
def admission_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    origin, key = k % 7 != 0, F.when(k % 5 != 0, True)  # an unknown key fails
    method, rate = F.when(k % 3 == 0, "GET").otherwise("POST"), k % 11 != 0
    content = F.when(k % 13 == 0, "text/plain").otherwise(" Application/JSON ; charset=utf-8")
    size = F.when((k % 2 == 0) & (k > 1000), 8_000_001).otherwise(8_000_000)
    return table(spark, sf_dir, "orders").select(k.alias("k"), validation.admission(origin, key, method, rate, content, size).alias("status"))


case_query(
    "endpoint_rules",
    "url string",
    {"errors": "VARCHAR[]"},
    [
        ("https://model.example/v1/reason", []),
        ("http://127.0.0.1:8#00/v1/reason", []),
        ("http://model.example/v1/reason", ["insecure"]),
        ("https://user:x@model.example/v1/reason", ["credentials_query_or_fragment"]),
        ("https://model.example/v1/reason?x=#", ["credentials_query_or_fragment"]),
        ("https://model.example/v1/other", ["path"]),
        ("ftp://model.example/v1/other", ["insecure", "path"]),
    ],
    lambda df: {"errors": validation.endpoint_violations(F.col("url"))},
)

case_query(
    "origin_rules",
    "origin string",
    {"allowed": "BOOLEAN"},
    [("https://app.example", True), ("https://evil.example", False), ("chrome-extension://abcdefgh", True), ("chrome-extension://abc", False), (None, False), ("https://app.example/", False)],
    lambda df: {"allowed": validation.origin_allowed(F.col("origin"), ["https://app.example"], ["chrome-extension://[a-p]{8}"])},
)

_SETTINGS = "adapter string, gateway_url string, gateway_key string, model_digest string, require_key boolean, api_key string, model_url string, allow_remote boolean, profile string, fallback boolean, ledger_url string"
case_query(
    "deployment_rules",
    _SETTINGS,
    {"errors": "VARCHAR[]"},
    [
        ("ollama", None, None, None, False, None, "http://localhost:11434", False, "development", True, None, []),
        ("ollama", None, None, None, False, None, "http://model.example", False, "development", True, None, ["remote_model"]),
        ("ollama", None, None, None, True, None, "http://model.example", True, "development", True, None, ["api_key"]),
        ("gateway", "https://gw.example", None, "d", False, None, "http://127.0.0.1:1", False, "development", True, None, ["gateway_key"]),
        ("gateway", "http://gw.example", "k", None, False, None, "http://127.0.0.1:1", False, "development", True, None, ["gateway_url", "gateway_model_digest"]),
        ("gateway", "http://localhost:9", None, "d", False, None, "http://localhost", False, "development", False, None, []),
        ("ollama", None, None, None, True, "k", "http://localhost", False, "production", True, None, ["model_digest", "structural_fallback", "ledger"]),
        ("ollama", None, None, "d", True, "k", "http://localhost", False, "production", False, "redis://x", []),
    ],
    lambda df: {"errors": validation.settings_violations(F.struct(*(F.col(c) for c in df.columns if c != "c_custkey")))},
)

case_query(
    "person_settings",
    "task string, max_steps int, api_key string, grade int, allow_transfer boolean, source_tab int, canaries array<string>",
    {"valid": "BOOLEAN"},
    [
        ("Read", 30, "", 3, False, None, [], True),
        (" ", 10, "", 3, False, None, [], False),
        ("Read", 31, "", 3, False, None, [], False),
        ("Read", 10, "", 4, False, None, [], False),
        ("Read", 10, "", 1, True, None, [], False),
        ("Read", 10, "", 1, True, 7, ["x#"], True),
        ("Read", 10, "", 1, None, -1, [], False),
        ("Read", 10, "k" * 1001, 1, None, None, [], False),
        ("Read", 10, "", 1, None, None, ["c" * 501], False),
    ],
    lambda df: {"valid": validation.client_settings_valid(F.struct(*(F.col(c) for c in df.columns if c != "c_custkey")))},
)

_REQUEST = '{"type":"SANITIZE_CAPTURE","requestId":"00000000-0000-4000-8000-00000000000#","screenshot":"data:image/png;base64,AAAA","allowFullMaskFallback":true,"privacyGrade":3,"canaries":["x"],"dom":{"elements":[],"redactions":[],"viewport":{"width":800,"height":600}}}'
case_query(
    "capture_requests",
    "json string",
    {"valid": "BOOLEAN"},
    [
        (_REQUEST, True),
        (_REQUEST.replace("SANITIZE", "X"), False),
        (_REQUEST.replace("-4000-", "-0000-"), False),
        (_REQUEST.replace("image/png", "image/gif"), False),
        (_REQUEST.replace("true", '"true"'), False),
        (_REQUEST.replace(':3,"can', ':3.0,"can'), False),
        (_REQUEST.replace(':3,"can', ':4,"can'), False),
        (_REQUEST.replace('"canaries":["x"],', ""), False),
        (_REQUEST.replace('"x"', '"' + "x" * 501 + '"'), False),
        (_REQUEST.replace(':3,"can', ':3,"highAssuranceMode":1,"can'), False),
        (_REQUEST.replace(':3,"can', ':3,"highAssuranceMode":false,"task":"t","can'), True),
        (_REQUEST.replace("800", "0"), False),
        (_REQUEST.replace('"elements":[],', ""), False),
        ("not json", False),
        (None, False),
    ],
    lambda df: {"valid": validation.capture_request_valid(F.col("json"))},
)

case_query(
    "context_equality",
    "a struct<tab:int,url:string>, b struct<tab:int,url:string>",
    {"same": "BOOLEAN"},
    [((1, "u"), (1, "u"), True), ((1, "u"), (2, "u"), False), ((1, None), (1, None), True), (None, None, True), (None, (1, "u"), False)],
    lambda df: {"same": validation.context_equal(F.col("a"), F.col("b"))},
)

# Actions

_ACTION = "type string, elementId string, text string, option string, direction string, amount int, milliseconds int, message string"
_NO = (None,) * 6


def _action() -> Column:
    return F.struct(*(F.col(c.split(" ")[0]) for c in _ACTION.split(", ")))


case_query(
    "action_shapes",
    _ACTION,
    {"error": "VARCHAR"},
    [
        ("click", "e_1", *_NO, None),
        ("click", None, *_NO, "missing"),
        ("click", "e_1", "x", None, None, None, None, None, "extra"),
        ("fly", "e_1", *_NO, "unknown_type"),
        ("input", "e_1", "hello #", None, None, None, None, None, None),
        ("input", "e_1", "x" * 513, None, None, None, None, None, "length"),
        ("select", "e_1", None, "", None, None, None, None, "length"),
        ("scroll", None, None, None, "down", 450, None, None, None),
        ("scroll", "e_1", None, None, "left", 450, None, None, "range"),
        ("scroll", None, None, None, "up", 5001, None, None, "range"),
        ("wait", None, None, None, None, None, 99, None, "range"),
        ("wait", None, None, None, None, None, 400, None, None),
        ("done", None, None, None, None, None, None, "Done #", None),
        ("done", "e_1", None, None, None, None, None, None, "extra"),
    ],
    lambda df: {"error": validation.action_shape(_action())},
)

_STATE = "struct<disabled:boolean,editable:boolean>"
_PAGE = [("e_1", "textbox", (False, True)), ("e_2", "button", (True, False)), ("e_3", "checkbox", (False, False)), ("e_4", "combobox", (False, True))]
case_query(
    "action_checks",
    f"{_ACTION}, same boolean, elements array<struct<id:string,role:string,state:{_STATE}>>",
    {"error": "VARCHAR"},
    [
        ("click", "e_3", *_NO, True, _PAGE, None),
        ("click", "e_3", *_NO, False, _PAGE, "stale_snapshot"),
        ("click", "e_3", *_NO, None, _PAGE, "stale_snapshot"),
        ("click", "e_9", *_NO, True, _PAGE, "unknown_element"),
        ("click", "e_2", *_NO, True, _PAGE, "disabled_element"),
        ("input", "e_3", "x", None, None, None, None, None, True, _PAGE, "not_editable"),
        ("input", "e_1", "hello #", None, None, None, None, None, True, _PAGE, None),
        ("input", "e_1", "PAN ABCDE123#F", None, None, None, None, None, True, _PAGE, "private_text"),
        ("input", "e_1", "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 #", None, None, None, None, None, True, _PAGE, "private_text"),
        ("check", "e_1", *_NO, True, _PAGE, "not_a_checkbox"),
        ("uncheck", "e_3", *_NO, True, _PAGE, None),
        ("select", "e_4", None, "Red", None, None, None, None, True, _PAGE, None),
        ("select", "e_1", None, "Red", None, None, None, None, True, _PAGE, "not_a_combobox"),
        ("scroll", "e_1", None, None, "down", 10, None, None, True, _PAGE, "not_a_scroll-region"),
        ("wait", None, None, None, None, None, 400, None, True, [], None),
    ],
    lambda df: {"error": validation.action_against_observation(_action(), F.col("elements"), F.col("same"), 3)},
)

_BOUNDS = "struct<x:double,y:double,width:double,height:double>"
_OBS = f"task string, title string, digest string, labels array<string>, box {_BOUNDS}, n int"


def _semantic(df: DataFrame) -> dict | DataFrame:
    element = lambda label: F.struct(label.alias("label"), F.col("box").alias("bounds"))
    elements = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: element(F.lit("x")))).otherwise(F.transform("labels", element))
    obs = F.struct("task", F.struct("title").alias("page"), elements.alias("elements"), F.array().cast(f"array<struct<bounds:{_BOUNDS}>>").alias("redactions"), F.struct(F.lit(800).alias("width"), F.lit(600).alias("height")).alias("image"), F.struct(F.col("digest").alias("registryDigest")).alias("privacy"))
    return validation.semantic_rejection(df.withColumn("obs", obs), 2, digest="sha256:a").select("c_custkey", "rejection")


_IN, _OUT = (0.0, 0.0, 10.0, 10.0), (790.0, 0.0, 20.0, 10.0)
case_query(
    "semantic_rejections",
    _OBS,
    {"rejection": "VARCHAR"},
    [
        ("Read", "A page", "sha256:a", ["Name", ""], _IN, 0, None),
        ("Read", "A page", None, ["Name"], _IN, 0, None),
        ("Read", "A page", "sha256:b", ["x@y.example"], _OUT, 0, "registry_digest_mismatch"),
        ("Read", "A page", "sha256:a", [], _OUT, 501, "too_many_elements"),
        ("Read", "A page", "sha256:a", ["Name"], _OUT, 0, "bounds_outside_image"),
        ("Read", "A page", "sha256:a", ["dev@example.in"], _IN, 0, "unredacted_pii_detected"),
        ("Read", "A page", "sha256:a", ["[REDACTED:EMAIL]"], _IN, 0, None),
        ("Ｂｅａｒｅｒ abcdefgh123#", "A page", "sha256:a", [], _IN, 0, "unredacted_pii_detected"),
        ("Read", "username: ananya#", "sha256:a", [], _IN, 0, None),
    ],
    _semantic,
)

# The registry of categories and patterns

_REGISTRY = {
    "fit": ({}, [], {}, []),
    "missing": ({"name": None}, [], {}, ["missing_category:name"]),
    "unknown": ({"mood": 2}, [], {}, ["unknown_category:mood"]),
    "range": ({"name": 4}, [], {}, ["grade_out_of_range:name"]),
    "weak": ({"credential": 2}, [], {}, ["not_always_hidden:credential"]),
    "repeat": ({}, [("EMAIL", "x"), ("EMAIL", "x")], {}, ["repeated_pattern:EMAIL"]),
    "bare": ({}, [("NEW", "x")], {}, ["no_category:NEW"]),
    "broken": ({}, [("EMAIL", "(")], {}, ["bad_regex:EMAIL"]),
}


@query("SELECT registry, violation FROM (VALUES " + ", ".join(f"('{name}', '{v}')" for name, (*_, found) in _REGISTRY.items() for v in found) + ") v(registry, violation)")
def registry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, (grades, patterns, kinds, _) in _REGISTRY.items():
        merged = {c: g for c, g in {**policy.MINIMUM_GRADES, **grades}.items() if g is not None}
        rows += [(name, v) for v in policy.registry_violations(merged, [policy.Pattern(*p) for p in patterns], {**policy.CATEGORY_OF_KIND, **kinds})]
    return spark.createDataFrame(rows, "registry string, violation string")


# Evaluation

@query(
    """SELECT case_id, error FROM (
        SELECT o_custkey AS case_id, 'duplicate_case' AS error FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT o_custkey, 'duplicate_observation' FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT o_custkey, 'unknown_case' FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)
        UNION ALL SELECT o_custkey, 'not_synthetic' FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 10 = 2)
        UNION ALL SELECT o_custkey, 'raw_image_retained' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 9 = 0) GROUP BY ALL"""
)
def corpus_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cases = orders.where(k % 2 == 0).select(F.col("o_custkey").alias("case_id"), F.when(k % 10 == 0, False).when(k % 10 != 2, True).alias("synthetic"))
    observations = orders.where(k % 2 == 1).select(F.col("o_custkey").alias("case_id"), (k % 9 == 0).alias("raw_image_retained"))
    return evaluation.integrity_errors(cases, observations)


@query("SELECT count(*) FILTER (o_orderkey % 3 > 0) AS tasks, round(count(*) FILTER (o_orderkey % 3 = 1) / count(*) FILTER (o_orderkey % 3 > 0), 6) AS success_rate, round(avg(o_orderkey % 7) FILTER (o_orderkey % 3 > 0), 6) AS mean_steps FROM orders")
def task_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return evaluation.task_success(table(spark, sf_dir, "orders").select(F.when(k % 3 > 0, k % 3 == 1).alias("success"), (k % 7).alias("steps")))


@query(
    f"""WITH found AS (SELECT DISTINCT doc_id, {CATEGORIES} AS category FROM ({EXPLODED})),
    j AS (SELECT d.lang, c.category, c.min_grade, l.toxic = 1 OR (l.quality = 0 AND c.category = 'contact') AS actual, f.doc_id IS NOT NULL AS predicted
        FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('contact', 2), ('financial', 1), ('network', 2)) c(category, min_grade) LEFT JOIN found f ON f.doc_id = d.doc_id AND f.category = c.category),
    g AS (SELECT lang, category, grade, actual AND min_grade <= grade AS a, predicted AND min_grade <= grade AS p FROM j, (VALUES (1), (2), (3)) g(grade))
    SELECT lang, category, grade, count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (a AND p) AS true_positives, count(*) FILTER (NOT a AND p) AS false_positives, count(*) FILTER (a AND NOT p) AS false_negatives FROM g GROUP BY ALL"""
)
def label_eval_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion by language, category and grade, with zeros."""
    found = _findings(spark, sf_dir).select("doc_id", F.col("f.category").alias("category")).distinct().withColumn("predicted", F.lit(True))
    categories = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(policy.MINIMUM_GRADES[c]).alias("min_grade")) for c in ("contact", "financial", "network")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("c", F.explode(categories)).select("*", "c.*")
    actual = (F.col("toxic") == 1) | ((F.col("quality") == 0) & (F.col("category") == "contact"))
    rows = docs.join(found, ["doc_id", "category"], "left").withColumn("actual", actual).withColumn("predicted", F.coalesce("predicted", F.lit(False)))
    return evaluation.confusion_by_grade(rows, ["lang"]).select("lang", "category", "grade", "tn", "true_positives", "false_positives", "false_negatives")


@query("SELECT count(*) AS n, round(count(*) FILTER (c_custkey % 5 > 0) / count(*), 6) AS exact FROM customer")
def exact_text_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    wide = F.translate("c_name", "Cu", "Ｃｕ")  # compatibility forms of the same letters
    read = F.when(k % 5 == 0, F.concat("c_name", F.lit("x"))).when(k % 2 == 0, F.concat(F.lit(" "), F.regexp_replace(wide, "#", " #  "))).otherwise(wide)
    return reports.exact_match_rate(table(spark, sf_dir, "customer").select("c_name", read.alias("read")), "c_name", "read")


@query("SELECT o_orderkey % 100 AS case_id, c.canary_id, c.min_grade <= 2 OR c.min_grade IS NULL OR c.min_grade > 3 AS looked_for FROM orders, (VALUES (1, 1), (2, 2), (3, 3), (4, NULL), (5, 9)) c(canary_id, min_grade) WHERE c.min_grade <= 2 OR c.min_grade IS NULL OR c.min_grade > 3 GROUP BY ALL")
def canaries_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("case_id")).distinct()
    canaries = F.explode(F.array(*(F.struct(F.lit(i).alias("canary_id"), F.lit(g).cast("int").alias("min_grade")) for i, g in ((1, 1), (2, 2), (3, 3), (4, None), (5, 9)))))
    listed = cases.select("case_id", canaries.alias("c")).select("case_id", "c.*")
    return texts.canaries_for_grade(listed, 2).select("case_id", "canary_id", F.lit(True).alias("looked_for"))


# Reports

@query("SELECT bool_and(c_custkey % 50 > 0) AS passed, coalesce(list(c_name ORDER BY c_name) FILTER (c_custkey % 50 = 0), []) AS failed FROM customer")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    checks = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(k % 100 == 0, None).otherwise(k % 50 > 0).alias("passed"))
    return reports.gate(checks)


@query("SELECT o_orderpriority AS code, o_orderstatus AS message, count(*) > 0 AS blocked FROM orders GROUP BY ALL")
def policy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("message"))
    return reports.distinct_blocks(blocks).withColumn("blocked", F.lit(True))


@query("SELECT o_custkey AS key, count(*) AS observations, sha256(arg_max(o_orderkey::VARCHAR, struct_pack(d := o_orderdate, k := o_orderkey)))[:16] AS digest FROM orders GROUP BY o_custkey")
def last_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").cast("string").alias("json"))
    return reports.verification_store(events, "key")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'missing' WHEN c_custkey % 3 = 1 THEN 'changed' END AS drift FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 7 > 0 UNION ALL SELECT c_name, 'unexpected' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 3 > 0")
def version_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, customers = F.col("c_custkey"), table(spark, sf_dir, "customer")
    expected = customers.where(k % 7 > 0).select(F.col("c_name").alias("name"), F.lit("1").alias("value"))
    actual = customers.where(k % 3 > 0).select(F.col("c_name").alias("name"), F.when(k % 3 == 1, "2").otherwise("1").alias("value"))
    return reports.drift(expected, actual)


@query("SELECT o_custkey, count(*) FILTER (n = 1) AS transferred, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n = 0) AS unmatched, 0::BIGINT AS disabled FROM (SELECT a.o_custkey, a.o_orderkey, count(b.o_orderkey) AS n FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_orderkey % 2 = 1 WHERE a.o_orderkey % 2 = 0 GROUP BY ALL) GROUP BY o_custkey")
def transfer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("label"))
    sources = orders.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "source_id").withColumn("value", F.lit("x"))
    targets = orders.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "target_id").withColumn("disabled", F.lit(False))
    return reports.transfer_counts(reports.transfers(sources, targets, ["o_custkey"]), ["o_custkey"])


@query("SELECT c_custkey AS field_id, CASE c_custkey % 3 WHEN 0 THEN 'Pune ' || c_nationkey ELSE 'a' || c_nationkey || '@example.in' END AS value FROM customer WHERE c_custkey % 3 < 2")
def filled_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task of each nation names two fields; its customers are the fields of its page."""
    task = F.concat(F.lit("City is Pune "), "n_nationkey", F.lit(", work email: a"), "n_nationkey", F.lit("@example.in, then submit the form"))
    tasks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), texts.task_fields(task).alias("fields"))
    names = F.array(F.lit("city"), F.lit("workEmail"), F.lit("colour"))
    fields = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("field_id"), F.element_at(names, (F.col("c_custkey") % 3 + 1).cast("int")).alias("name"))
    return reports.filled_fields(tasks, fields, "page").select("field_id", "value")


@query("SELECT n_nationkey AS position, 'e_' || replace(replace(base64(unhex(sha256('page' || chr(1) || n_nationkey)[:36])), '+', '-'), '/', '_') AS id FROM nation")
def element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), texts.element_id(F.lit("page"), F.col("n_nationkey")).alias("id"))


# State machines

@query(
    f"""WITH RECURSIVE e AS (SELECT key, event_id, event_type, value, rn FROM ({ORDERED})),
    s AS (SELECT key, event_id, rn, CASE WHEN event_type = 'error' THEN []::DOUBLE[] ELSE [value] END AS taken, CASE WHEN event_type = 'error' THEN 'released' ELSE 'accepted' END AS decision FROM e WHERE rn = 1
        UNION ALL SELECT e.key, e.event_id, e.rn, CASE WHEN e.event_type = 'error' THEN list_filter(s.taken, lambda t: t <> e.value) WHEN list_contains(s.taken, e.value) THEN s.taken ELSE list_append(s.taken, e.value) END,
            CASE WHEN e.event_type = 'error' THEN 'released' WHEN list_contains(s.taken, e.value) THEN 'duplicate' ELSE 'accepted' END FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1)
    SELECT key, event_id, decision, len(taken)::DOUBLE AS amount FROM s"""
)
def duplicate_action_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "actions")


def _promoted(jobs: str) -> str:
    """Waiting jobs run, in their order, as far as two places are free."""
    return f"list_transform({jobs}, lambda j, i: CASE WHEN j.st = 'queued' AND len(list_filter({jobs}[:i], lambda k: k.st = 'queued')) <= 2 - len(list_filter({jobs}, lambda k: k.st = 'running')) THEN struct_pack(t := j.t, st := 'running') ELSE j END)"


ENDED_JOB = "j.st IN ('succeeded', 'failed')"


@query(
    f"""WITH RECURSIVE e AS ({ORDERED}),
    s AS (SELECT DISTINCT key, NULL::BIGINT AS event_id, 0::BIGINT AS rn, []::STRUCT(t DOUBLE, st VARCHAR)[] AS jobs, NULL::VARCHAR AS decision FROM e
        UNION ALL SELECT key, event_id, rn, {_promoted('y')}, CASE WHEN ends AND p = 0 THEN 'not_found' WHEN ends THEN new_state WHEN len(a) >= 4 AND m IS NULL THEN 'queue_full' ELSE {_promoted('y')}[-1].st END
        FROM (SELECT *, CASE WHEN (ends AND p = 0) OR (NOT ends AND len(a) >= 4 AND m IS NULL) THEN a
                WHEN ends THEN list_transform(a, lambda j, i: CASE WHEN i = p THEN struct_pack(t := ts, st := new_state) ELSE j END)
                ELSE list_append(CASE WHEN len(a) >= 4 THEN list_concat(a[:o - 1], a[o + 1:]) ELSE a END, struct_pack(t := ts, st := 'queued')) END AS y
            FROM (SELECT *, coalesce(list_position(list_transform(a, lambda j: {ENDED_JOB} AND j.t = m), true), 0) AS o
                FROM (SELECT *, event_type IN ('purchase', 'error') AS ends, CASE event_type WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS new_state,
                        coalesce(list_position(list_transform(a, lambda j: j.st = 'running'), true), 0) AS p, list_min(list_transform(list_filter(a, lambda j: {ENDED_JOB}), lambda j: j.t)) AS m
                    FROM (SELECT *, {_promoted('x')} AS a
                        FROM (SELECT e.key, e.event_id, e.rn, e.ts, e.event_type, list_filter(s.jobs, lambda j: e.ts - j.t < 432000) AS x FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1))))))
    SELECT key, event_id, decision, len(jobs)::DOUBLE AS amount FROM s WHERE rn > 0"""
)
def job_table_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "jobs", ttl=432_000.0, cap=4)


@query(
    """WITH RECURSIVE e AS (SELECT event_type AS key, event_id, user_id::DOUBLE AS client, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT DISTINCT key, NULL::BIGINT AS event_id, 0::BIGINT AS rn, []::STRUCT(c DOUBLE, l DOUBLE[])[] AS logs, NULL::VARCHAR AS decision, 0.0::DOUBLE AS amount FROM e
        UNION ALL SELECT key, event_id, rn, CASE WHEN known THEN list_transform(kept, lambda x: CASE WHEN x.c = client THEN struct_pack(c := x.c, l := now_) ELSE x END) ELSE list_append(kept, struct_pack(c := client, l := now_)) END,
            CASE WHEN len(log) >= 3 THEN 'denied' ELSE 'allowed' END, CASE WHEN len(log) >= 3 THEN greatest(1, trunc(log[1] + 172800 - ts + 0.999))::DOUBLE ELSE 0.0 END
        FROM (SELECT *, CASE WHEN len(log) >= 3 THEN log ELSE list_append(log, ts) END AS now_
            FROM (SELECT *, list_filter(coalesce(list_filter(kept, lambda x: x.c = client)[1].l, []), lambda t: t > ts - 172800) AS log
                FROM (SELECT *, CASE WHEN NOT known AND len(logs) >= 8 THEN list_concat(logs[:o - 1], logs[o + 1:]) ELSE logs END AS kept
                    FROM (SELECT *, list_position(list_transform(logs, lambda x: x.l[-1]), list_min(list_transform(logs, lambda x: x.l[-1]))) AS o
                        FROM (SELECT e.key, e.event_id, e.rn, e.ts, e.client, s.logs, len(list_filter(s.logs, lambda x: x.c = e.client)) > 0 AS known FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1))))))
    SELECT key, event_id, decision, amount FROM s WHERE rn > 0"""
)
def client_table_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limiter for all users of an event type in one table of eight clients."""
    events = table(spark, sf_dir, "events").withColumn("value", F.col("user_id"))
    return stateful.decisions(stateful.events_of(events, key="event_type"), "clients", limit=3, window=172_800.0, max_clients=8).drop("ts")


@query(ORACLE_SQL["rate_limit_decisions"])
def distinct_limiter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that counts events of one time once; a user's events have times of their own here."""
    return _decided(spark, sf_dir, "limiter", limit=3, window=172_800.0, distinct=True)


@query(
    f"""WITH RECURSIVE e AS ({ORDERED}),
    s AS (SELECT key, event_id, rn, ts AS began, CASE WHEN event_type = 'drift' THEN 0 ELSE 1 END AS node, 0 AS steps, 'observe' AS decision, 0.0::DOUBLE AS amount FROM e WHERE rn = 1
        UNION ALL SELECT key, event_id, rn, began, CASE WHEN late OR steps >= 30 THEN node ELSE (node + 1) % 5 END, CASE WHEN NOT late AND steps < 30 AND node = 4 THEN steps + 1 ELSE steps END,
            CASE WHEN late THEN 'timed_out' WHEN steps >= 30 THEN 'out_of_steps' ELSE ['observe', 'reason', 'verify', 'dispatch', 'settle'][node + 1] END, (CASE WHEN NOT late AND steps < 30 AND node = 4 THEN steps + 1 ELSE steps END)::DOUBLE
        FROM (SELECT e.key, e.event_id, e.rn, s.began, s.node, s.steps, e.ts - s.began > 864000 AS late FROM s JOIN e ON e.key = s.key AND e.rn = s.rn + 1))
    SELECT key, event_id, decision, amount FROM s"""
)
def agent_loop_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "agent", seconds=864_000.0)


@query("SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE o_orderstatus END AS state, CASE WHEN o_orderstatus = 'P' THEN 'server_restarted' END AS failure FROM orders")
def restarted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(status == "P", "pending").otherwise(status).alias("state"), F.lit(None).cast("string").alias("failure"))
    return stateful.restarted(jobs)


# Plans over forms: the elements of a picture in order, as rows

PICK = "CASE vec_id % 7 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} WHEN 4 THEN {} WHEN 5 THEN {} ELSE {} END"
LABEL = PICK.format(*(f"'{x}'" for x in ("I agree to the terms", "Submit form", "Full name [public] [filled]", "Back", "Continue", "[REDACTED:NAME]", "City [public]")))
ROLE = PICK.format(*(f"'{x}'" for x in ("checkbox", "button", "textbox", "link", "button", "button", "combobox")))
# the words of a label decide: kinds 0, 1 and 4 have a term
FORM = f"""SELECT vec_id // 20 AS picture, vec_id, 'e_' || lpad(vec_id::VARCHAR, 16, '0') AS id, {LABEL} AS label, {ROLE} AS role, vec_id % 3 = 0 AS disabled, vec_id % 4 = 0 AS checked, vec_id % 5 = 0 AS required,
    vec_id % 7 IN (1, 4) AS terminal, vec_id % 7 = 0 AND vec_id % 3 > 0 AND vec_id % 4 > 0 AS pending FROM embeddings"""
ENDED = "'Form action completed; inspect the page result.'"
MANY = "'Safe structural progress is impossible without a unique sanitized control.'"
SUMS = f"""SELECT picture, count(*) FILTER (pending) AS waiting, min(id) FILTER (pending) AS first_waiting, count(*) FILTER (terminal AND NOT disabled) AS submits, min(id) FILTER (terminal AND NOT disabled) AS first_submit,
    count(*) FILTER (terminal AND disabled) AS ended, count(*) FILTER (label LIKE '%[public]%') > 0 AND bool_and(label NOT LIKE '%[public]%' OR label LIKE '%[filled]%') AS complete, max_by(id, vec_id) AS last_id,
    max_by(terminal AND NOT disabled, vec_id) AS last_submits FROM ({FORM}) GROUP BY picture"""
TASK = "picture % 4 IN (0, 1, 3)"  # all tasks but reading have a term


def _plan(spark: SparkSession, sf_dir: str, action: Column) -> DataFrame:
    return _elements(spark, sf_dir).select("picture", action.alias("a")).select("picture", "a.*")


@query(
    f"""SELECT picture, type, CASE type WHEN 'click' THEN CASE WHEN waiting = 1 THEN first_waiting ELSE first_submit END END AS "elementId", CASE type WHEN 'scroll' THEN 'down' END AS direction,
        (CASE type WHEN 'scroll' THEN 450 END)::INTEGER AS amount, (CASE type WHEN 'wait' THEN 400 END)::INTEGER AS milliseconds, CASE type WHEN 'done' THEN {MANY} END AS message
    FROM (SELECT *, CASE WHEN waiting > 1 OR submits > 1 THEN 'done' WHEN waiting = 1 OR submits = 1 THEN 'click' WHEN ended = 1 THEN 'wait' WHEN {TASK} THEN 'scroll' ELSE 'done' END AS type FROM ({SUMS}))"""
)
def structural_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, planners.structural_action(F.col("task"), F.col("elements")))


@query(
    f"""SELECT picture, type, CASE type WHEN 'click' THEN CASE WHEN waiting > 0 THEN first_waiting ELSE first_submit END END AS "elementId", CASE type WHEN 'scroll' THEN 'down' END AS direction,
        (CASE type WHEN 'scroll' THEN 450 END)::INTEGER AS amount, NULL::INTEGER AS milliseconds, NULL::VARCHAR AS message
    FROM (SELECT *, CASE WHEN NOT ({TASK}) THEN NULL WHEN picture % 4 = 1 AND NOT complete THEN NULL WHEN waiting > 0 OR submits = 1 THEN 'click' WHEN submits = 0 THEN 'scroll' END AS type FROM ({SUMS}))"""
)
def form_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, planners.form_action(F.col("task"), F.lit("A page"), F.col("elements")))


ID = "'e_' || lpad({}::VARCHAR, 16, '0')"


@query(
    f"""WITH f AS (SELECT f.*, b.y + b.h / 2 AS centre FROM ({FORM}) f JOIN ({BOXES}) b USING (vec_id)),
    g AS (SELECT f.vec_id, (SELECT max(p.vec_id) FROM f p WHERE p.picture = f.picture AND p.pending AND p.vec_id < f.vec_id AND p.centre <= f.centre + 4) AS pre FROM f),
    s AS (SELECT picture, count(*) FILTER (pending) AS waiting, count(*) FILTER (terminal AND NOT disabled) AS submits, count(*) FILTER (terminal AND disabled) AS ended,
        min(vec_id) FILTER (terminal AND NOT disabled) AS submit, min(vec_id) FILTER (terminal AND disabled) AS stop, max(vec_id) AS last, picture % 4 = 1 AS fill FROM f GROUP BY picture),
    j AS (SELECT s.*, a.pre AS before_last, b.pre AS before_submit, c.pre AS before_stop, l.terminal AND NOT l.disabled AS last_submits, l.pending AS last_pending,
        l.role = 'checkbox' AND l.checked AND NOT l.disabled AND NOT fill AS consent, NOT fill AND submits = 0 AND ended = 1 AS finished
        FROM s JOIN f l ON l.vec_id = s.last JOIN g a ON a.vec_id = s.last LEFT JOIN g b ON b.vec_id = s.submit LEFT JOIN g c ON c.vec_id = s.stop),
    d AS (SELECT picture, CASE WHEN NOT ({TASK}) THEN last WHEN finished AND before_stop IS NOT NULL THEN before_stop WHEN finished AND waiting > 0 THEN last WHEN finished THEN -1
        WHEN last_submits AND before_last IS NOT NULL THEN before_last WHEN last_submits THEN last WHEN consent AND submits = 1 THEN submit WHEN consent AND submits = 0 AND ended = 0 THEN -2
        WHEN NOT fill AND submits = 1 AND last_pending THEN last WHEN NOT fill AND submits = 1 THEN coalesce(before_submit, submit) ELSE last END AS v FROM j)
    SELECT picture, CASE v WHEN -1 THEN 'done' WHEN -2 THEN 'scroll' ELSE 'click' END AS type, CASE WHEN v >= 0 THEN {ID.format('v')} END AS "elementId", CASE v WHEN -2 THEN 'down' END AS direction,
        (CASE v WHEN -2 THEN 450 END)::INTEGER AS amount, NULL::INTEGER AS milliseconds, CASE v WHEN -1 THEN {ENDED} END AS message FROM d"""
)
def guarded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposed action is a click on the last element."""
    return _plan(spark, sf_dir, planners.guarded_action(F.col("task"), F.col("elements"), planners.click(F.element_at("elements", -1)["id"])))


@query(f"SELECT vec_id, bool_or(p.pending) AS has_prerequisite FROM ({FORM}) f LEFT JOIN (SELECT picture, vec_id AS v, pending FROM ({FORM})) p ON p.picture = f.picture AND p.v < f.vec_id AND p.pending WHERE f.terminal GROUP BY vec_id")
def prerequisites_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether anything pending comes before a control, wherever it stands on the page."""
    flat = F.transform("elements", lambda e: e.withField("bounds", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))))
    rows = _elements(spark, sf_dir).withColumn("elements", flat).select("elements", F.explode("elements").alias("e")).where(planners.terminal(F.col("e")))
    found = planners.preceding_prerequisite(F.col("elements"), F.col("e.id"))
    return rows.select(F.substring("e.id", 3, 16).cast("long").alias("vec_id"), F.when(found.isNotNull(), True).alias("has_prerequisite"))


case_query(
    "task_terms",
    "text string",
    {"task": "BOOLEAN", "fill": "BOOLEAN", "done": "BOOLEAN", "prerequisite": "BOOLEAN"},
    [
        ("Please submit it", True, False, False, False),
        ("resubmit", False, False, False, False),
        ("Fill in and Save!", True, True, False, False),
        ("completed-successfully", False, False, True, False),
        ("I certify the above", False, False, False, True),
        ("Terms of use #", False, False, False, True),
        ("confirm", True, False, False, True),
        (None, False, False, False, False),
    ],
    lambda df: dict(zip(("task", "fill", "done", "prerequisite"), (planners.has_term(F.col("text"), t) for t in (planners.TASK_TERMS, planners.FILL_TERMS, planners.COMPLETION_TERMS, planners.PREREQUISITE_TERMS)), strict=True)),
)

_ELEMENT = "struct<id:string,role:string,label:string,bounds:struct<x:double,y:double,width:double,height:double>,state:struct<disabled:boolean,checked:boolean,editable:boolean,required:boolean>>"


def _e(i: int, role: str, label: str, y: float = 0.0, disabled: bool = False, checked: bool = False, required: bool = False) -> tuple:
    return (f"e_{i}", role, label, (0.0, float(y), 10.0, 10.0), (disabled, checked, True, required))


_AGREE, _AGREED, _SUBMIT, _SENT, _OTHER = _e(1, "checkbox", "I agree"), _e(1, "checkbox", "I agree", checked=True), _e(2, "button", "Submit", 50), _e(2, "button", "Submit", 50, True), _e(3, "link", "Help", 90)
case_query(
    "guarded_actions",
    f"task string, type string, element string, message string, elements array<{_ELEMENT}>",
    {"action": "VARCHAR", "target": "VARCHAR"},
    [
        ("Read the page", "click", "e_9", None, [_SUBMIT], "click", "e_9"),
        ("Submit the form", "click", "e_2", None, [_AGREE, _SUBMIT], "click", "e_1"),
        ("Submit the form", "click", "e_2", None, [_AGREED, _SUBMIT], "click", "e_2"),
        ("Submit the form", "click", "e_1", None, [_AGREED, _SUBMIT], "click", "e_2"),
        ("Submit the form", "click", "e_3", None, [_AGREE, _SUBMIT, _OTHER], "click", "e_1"),
        ("Submit the form", "click", "e_3", None, [_SUBMIT, _OTHER], "click", "e_2"),
        ("Submit the form", "click", "e_3", None, [_SENT, _OTHER], "done", None),
        ("Submit the form", "click", "e_3", None, [_AGREE, _SENT, _OTHER], "click", "e_1"),
        ("Submit the form", "done", None, "All good", [_SUBMIT], "click", "e_2"),
        ("Submit the form", "done", None, "Submitted", [_SUBMIT], "done", None),
        ("Submit the form", "click", "e_9", None, [_SUBMIT], "click", "e_9"),
        ("Fill in and submit", "click", "e_3", None, [_SUBMIT, _OTHER], "click", "e_3"),
        ("Submit the form", "click", "e_1", None, [_AGREED, _OTHER], "scroll", None),
    ],
    lambda df: _guarded(df),
)


def _guarded(df: DataFrame) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    proposed = F.struct(F.col("type"), F.col("element").alias("elementId"), none("string").alias("direction"), none("int").alias("amount"), none("int").alias("milliseconds"), F.col("message"))
    action = df.withColumn("p", proposed).select("c_custkey", planners.guarded_action(F.col("task"), F.col("elements"), F.col("p")).alias("a"))
    return action.select("c_custkey", F.col("a.type").alias("action"), F.col("a.elementId").alias("target"))
