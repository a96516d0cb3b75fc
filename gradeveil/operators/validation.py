"""Constraints on observations, actions, requests and settings: arrays of violated rules, or the first that fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g
from gradeveil.functions.columns import first_match, violations
from gradeveil.operators import texts

# The vocabulary of the wire format.
ROLES = ["button", "link", "textbox", "checkbox", "radio", "combobox", "option", "scroll-region", "other"]
REDACTION_KINDS = ["password", "pii-text", "sensitive-field", "face", "aadhaar-card", "pan-card", "voter-id", "driving-license", "passport", "signature", "canvas-text", "uninspectable-frame", "uninspectable-media", "visual-fallback"]
REDACTION_SOURCES = ["dom", "regex", "onnx", "unified-detector", "dbnet", "ocr", "fallback"]
BACKENDS = ["webgpu", "wasm", "missing", "error"]
FALLBACKS = ["none", "full-mask"]
MODES = ["opaque", "semantic"]
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
ELEMENT_ID = r"^e_[A-Za-z0-9_-]{16,64}$"
ORIGIN_ALIAS = r"^https://site-[0-9a-f]{20}\.invalid$"
PNG_PREFIX = "iVBORw0KGgo"
ACTIONS = {
    "click": ({"elementId"}, {"elementId"}),
    "input": ({"elementId", "text"}, {"elementId", "text"}),
    "scroll": ({"direction", "amount"}, {"elementId", "direction", "amount"}),
    "wait": ({"milliseconds"}, {"milliseconds"}),
    "done": (set(), {"message"}),
    "hover": ({"elementId"}, {"elementId"}),
    "focus": ({"elementId"}, {"elementId"}),
    "doubleClick": ({"elementId"}, {"elementId"}),
    "check": ({"elementId"}, {"elementId"}),
    "uncheck": ({"elementId"}, {"elementId"}),
    "select": ({"elementId", "option"}, {"elementId", "option"}),
}
ACTION_FIELDS = ["elementId", "text", "option", "direction", "amount", "milliseconds", "message"]

RECT = "struct<x:double,y:double,width:double,height:double>"
STATE = "struct<disabled:boolean,checked:boolean,editable:boolean,required:boolean>"
ELEMENT = f"struct<id:string,role:string,label:string,bounds:{RECT},state:{STATE}>"
OBSERVATION = f"""schemaVersion string, snapshotId string, documentId string, page struct<origin:string,title:string>, task string,
    elements array<{ELEMENT}>, image struct<mime:string,dataBase64:string,width:int,height:int>,
    redactions array<struct<kind:string,source:string,bounds:{RECT},confidence:double>>,
    privacy struct<detectorBackend:string,visualFallback:string,rawImageRetained:boolean,grade:int,redactionMode:string,registryDigest:string,detectorArch:string,canvasPrivacyTier:string>"""
TOP_KEYS = ["schemaVersion", "snapshotId", "documentId", "page", "task", "elements", "image", "redactions", "privacy"]
PRIVACY_KEYS = ["detectorBackend", "visualFallback", "rawImageRetained", "grade", "redactionMode", "registryDigest", "detectorArch", "canvasPrivacyTier"]
VERIFIER_PRIVACY_KEYS = ["detectorBackend", "visualFallback", "rawImageRetained", "grade", "redactionMode"]


def parsed(df: DataFrame, json: str = "json", out: str = "obs") -> DataFrame:
    """df with the record that JSON text holds; fields of the wrong type come out null."""
    return df.withColumn(out, F.from_json(json, OBSERVATION, {"mode": "PERMISSIVE"}))


def strict_int(json: Column, path: str, low: int, high: int, required: bool = False) -> Column:
    """Whether the JSON value at a path is an integer literal from low to high: no 1.0, "1", true or null. A missing
    value is fine unless required."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    kind = F.schema_of_variant(value)
    literal = F.regexp_extract(json, rf'"{path.rpartition(".")[2]}"\s*:\s*([^,}}\]\s]+)', 1)
    ok = literal.rlike("^-?[0-9]+$") & kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") & F.try_variant_get(F.try_parse_json(json), path, "long").between(low, high)
    return F.when(value.isNull(), F.lit(not required)).otherwise(F.coalesce(ok, F.lit(False)))


def unknown_keys(json: Column, path: str, allowed: list[str]) -> Column:
    return F.size(F.array_except(F.coalesce(F.json_object_keys(F.get_json_object(json, path)), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))) > 0


def _inside(bounds: Column, image: Column) -> Column:
    return g.valid(bounds) & (bounds["x"] >= 0) & (bounds["y"] >= 0) & (g.right(bounds) <= image["width"]) & (g.bottom(bounds) <= image["height"])


def observation_violations(json: Column, obs: Column, profile: str = "client") -> Column:
    """The codes of all rules that a record violates. client: a grade is required; server: it defaults to 3; verifier:
    bounds are integers, and confidences and registry keys are refused."""
    image, elements, redactions, privacy = obs["image"], obs["elements"], obs["redactions"], obs["privacy"]
    ids = F.transform(elements, lambda e: e["id"])
    label = lambda e: F.length(e["label"]) <= 300
    rules = [
        (json.isNull() | F.try_parse_json(json).isNull(), "not_json"),
        (unknown_keys(json, "$", TOP_KEYS), "unknown_field"),
        (unknown_keys(json, "$.privacy", VERIFIER_PRIVACY_KEYS if profile == "verifier" else PRIVACY_KEYS), "unknown_privacy_field"),
        (obs["schemaVersion"] != "1.0", "schema_version"),
        (~F.lower(obs["snapshotId"]).rlike(UUID), "snapshot_id"),
        (~F.lower(obs["documentId"]).rlike(UUID), "document_id"),
        (~obs["page"]["origin"].rlike(ORIGIN_ALIAS), "origin_alias"),
        (F.length(obs["page"]["title"]) > 300, "title_length"),
        (~F.length(F.trim(obs["task"])).between(1, 2000), "task_length"),
        (F.size(elements) > 500, "too_many_elements"),
        (F.exists(elements, lambda e: ~F.coalesce(e["id"].rlike(ELEMENT_ID), F.lit(False))), "element_id"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "repeated_element_id"),
        (F.exists(elements, lambda e: ~F.coalesce(e["role"].isin(ROLES) & label(e), F.lit(False))), "element_shape"),
        (F.exists(elements, lambda e: ~F.coalesce(_inside(e["bounds"], image), F.lit(False))), "element_bounds"),
        ((image["mime"] != "image/png") | ~image["width"].between(1, 8192) | ~image["height"].between(1, 8192), "image_shape"),
        (~F.startswith(image["dataBase64"], F.lit(PNG_PREFIX)) | ~image["dataBase64"].rlike("^[A-Za-z0-9+/]+={0,2}$") | (F.length(image["dataBase64"]) > 8_000_000), "image_data"),
        (F.size(redactions) > 1000, "too_many_redactions"),
        (F.exists(redactions, lambda r: ~F.coalesce(r["kind"].isin(REDACTION_KINDS), F.lit(False))), "redaction_kind"),
        (F.exists(redactions, lambda r: ~F.coalesce(r["source"].isin(REDACTION_SOURCES), F.lit(False))), "redaction_source"),
        (F.exists(redactions, lambda r: ~F.coalesce(_inside(r["bounds"], image), F.lit(False))), "redaction_bounds"),
        (F.exists(redactions, lambda r: ~F.coalesce(r["confidence"], F.lit(0.0)).between(0, 1)), "confidence"),
        (~privacy["detectorBackend"].isin(BACKENDS), "detector_backend"),
        (~privacy["visualFallback"].isin(FALLBACKS), "visual_fallback"),
        (privacy["detectorBackend"].isin("missing", "error") & (privacy["visualFallback"] != "full-mask"), "detector_needs_full_mask"),
        ((F.coalesce(privacy["redactionMode"], F.lit("opaque")) == "semantic") & (privacy["visualFallback"] != "none"), "semantic_with_full_mask"),
        (privacy["rawImageRetained"], "raw_image_retained"),
        (~F.coalesce(privacy["redactionMode"], F.lit("opaque")).isin(MODES), "redaction_mode"),
        (~strict_int(json, "$.privacy.grade", 1, 3, required=profile == "client"), "grade"),
    ]
    if profile == "verifier":
        whole = lambda b: reduce(lambda a, s: a & (b[s] == F.floor(b[s])), ("x", "y", "width", "height"), F.lit(True))
        rules.append((F.exists(F.concat(F.transform(elements, lambda e: e["bounds"]), F.transform(redactions, lambda r: r["bounds"])), lambda b: ~F.coalesce(whole(b), F.lit(False))), "integer_bounds"))
        rules.append((F.exists(redactions, lambda r: r["confidence"].isNotNull()), "confidence_refused"))
    return violations(rules)


def semantic_rejection(df: DataFrame, grade: int, digest: str | None = None, obs: str = "obs", out: str = "rejection") -> DataFrame:
    """The first semantic rule of the server that a record fails, or null: registry digest, counts, bounds, personal data
    left in texts (task, title, labels)."""
    o = F.col(obs)
    visible = F.filter(F.concat(F.array(o["task"], o["page"]["title"]), F.transform(o["elements"], lambda e: e["label"])), lambda t: t.isNotNull() & (t != ""))
    df = df.withColumn("__visible", visible).withColumn("__folded", texts.for_detection(F.concat_ws("\u0001", "__visible")))
    left = F.exists("__visible", lambda t: texts.floor_hit(t, grade).isNotNull()) | F.exists(F.split("__folded", "\u0001"), lambda t: texts.floor_hit(t, grade).isNotNull())
    rules = [
        (F.coalesce(o["privacy"]["registryDigest"] != digest, F.lit(False)) if digest else F.lit(False), "registry_digest_mismatch"),
        (F.size(o["elements"]) > 500, "too_many_elements"),
        (F.size(o["redactions"]) > 1000, "too_many_redactions"),
        (F.exists(F.concat(F.transform(o["elements"], lambda e: e["bounds"]), F.transform(o["redactions"], lambda r: r["bounds"])), lambda b: ~F.coalesce(_inside(b, o["image"]), F.lit(False))), "bounds_outside_image"),
        (F.coalesce(left, F.lit(True)), "unredacted_pii_detected"),
    ]
    return df.withColumn(out, first_match(rules)).drop("__visible", "__folded")


def action_shape(action: Column) -> Column:
    """What is wrong with an action (struct of type and ACTION_FIELDS): unknown_type, missing, extra, or null."""
    present = F.filter(F.array(*(F.when(action[f].isNotNull(), F.lit(f)) for f in ACTION_FIELDS)), lambda x: x.isNotNull())
    names = lambda s: F.array(*map(F.lit, sorted(s))) if s else F.array().cast("array<string>")
    required = first_match([(action["type"] == t, names(r)) for t, (r, _) in ACTIONS.items()])
    allowed = first_match([(action["type"] == t, names(a)) for t, (_, a) in ACTIONS.items()])
    return first_match(
        [
            (required.isNull(), "unknown_type"),
            (F.size(F.array_except(required, present)) > 0, "missing"),
            (F.size(F.array_except(present, allowed)) > 0, "extra"),
            (F.coalesce(F.length(action["text"]) > 512, F.lit(False)) | F.coalesce(~F.length(action["option"]).between(1, 300), F.lit(False)), "length"),
            (F.coalesce(~action["direction"].isin("up", "down"), F.lit(False)) | F.coalesce(~action["amount"].between(1, 5000), F.lit(False)) | F.coalesce(~action["milliseconds"].between(100, 5000), F.lit(False)), "range"),
        ]
    )


def action_against_observation(action: Column, elements: Column, same_snapshot: Column, grade: int) -> Column:
    """Why an action cannot be done on the elements of its observation, or null."""
    target = F.try_element_at(F.filter(elements, lambda e: e["id"] == action["elementId"]), F.lit(1))
    entered = F.when(action["type"] == "input", action["text"]).when(action["type"] == "select", action["option"])
    role_of = {"scroll": "scroll-region", "check": "checkbox", "uncheck": "checkbox", "select": "combobox"}
    return first_match(
        [
            (~F.coalesce(same_snapshot, F.lit(False)), "stale_snapshot"),
            (action["elementId"].isNull(), F.lit(None).cast("string")),
            (target.isNull(), "unknown_element"),
            (F.coalesce(target["state"]["disabled"], F.lit(False)), "disabled_element"),
            ((action["type"] == "input") & ~F.coalesce(target["state"]["editable"], F.lit(False)), "not_editable"),
            *(((action["type"] == t) & (target["role"] != r), f"not_a_{r}") for t, r in role_of.items()),
            (F.coalesce(texts.floor_hit(entered, grade).isNotNull(), F.lit(False)), "private_text"),
            (F.coalesce(texts.floor_hit(texts.for_detection(entered, compatibility=False), grade).isNotNull(), F.lit(False)), "private_text"),
        ]
    )


def admission(origin_ok: Column, key_ok: Column, method: Column, rate_ok: Column, content_type: Column, size: Column, max_size: int = 8_000_000) -> Column:
    """The status of a request; the first failing test decides, unknown counts as failing."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return first_match(
        [
            (no(origin_ok), F.lit(403)),
            (no(key_ok), F.lit(401)),
            (no(method == "POST"), F.lit(405)),
            (no(rate_ok), F.lit(429)),
            (no(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))) == "application/json"), F.lit(415)),
            (no(size <= max_size), F.lit(413)),
        ],
        F.lit(200),
    )


def endpoint_violations(url: Column, local_hosts: tuple[str, ...] = ("localhost", "127.0.0.1", "[::1]"), path: str = "/v1/reason") -> Column:
    """Rules on a reasoning endpoint: HTTPS but for the local host, no credentials, query or fragment, and its path."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return violations(
        [
            (part("HOST").isNull(), "not_a_url"),
            (part("USERINFO").isNotNull() | part("QUERY").isNotNull() | part("REF").isNotNull(), "credentials_query_or_fragment"),
            (~((part("PROTOCOL") == "https") | ((part("PROTOCOL") == "http") & part("HOST").isin(*local_hosts))), "insecure"),
            (~F.endswith(part("PATH"), F.lit(path)), "path"),
        ]
    )


def origin_allowed(origin: Column, exact: list[str], patterns: list[str] = []) -> Column:  # noqa: B006
    return F.coalesce(reduce(lambda a, p: a | origin.rlike(f"^(?:{p})$"), patterns, origin.isin(exact)), F.lit(False))


def settings_violations(s: Column) -> Column:
    """Rules on a deployment's settings (struct of adapter, gateway_url, gateway_key, model_digest, require_key, api_key,
    model_url, allow_remote, profile, fallback, ledger_url)."""
    url = lambda c, p: F.try_parse_url(c, F.lit(p))
    local = lambda c: F.coalesce(url(c, "HOST").rlike(r"^(?:localhost|127(?:\.\d{1,3}){3}|\[?::1\]?)$"), F.lit(False))
    gateway, g_url = s["adapter"] == "gateway", s["gateway_url"]
    plain = url(g_url, "HOST").isNotNull() & url(g_url, "USERINFO").isNull() & url(g_url, "QUERY").isNull() & url(g_url, "REF").isNull() & F.coalesce(url(g_url, "PATH"), F.lit("")).isin("", "/")
    production = s["profile"] == "production"
    no = lambda c: F.coalesce(c, F.lit(False))
    return violations(
        [
            (no(gateway & ~(no(plain) & (no(url(g_url, "PROTOCOL") == "https") | (no(url(g_url, "PROTOCOL") == "http") & local(g_url))))), "gateway_url"),
            (no(gateway & ~local(g_url) & s["gateway_key"].isNull()), "gateway_key"),
            (no(gateway & s["model_digest"].isNull()), "gateway_model_digest"),
            (no(s["require_key"] & s["api_key"].isNull()), "api_key"),
            (~local(s["model_url"]) & ~no(s["allow_remote"]), "remote_model"),
            (no(production & s["model_digest"].isNull()), "model_digest"),
            (no(production & s["fallback"]), "structural_fallback"),
            (no(production & s["ledger_url"].isNull()), "ledger"),
        ]
    )


CAPTURE = "type string, requestId string, screenshot string, canaries array<string>, task string, dom struct<elements:array<variant>,redactions:array<variant>,viewport:struct<width:double,height:double>>"


def capture_request_valid(json: Column) -> Column:
    """Whether JSON text is a request to sanitise a capture: its type and id, a PNG data URL, flags that are booleans, a
    grade, at most 100 planted values of 500 characters, a task of 2000, and a page with a viewport."""
    r = F.from_json(json, CAPTURE)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))
    flag = lambda path, required: (kind(path) == "BOOLEAN") if required else F.coalesce(kind(path), F.lit("BOOLEAN")) == "BOOLEAN"
    tests = [
        r["type"] == "SANITIZE_CAPTURE",
        r["requestId"].rlike(UUID),
        F.startswith(r["screenshot"], F.lit("data:image/png;base64,")),
        F.length(r["screenshot"]) <= 16_000_022,
        flag("$.allowFullMaskFallback", True),
        flag("$.highAssuranceMode", False),
        strict_int(json, "$.privacyGrade", 1, 3, required=True),
        (F.size(r["canaries"]) <= 100) & F.forall(r["canaries"], lambda c: F.coalesce(F.length(c) <= 500, F.lit(False))),
        F.coalesce(F.length(r["task"]), F.lit(0)) <= 2000,
        r["dom"]["elements"].isNotNull() & r["dom"]["redactions"].isNotNull(),
        (r["dom"]["viewport"]["width"] > 0) & (r["dom"]["viewport"]["height"] > 0),
    ]
    return F.coalesce(reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), tests), F.lit(False))


def client_settings_valid(s: Column) -> Column:
    """Whether a person's settings (struct of task, max_steps, api_key, grade, allow_transfer, source_tab, canaries) hold."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        no(F.length(F.trim(s["task"])) > 0)
        & no(F.length(s["task"]) <= 2000)
        & no(s["max_steps"].between(1, 30))
        & no(F.length(s["api_key"]) <= 1000)
        & no(s["grade"].between(1, 3))
        & (s["source_tab"].isNull() | (s["source_tab"] >= 0))
        & ~(no(s["allow_transfer"]) & s["source_tab"].isNull())
        & no((F.size(s["canaries"]) <= 100) & F.forall(s["canaries"], lambda c: no(F.length(c) <= 500)))
    )


def masks_violations(df: DataFrame, pixels: DataFrame, masks: DataFrame, key: str, background: tuple[int, int, int] = (243, 244, 246)) -> DataFrame:
    """Masks (key, mask_id, bounds) whose pixels (key, x, y, r, g, b) are neither all black nor have a corner of the
    placeholder's background."""
    inside = pixels.join(masks, key).where((F.col("x") >= F.floor("bounds.x")) & (F.col("x") < F.ceil(g.right(F.col("bounds")))) & (F.col("y") >= F.floor("bounds.y")) & (F.col("y") < F.ceil(g.bottom(F.col("bounds")))))
    corner = ((F.col("x") == F.floor("bounds.x")) | (F.col("x") == F.ceil(g.right(F.col("bounds"))) - 1)) & ((F.col("y") == F.floor("bounds.y")) | (F.col("y") == F.ceil(g.bottom(F.col("bounds"))) - 1))
    is_background = (F.col("r") == background[0]) & (F.col("g") == background[1]) & (F.col("b") == background[2])
    sums = inside.groupBy(key, "mask_id").agg(F.max(F.greatest("r", "g", "b")).alias("brightest"), F.count_if(corner & is_background).alias("corners"))
    good = sums.where("brightest = 0 or corners > 0").select(key, "mask_id")
    return masks.join(good, [key, "mask_id"], "left_anti").select(key, "mask_id", F.lit("mask_not_applied").alias("error"))


def context_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
