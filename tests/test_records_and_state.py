import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gradeveil.operators import documents, validation
from gradeveil.plans import planners
from gradeveil.sources import readers
from gradeveil.streaming import folds, stateful

ELEMENT = {"id": "e_" + "a" * 16, "role": "button", "label": "Submit", "bounds": {"x": 1.0, "y": 1.0, "width": 5.0, "height": 5.0}, "state": {"disabled": False, "checked": False, "editable": False, "required": False}}
RECORD = {
    "schemaVersion": "1.0",
    "snapshotId": "11111111-1111-4111-8111-111111111111",
    "documentId": "11111111-1111-4111-8111-111111111112",
    "page": {"origin": "https://site-" + "0" * 20 + ".invalid", "title": "A page"},
    "task": "Submit",
    "elements": [ELEMENT],
    "image": {"mime": "image/png", "dataBase64": "iVBORw0KGgoAAAA", "width": 100, "height": 100},
    "redactions": [{"kind": "pii-text", "source": "regex", "bounds": {"x": 0.0, "y": 0.0, "width": 5.0, "height": 5.0}}],
    "privacy": {"detectorBackend": "wasm", "visualFallback": "none", "rawImageRetained": False, "grade": 3},
}


def changed(path, value):
    record = json.loads(json.dumps(RECORD))
    *way, last = path.split(".")
    at = record
    for step in way:
        at = at[int(step)] if step.isdigit() else at[step]
    at[last] = value
    return json.dumps(record)


def violations(spark, text, profile="server"):
    df = validation.parsed(spark.createDataFrame([(text,)], "json string"))
    return df.select(validation.observation_violations(F.col("json"), F.col("obs"), profile)).first()[0]


RECORDS = [
    (json.dumps(RECORD), []),
    (changed("privacy.grade", 4), ["grade"]),
    (changed("privacy.grade", 1.0), ["grade"]),
    (changed("privacy.grade", "1"), ["grade"]),
    (changed("privacy.grade", True), ["grade"]),
    (changed("extra", 1), ["unknown_field"]),
    (changed("page.origin", "https://example.com"), ["origin_alias"]),
    (changed("elements", [ELEMENT, ELEMENT]), ["repeated_element_id"]),
    (changed("elements.0.role", "menu"), ["element_shape"]),
    (changed("privacy.rawImageRetained", True), ["raw_image_retained"]),
    (changed("privacy.detectorBackend", "missing"), ["detector_needs_full_mask"]),
    (changed("task", " "), ["task_length"]),
    (changed("redactions.0.bounds", {"x": 90.0, "y": 0.0, "width": 20.0, "height": 5.0}), ["redaction_bounds"]),
]


@pytest.mark.parametrize("text,expected", RECORDS)
def test_observations(spark, text, expected):
    assert violations(spark, text) == expected


def test_profiles_differ(spark):
    without = json.loads(json.dumps(RECORD))
    del without["privacy"]["grade"]
    assert violations(spark, json.dumps(without), "server") == []
    assert violations(spark, json.dumps(without), "client") == ["grade"]
    assert violations(spark, changed("elements.0.bounds.x", 1.5), "verifier") == ["integer_bounds"]
    assert violations(spark, changed("redactions.0.confidence", 0.5), "verifier") == ["confidence_refused"]
    assert "not_json" in violations(spark, "{", "server") and "not_json" in violations(spark, None, "server")


def test_semantic_rejection(spark):
    rows = [json.dumps(RECORD), changed("page.title", "Mail dev@example.in"), changed("elements.0.bounds", {"x": 99.0, "y": 0.0, "width": 5.0, "height": 5.0}), changed("elements.0.label", "[REDACTED:EMAIL]")]
    df = validation.parsed(spark.createDataFrame([(r,) for r in rows], "json string"))
    assert [r.rejection for r in validation.semantic_rejection(df, 2).collect()] == [None, "unredacted_pii_detected", "bounds_outside_image", None]


ACTION = "type string, elementId string, text string, option string, direction string, amount int, milliseconds int, message string"


def test_actions(spark):
    rows = [("click", "e", *[None] * 6), ("click", *[None] * 7), ("wait", "e", None, None, None, None, 400, None), ("dance", *[None] * 7), ("scroll", None, None, None, "down", 9000, None, None), ("done", *[None] * 6, "ok")]
    df = spark.createDataFrame(rows, ACTION).select(F.struct("*").alias("a"))
    assert [r[0] for r in df.select(validation.action_shape(F.col("a"))).collect()] == [None, "missing", "extra", "unknown_type", "range", None]


def test_actions_against_elements(spark):
    box = dict(ELEMENT, id="e_" + "b" * 16, role="textbox", state={**ELEMENT["state"], "editable": True})
    off = dict(ELEMENT, id="e_" + "c" * 16, state={**ELEMENT["state"], "disabled": True})
    actions = [("click", ELEMENT["id"], None), ("click", "e_none", None), ("click", off["id"], None), ("input", ELEMENT["id"], "x"), ("input", box["id"], "x"), ("input", box["id"], "dev@example.in"), ("check", box["id"], None)]
    df = spark.createDataFrame([(json.dumps([ELEMENT, box, off]), (t, e, x, *[None] * 5)) for t, e, x in actions], f"es string, a struct<{ACTION.replace(' ', ':').replace(',:', ',')}>")
    df = df.withColumn("e", F.from_json("es", f"array<{validation.ELEMENT}>"))
    got = [r[0] for r in df.select(validation.action_against_observation(F.col("a"), F.col("e"), F.lit(True), 2)).collect()]
    assert got == [None, "unknown_element", "disabled_element", "not_editable", None, "private_text", "not_a_checkbox"]


def test_admission_and_endpoints(spark):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    post, kind = F.lit("POST"), F.lit("application/json; charset=utf-8")
    got = spark.range(1).select(
        validation.admission(yes, yes, post, yes, kind, F.lit(10)),
        validation.admission(none, yes, post, yes, kind, F.lit(10)),
        validation.admission(yes, no, F.lit("GET"), yes, kind, F.lit(10)),
        validation.admission(yes, yes, F.lit("GET"), no, kind, F.lit(10)),
        validation.admission(yes, yes, post, no, kind, F.lit(10)),
        validation.admission(yes, yes, post, yes, F.lit("text/plain"), F.lit(10)),
        validation.admission(yes, yes, post, yes, kind, F.lit(10**8)),
    )
    assert list(got.first()) == [200, 403, 401, 405, 429, 415, 413]
    urls = [("https://a.example/v1/reason", []), ("http://127.0.0.1:8000/v1/reason", []), ("http://a.example/v1/reason", ["insecure"]), ("https://u:p@a.example/v1/reason", ["credentials_query_or_fragment"]), ("https://a.example/x?q=1", ["credentials_query_or_fragment", "path"])]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(validation.endpoint_violations(F.col("u"))).collect()] == [v for _, v in urls]


def png(width, height, pixels, kinds):
    """A PNG of RGB rows, each with a filter type."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    raw, above = b"", [0] * width * 3
    for y, kind in enumerate(kinds):
        row = [c for p in pixels[y * width : (y + 1) * width] for c in p]
        out = []
        for i, v in enumerate(row):
            left, up, corner = (row[i - 3] if i >= 3 else 0), above[i], (above[i - 3] if i >= 3 else 0)
            paeth = min((left, up, corner), key=lambda c: (abs(left + up - corner - c), (left, up, corner).index(c)))
            out.append((v - {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]) % 256)
        raw += bytes([kind, *out])
        above = row
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return readers.PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png(spark):
    pixels = [((x * 37 + y * 11) % 256, (x * y) % 256, 250 - x) for y in range(5) for x in range(4)]
    data = png(4, 5, pixels, [0, 1, 2, 3, 4])
    assert [tuple(p) for p in readers.decode_png(data).reshape(-1, 3).tolist()] == pixels
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-3])), (3, None)], "id int, png binary")
    rows = readers.pictures_to_pixels(df, "id").collect()
    assert sum(r.id == 1 for r in rows) == 20 and {r.id for r in rows if r.error} == {2, 3}
    black = png(4, 5, [(0, 0, 0)] * 20, [0] * 5)
    shown = readers.pictures_to_pixels(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(black))], "id int, png binary"), "id")
    masks = spark.createDataFrame([(i, m, (0.0, 0.0, 4.0, 5.0)) for i, m in ((1, 1), (2, 2))], f"id int, mask_id int, bounds {validation.RECT}")
    assert [r.mask_id for r in validation.masks_violations(masks, shown, masks, "id").collect()] == [1]


def events(*rows):
    return [(float(t), kind, float(v)) for t, kind, v in rows]


def run(fold, rows, **parameters):
    state = folds.new(fold, parameters)
    return [state.step(*r)["decision"] for r in rows]


def test_folds():
    assert run("limiter", events((0, "", 0), (1, "", 0), (2, "", 0), (3, "", 0), (61, "", 0)), limit=2, window=60) == ["allowed", "allowed", "denied", "denied", "allowed"]
    assert folds.new("limiter", {"limit": 1, "window": 10}).step(0, "", 0)["amount"] == 0
    errors = [(t, "error", 0) for t in (0, 1, 2)]
    assert run("breaker", events(*errors, (3, "click", 0), (33, "error", 0), (34, "click", 0), (64, "click", 0), (65, "click", 0))) == ["called", "called", "called", "open", "probe", "open", "probe", "called"]
    gate = folds.new("gate", {})
    assert [round(gate.step(t, "", 0)["amount"], 3) for t in (1.0, 1.0, 1.1)] == [0.0, 0.55, 1.0]
    assert run("jobs", events((0, "a", 0), (1, "a", 0), (2, "a", 0), (3, "purchase", 0), (4, "a", 0), (5, "a", 0), (400, "a", 0)), cap=3) == ["running", "running", "queued", "succeeded", "queued", "queue_full", "running"]
    assert run("actions", events((0, "a", 1), (1, "a", 1), (2, "error", 1), (3, "a", 1))) == ["accepted", "duplicate", "released", "accepted"]
    assert run("agent", events(*((t, "go", 0) for t in range(6)), (6, "drift", 0), (400, "go", 0))) == ["observe", "reason", "verify", "dispatch", "settle", "observe", "observe", "timed_out"]

    # waiting jobs run when one ends, well or not, and forgotten keys are free again
    assert run("jobs", events((0, "a", 0), (1, "a", 0), (2, "a", 0), (3, "error", 0), (4, "purchase", 0), (5, "purchase", 0), (6, "purchase", 0)), cap=9) == ["running", "running", "queued", "failed", "succeeded", "succeeded", "not_found"]
    assert run("actions", events((0, "a", 1), (5, "a", 1), (10, "a", 1)), ttl=10.0) == ["accepted", "duplicate", "accepted"]
    # client 1 is the oldest of two when client 3 comes, and begins anew
    assert run("clients", events((0, "a", 1), (1, "a", 2), (2, "a", 2), (3, "a", 3), (4, "a", 1), (5, "a", 1)), limit=1, max_clients=2) == ["allowed", "allowed", "denied", "allowed", "allowed", "denied"]


EVENTS = "key string, event_id long, ts double, event_type string, value double"


def test_batch_folds_by_key(spark):
    rows = [(k, i, float(i), "a", 0.0) for k in "xy" for i in range(5)] + [("x", 99, None, "a", 0.0)]
    df = spark.createDataFrame(rows, EVENTS)
    got = {(r.key, r.event_id): r.decision for r in stateful.decisions(df, "limiter", limit=2, window=3.0).collect()}
    assert got == {("x", 99): "no_time", **{(k, i): d for k in "xy" for i, d in enumerate(["allowed", "allowed", "denied", "allowed", "allowed"])}}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, float(i), "error" if i % 3 else "a", 0.0) for k in "xyz" for i in range(20)]
    for n in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 10 == n], EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    batch = {tuple(r) for r in stateful.decisions(spark.createDataFrame(rows, EVENTS), "breaker", threshold=2, open_seconds=4.0).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    q = stateful.decision_stream(stream, "breaker", threshold=2, open_seconds=4.0).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("decided").collect()} == batch


def test_sessions_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([("k", i, t, "a", 0.0) for i, t in enumerate([0.0, 0.1, 0.2, 1.0, 1.3, 1.66])], EVENTS)
    got = stateful.sessions(df).orderBy("start").collect()
    assert [(r.start, r.end, r.events) for r in got] == [(0.0, 0.2, 3), (1.0, 1.3, 2), (1.66, 1.66, 1)]
    path = str(tmp_path / "ledger")
    for state, at in (("pending", 1.0), ("completed", 2.0)):
        readers.append_jobs(spark.createDataFrame([("j1", "s", state, None, None, at)], readers.LEDGER), path)
    readers.append_jobs(spark.createDataFrame([("j2", "s", "pending", None, None, 3.0)], readers.LEDGER), path)
    assert readers.job(spark, path, "j1").first().state == "completed"
    after = {r.job_id: (r.state, r.failure) for r in stateful.restarted(readers.current_jobs(spark, path)).collect()}
    assert after == {"j1": ("completed", None), "j2": ("failed", "server_restarted")}
    assert readers.retained(readers.current_jobs(spark, path), 86_402.5).count() == 1


def form(spark, task, *elements, title="A page", action=None):
    df = spark.createDataFrame([(task, title, json.dumps(elements), action or (None,) * 6)], f"task string, title string, es string, action {planners.ACTION}")
    return df.withColumn("e", F.from_json("es", f"array<{validation.ELEMENT}>"))


def element(id_, role="button", label="Submit", y=0.0, **state):
    return {"id": id_, "role": role, "label": label, "bounds": {"x": 0.0, "y": y, "width": 10.0, "height": 10.0}, "state": {**ELEMENT["state"], **state}}


def test_form_plans(spark):
    plan = lambda *a, **k: form(spark, *a, **k).select(planners.form_action(F.col("task"), F.col("title"), F.col("e")).alias("a")).first().a
    consent, submit = element("c", "checkbox", "I agree"), element("s")
    assert plan("Read it", submit) is None
    assert plan("Submit it", consent, submit).elementId == "c"
    assert plan("Submit it", element("c", "checkbox", "I agree", checked=True), submit).elementId == "s"
    assert plan("Submit it").type == "scroll"
    assert plan("Submit it", submit, element("t", label="Continue")) is None
    assert plan("Fill in and submit", element("n", "textbox", "Name [public]"), submit) is None
    assert plan("Fill in and submit", element("n", "textbox", "Name [public] [filled]"), submit).elementId == "s"
    assert plan("Submit it", title="Form submitted successfully").type == "done"
    fallback = lambda *a: form(spark, *a).select(planners.structural_action(F.col("task"), F.col("e")).alias("a")).first().a
    assert fallback("Submit", consent, submit).elementId == "c"
    assert fallback("Submit", element("s", disabled=True)).milliseconds == 400
    assert fallback("Submit", submit, element("t")).type == "done" and fallback("Look").type == "done"


def test_guarded_actions(spark):
    def guard(task, action, *elements):
        fields = {"type": None, "elementId": None, "direction": None, "amount": None, "milliseconds": None, "message": None, **action}
        a = form(spark, task, *elements, action=tuple(fields.values())).select(planners.guarded_action(F.col("task"), F.col("e"), F.col("action")).alias("a")).first().a
        return a.type, a.elementId

    consent, submit = element("c", "checkbox", "I agree"), element("s", y=20.0)
    done = element("c", "checkbox", "I agree", checked=True)
    click = lambda e: {"type": "click", "elementId": e}
    assert guard("Read", click("s"), consent, submit) == ("click", "s")
    assert guard("Submit", click("s"), consent, submit) == ("click", "c")
    assert guard("Submit", click("c"), done, submit) == ("click", "s")
    assert guard("Submit", click("c"), done) == ("scroll", None)
    assert guard("Submit", click("x"), submit) == ("click", "x")
    assert guard("Submit", click("l"), element("l", "link", "Back"), submit) == ("click", "s")
    assert guard("Submit", click("l"), element("l", "link", "Back"), element("s", disabled=True)) == ("done", None)
    assert guard("Submit", {"type": "done"}, submit) == ("click", "s")
    assert guard("Submit", {"type": "done", "message": "Submitted"}, submit) == ("done", None)
    assert guard("Submit", {"type": "select", "elementId": "b"}, element("b", "combobox", "City [filled]"), submit) == ("click", "s")


def test_serving_route(spark):
    t, f = F.lit(True), F.lit(False)
    route = lambda *a: planners.serving_route(*a)
    got = spark.range(1).select(route(t, f, t, t, f, F.lit("ok"), t), route(f, t, t, t, f, F.lit("ok"), t), route(t, f, t, t, f, F.lit("timeout"), t), route(t, f, f, t, f, F.lit("invalid"), t), route(t, f, t, t, f, F.lit("ok"), f)).first()
    assert list(got) == ["model", "503", "structural", "502", "502"]


def line(text, y, x=110.0, confidence=0.95):
    return {"text": text, "confidence": confidence, "x": x, "y": float(y), "width": 200.0, "height": 16.0, "words": []}


LINE = "struct<text:string,confidence:double,x:double,y:double,width:double,height:double,words:array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>>"
MEDIA = "struct<x:double,y:double,width:double,height:double,hint:string>"


def secrets(spark, lines, hint=None):
    rows = [(1, [tuple(x.values()) for x in lines], [(100.0, 80.0, 420.0, 250.0, hint)])]
    row = documents.classify_documents(spark.createDataFrame(rows, f"id long, lines array<{LINE}>, media array<{MEDIA}>")).first()
    return [d.kind for d in row.documents], {s.secret for s in row.secrets}


def test_documents(spark):
    card = [line("VISA CREDIT CARD", 100), line("4111 1111 1111 1111", 150), line("VALID THRU 08/29", 190), line("SECURITY CODE 123", 220)]
    assert secrets(spark, card) == (["credit-card"], {"card-number", "expiry", "cvv"})
    assert secrets(spark, card[:3]) == ([], set())
    pan = [line("INCOME TAX DEPARTMENT", 100), line("ABCDE1234F", 130), line("Name: Ananya Demo", 160), line("Date of Birth: 14/08/1998", 190)]
    assert secrets(spark, pan) == (["pan-card"], {"pan", "name", "date-of-birth"})
    aadhaar = [line("Unique Identification", 100), line("1234 5678 9012", 130), line("Gender: F", 160)]
    assert secrets(spark, aadhaar) == (["aadhaar-card"], {"aadhaar-number", "gender"})
    assert secrets(spark, [line("a photo", 100)]) == ([], set())
    assert documents.covered("pan-card", ["pan"], 1) and not documents.covered("pan-card", ["pan"], 2)


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": "x"}')
    assert readers.json_objects(spark, str(tmp_path / "a.json"), "a long, b string").first().a == 1
    report = tmp_path / "r.json"
    readers.write_report(spark.createDataFrame([(2, 1)], "b int, a int"), str(report))
    assert report.read_text() == '{\n  "a": 1,\n  "b": 2\n}\n'
    (tmp_path / "junit.xml").write_text('<testsuites><testsuite tests="5" failures="1" errors="0" skipped="2"/><testsuite tests="3" failures="0" errors="0" skipped="0"/></testsuites>')
    assert tuple(readers.test_counts(spark, str(tmp_path / "junit.xml")).first()) == (8, 1, 0, 2)
    (tmp_path / "lock.json").write_text('{"packages": {"": {"version": "1"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}}}')
    assert [tuple(r) for r in readers.lock_components(spark, str(tmp_path / "lock.json")).collect()] == [("@s/b", "2.0.0")]
    (tmp_path / "p.toml").write_text('[project]\ndependencies = [\n  "fast[all]>=1.2",\n  "plain"\n]\n')
    assert sorted(tuple(r) for r in readers.project_components(spark, str(tmp_path / "p.toml")).collect()) == [("fast", ">=1.2"), ("plain", "")]
    files = spark.createDataFrame([("x", "AKIA" + "A" * 16), ("y", "nothing")], "path string, text string")
    assert [r.path for r in readers.secret_files(files).collect()] == ["x"]
    digests = readers.file_digests(spark, str(tmp_path / "a.json"))
    locked = digests.select("path", "length", F.lit("0").alias("sha256")).unionAll(spark.createDataFrame([("gone", 1, "0")], "path string, length long, sha256 string"))
    assert sorted(r.error for r in readers.lock_violations(locked, digests).collect()) == ["hash", "missing"]


def test_markup(spark):
    html = '<p>Hello <b>you</b></p><script>var a="<p>no</p>";</script><!-- no --><input type="text" name="q" aria-label="Find"><input type=hidden name=h><a href=\'/x\'>go</a>'
    df = spark.createDataFrame([(1, html)], "id int, html string")
    nodes, over = readers.text_nodes(F.col("html"))
    assert tuple(df.select(nodes, over).first()) == (["Hello", "you", "go"], False)
    controls = readers.interactive_elements(df, "id").collect()
    assert [(r.tag, r.name, r.label) for r in controls] == [("input", "q", "Find"), ("a", None, None)]
    assert df.select(readers.text_regions(nodes, chars=8)).first()[0] == ["Hello", "you"]
