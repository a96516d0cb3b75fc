import numpy as np
from pyspark.sql import functions as F

from gradeveil.functions import seams
from gradeveil.functions.geometry import BOUNDS
from gradeveil.operators import reports


def box(x, y, w, h):
    return (float(x), float(y), float(w), float(h))


def test_receipt(spark):
    redactions = spark.createDataFrame([(1, "EMAIL", box(0, 0, 10, 10)), (1, "PHONE", box(5, 0, 10, 10)), (1, "PAN", box(50, 50, 10, 10))], f"k int, kind string, bounds {BOUNDS}")
    images = spark.createDataFrame([(1, bytearray(b"x"), 100, 100), (2, bytearray(b"y"), 100, 100)], "k int, png binary, width int, height int")
    got = {r.k: r for r in reports.receipt(redactions, images, "k").collect()}
    assert (got[1].redactions, got[1].categories, got[1].masked_percent, got[1].covered_percent) == (3, {"contact": 2, "government-id": 1}, 3.0, 2.5)
    assert (got[2].redactions, got[2].categories, got[2].covered_percent) == (0, None, 0.0)


def test_gate_and_rates(spark):
    assert tuple(reports.gate(spark.createDataFrame([("a", True), ("b", None), ("c", False)], "name string, passed boolean")).first()) == (False, ["b", "c"])
    assert reports.gate(spark.createDataFrame([("a", True)], "name string, passed boolean")).first().passed
    rows = spark.createDataFrame([("a b", "ab"), ("ﬁ", "fi"), ("x", "y"), ("", None)], "t string, r string")
    assert tuple(reports.exact_match_rate(rows, "t", "r").first()) == (4, 0.75)


def test_transfers(spark):
    sources = spark.createDataFrame([("t", 1, "Work email", "a@b.c"), ("t", 2, "Phone", "1"), ("t", 3, "City", "X"), ("t", 4, "Name", "N")], "k string, source_id int, label string, value string")
    targets = spark.createDataFrame([("t", 7, "E-mail address", False), ("t", 8, "Mobile", False), ("t", 9, "Telephone number", False), ("t", 6, "Full name", True)], "k string, target_id int, label string, disabled boolean")
    moved = reports.transfers(sources, targets, ["k"])
    assert {r.source_id: (r.target_id, r.status) for r in moved.collect()} == {1: (7, "transferred"), 2: (None, "ambiguous"), 3: (None, "unmatched"), 4: (None, "disabled")}
    assert tuple(reports.transfer_counts(moved, ["k"]).first()) == ("t", 1, 1, 1, 1)


def test_masks(spark):
    r = f"k int, redaction_id int, kind string, source string, bounds {BOUNDS}"
    redactions = spark.createDataFrame([(1, 1, "uninspectable-media", "dom", box(0, 0, 50, 30)), (1, 2, "uninspectable-media", "dom", box(60, 0, 50, 30)), (1, 3, "pii-text", "ocr", box(1, 1, 2, 2)), (1, 4, "face", "onnx", box(61, 1, 5, 5)), (2, 5, "face", "onnx", box(0, 0, 5, 5))], r)
    found = spark.createDataFrame([(1, 9, "pan-card", box(0, 0, 50, 30), 0.9)], f"k int, document_id int, kind string, bounds {BOUNDS}, confidence double")
    secrets = spark.createDataFrame([(1, 9, "pan"), (1, 9, "date-of-birth")], "k int, document_id int, secret string")
    left = lambda grade: {x.redaction_id for x in reports.narrowed_masks(redactions, found, secrets, "k", grade).collect()}
    assert left(2) == {2, 3, 4, 5} and left(3) == {1, 2, 3, 4, 5}
    image = spark.createDataFrame([(1, 200, 100), (2, 200, 100)], "k int, width int, height int")
    assert sorted((x.k, x.kind) for x in reports.fused([redactions], image, "k").collect()) == [(1, "pii-text"), (1, "uninspectable-media"), (1, "uninspectable-media"), (2, "face")]
    whole = redactions.limit(0).unionAll(spark.createDataFrame([(1, 6, "visual-fallback", "fallback", box(0, 0, 200, 100))], r))
    assert sorted((x.k, x.kind) for x in reports.fused([redactions, whole], image, "k").collect()) == [(1, "visual-fallback"), (2, "face")]
    hints = spark.createDataFrame([(1, "pii-text", 5, "Mail", box(1.5, 1, 2, 2)), (1, "pii-text", 4, "First", box(1, 1, 2, 2))], f"k int, kind string, hint_id int, label string, bounds {BOUNDS}")
    assert {x.redaction_id: x.label for x in reports.hinted_redactions(redactions, hints, "k").collect()}[3] == "First"


def test_pixels(spark):
    pixels = spark.createDataFrame([(1, x, y, 0 if x < 2 else 243, 0 if x < 2 else 244, 0 if x < 2 else 246) for x in range(4) for y in range(2)], "k int, x int, y int, r int, g int, b int")
    notes = spark.createDataFrame([(1, 7, box(0, 0, 3, 2), 0, 0, 0)], f"k int, annotation_id int, bounds {BOUNDS}, r int, g int, b int")
    assert tuple(reports.mask_pixels(pixels, notes, "k").first()) == (1, 7, 6, 4, 2, 4)


def test_small_reports(spark):
    rows = spark.createDataFrame([("k", 1, "email"), ("k", 2, "pan"), ("k", 3, "email")], "key string, position int, kind string")
    assert [(r.handle, r.field) for r in reports.handles(rows, "key").orderBy("position").collect()] == [("[EMAIL_1]", "FIELD_1"), ("[PAN_1]", "FIELD_2"), ("[EMAIL_2]", "FIELD_3")]
    df = spark.createDataFrame([("Page changed during capture: x",), ("secret dev@x.in",), (None,)], "m string")
    assert [r[0] for r in df.select(reports.safe_message(F.col("m"))).collect()] == ["Page changed during capture: x", "Local operation failed", "Local operation failed"]
    assert reports.canonical_digest({"b": 1, "a": "é"}) == reports.canonical_digest({"a": "é", "b": 1})
    e, a = (spark.createDataFrame(r, "name string, value string") for r in ([("x", "1"), ("y", "1"), ("z", "1")], [("x", "1"), ("y", "2"), ("w", "1")]))
    assert {r.name: r.drift for r in reports.drift(e, a).collect()} == {"y": "changed", "z": "missing", "w": "unexpected"}
    seen = spark.createDataFrame([("k", 1.0, 1, "a"), ("k", 2.0, 2, "b")], "k string, ts double, event_id long, json string")
    import hashlib

    assert tuple(reports.verification_store(seen, "k").first()) == ("k", 2, hashlib.sha256(b"b").hexdigest()[:16])


class Names:
    def entities(self, text):
        return [{"entity": "PER", "score": 0.9}] if "Ann" in text else []


def test_seams(spark):
    df = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "x"), (4, None)], "id int, t string")
    got = {r.id: r.entities for r in seams.recognised_entities(df, "t", Names).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [1, 1, 0] and got[4] is None
    assert {r.id for r in seams.recognised_entities(df, "t").collect()} == {1, 2, 3, 4}
    assert seams.reasoned(df, "t").first().action is None
    picture = np.full((50, 100, 3), 255, np.uint8)
    tensor, scale, left, top = seams.letterbox(picture, 64)
    assert tensor.shape == (3, 64, 64) and scale == 0.64 and (left, top) == (0.0, 16.0) and tensor[0, 32, 32] == 1.0
    assert seams.normalised(tensor, (0.5,) * 3, (0.5,) * 3).max() == 1.0
