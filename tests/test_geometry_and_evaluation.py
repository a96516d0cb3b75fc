import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g
from gradeveil.operators import boxes, evaluation

BOX = "struct<x:double,y:double,width:double,height:double>"
TRUTH = f"case_id string, annotation_id string, kind string, bounds {BOX}, source_ref string, field string"
PREDICTION = f"case_id string, detection_id string, kind string, wildcard boolean, bounds {BOX}, source_ref string, field string"


def box(x, y, w, h):
    return (float(x), float(y), float(w), float(h))


def test_golden_case(spark):
    truths = spark.createDataFrame([("c", "t1", "EMAIL", box(0, 0, 10, 10), None, None), ("c", "t2", "PAN", None, "pan-input", "attributes.data-pan")], TRUTH)
    predictions = spark.createDataFrame([("c", "d1", "EMAIL", False, box(0, 0, 10, 10), None, None), ("c", "d2", "PAN", False, None, "pan-input", "attributes.data-pan"), ("c", "d3", "INDIAN_PHONE", False, box(50, 50, 5, 5), None, None)], PREDICTION)
    matches = evaluation.maximum_matching(evaluation.candidate_matches(truths, predictions))
    assert tuple(evaluation.detection_metrics(truths, predictions, matches).first()) == (2, 1, 0, 0.666667, 1.0, 0.8)
    kinds = {r.kind: (r.true_positives, r.false_positives) for r in evaluation.detection_metrics(truths, predictions, matches, True).collect()}
    assert kinds == {"EMAIL": (1, 0), "PAN": (1, 0), "INDIAN_PHONE": (0, 1)}
    macro = evaluation.macro(evaluation.detection_metrics(truths, predictions, matches, True)).first()
    assert tuple(macro) == (0.666667, 1.0, 1.0)
    redactions = spark.createDataFrame([("c", box(0, 0, 12, 12))], f"case_id string, bounds {BOX}")
    pixels = evaluation.redaction_pixels(truths.select("case_id", "bounds"), redactions).first()
    assert tuple(pixels) == (100.0, 144.0, 100.0, 0.0, 44.0, 1.0, 0.694444, 0.305556)
    wild = predictions.limit(0).unionAll(spark.createDataFrame([("c", "r1", "pii-text", True, box(0, 0, 12, 12), None, None)], PREDICTION))
    one = evaluation.maximum_matching(evaluation.candidate_matches(truths, wild))
    assert tuple(evaluation.detection_metrics(truths, wild, one).first())[:3] == (1, 0, 1)


def test_nothing_observed(spark):
    truths, predictions = spark.createDataFrame([], TRUTH), spark.createDataFrame([], PREDICTION)
    matches = evaluation.maximum_matching(evaluation.candidate_matches(truths, predictions))
    assert tuple(evaluation.detection_metrics(truths, predictions, matches).first()) == (0, 0, 0, None, None, None)


def test_matching_is_maximum():
    pick = random.Random(1)

    def size(edges):
        owner = {}

        def assign(d, seen):
            for t in edges[d]:
                if t not in seen:
                    seen.add(t)
                    if t not in owner or assign(owner[t], seen):
                        owner[t] = d
                        return True
            return False

        return sum(assign(d, set()) for d in edges)

    for _ in range(200):
        edges = {f"d{i}": [f"t{j}" for j in range(6) if pick.random() < 0.3] for i in range(6)}
        found = evaluation._augment(edges)
        assert len(found) == size(edges) == len(set(found.values()))
        assert all(t in edges[d] for t, d in found.items())
    chain = {f"d{i:05}": [f"t{i:05}", f"t{i + 1:05}"] for i in range(3000)} | {"e": ["t00000"]}
    assert len(evaluation._augment(chain)) == 3001


def test_union_area(spark):
    two = spark.createDataFrame([("a", box(0, 0, 10, 10)), ("a", box(5, 0, 10, 10)), ("a", box(0, 0, 0, 9)), ("a", None)], f"k string, bounds {BOX}")
    assert boxes.union_area(two, ["k"]).first().union_area == 150
    pick = random.Random(2)
    rows = [(k, box(pick.randint(0, 20), pick.randint(0, 20), pick.randint(1, 9), pick.randint(1, 9))) for k in "xyz" for _ in range(12)]
    cells = {k: len({(x, y) for kk, (bx, by, w, h) in rows if kk == k for x in range(int(bx), int(bx + w)) for y in range(int(by), int(by + h))}) for k in "xyz"}
    got = boxes.union_area(spark.createDataFrame(rows, f"k string, bounds {BOX}"), ["k"]).collect()
    assert {r.k: r.union_area for r in got} == cells


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rect(*v):
    return g.rect(*(F.lit(float(x)) for x in v))


def test_functions(spark):
    a, b = rect(0, 0, 10, 10), rect(5, 5, 10, 10)
    iou, ratio, inside, same, whole = one(spark, g.iou(a, b), g.overlap_ratio(a, b), g.contains(rect(0, 0, 20, 20), b), g.same_scaled(rect(0, 0, 1000, 10), rect(1.9, 0, 1000, 10)), g.covers_whole(rect(1, 1, 98, 98), F.lit(100), F.lit(100)))
    assert 0.1 < iou < 0.3 and ratio == 0.25 and inside and same and whole
    w, h = F.lit(100.0), F.lit(100.0)
    assert [tuple(r) for r in one(spark, g.padded(rect(10, 10, 100, 10), w, h), g.tightly_padded(rect(10, 10, 40, 50), w, h), g.integer_mask(rect(1.5, 1.5, 2, 2), w, h), g.semantic_mask(rect(0, 0, 5, 5), w, h))] == [
        (0.0, 6.0, 100.0, 18.0),
        (8.0, 7.0, 44.0, 56.0),
        (1.0, 1.0, 3.0, 3.0),
        (0.0, 0.0, 8.0, 8.0),
    ]
    assert tuple(one(spark, g.value_after_label(rect(0, 0, 100, 10), F.lit("Name: Ann"), F.lit(6)))[0]) == (pytest.approx(66.67, abs=0.01), 0.0, pytest.approx(33.33, abs=0.01), 10.0)
    assert one(spark, g.resize_budget(F.lit(1920), F.lit(480)))[0] == 0.5 and one(spark, g.resize_budget(F.lit(100), F.lit(100)))[0] == 1.0


def test_arrays_of_boxes(spark):
    df = spark.createDataFrame([([box(0, 0, 10, 10), box(20, 20, 5, 5), box(10, 10, 4, 4), box(0, 0, 0, 3), box(0.2, 0, 10, 10)],)], f"b array<{BOX}>")
    row = df.select(g.merged(F.col("b")).alias("m"), g.distinct_boxes(F.col("b")).alias("d"), g.masked_percent(F.col("b"), F.lit(100), F.lit(10)).alias("p")).first()
    assert [tuple(x) for x in row.m] == [box(0, 0, 14, 14), box(20, 20, 5, 5)] and len(row.d) == 4 and row.p == 24.0
    found = spark.createDataFrame([([(box(0, 0, 10, 10), 0.9), (box(1, 1, 10, 10), 0.8), (box(50, 50, 10, 10), 0.95)],)], f"d array<struct<bounds:{BOX},score:double>>")
    assert [x.score for x in found.select(g.suppressed(F.col("d"), 0.5).alias("k")).first().k] == [0.95, 0.9]


def test_decoders(spark):
    tensors = spark.createDataFrame([(1, [[5.0, 5.0, 10.0, 10.0, 0.9, 0.1], [5.5, 5.0, 10.0, 10.0, 0.6, 0.2], [50.0, 50.0, 10.0, 10.0, 0.1, 0.8], [80.0, 5.0, 4.0, 4.0, 0.2, 0.1]])], "id int, boxes array<array<double>>")
    assert [d.label for d in boxes.decode_yolo(tensors, ["face", "passport"]).first().detections] == ["face", "passport"]
    corners = spark.createDataFrame([([[0.1, 0.1, 0.2, 0.2], [0.5, 0.5, 0.6, 0.7], [0.9, 0.9, 0.8, 0.95], [0.0, 0.0, 0.1, 0.1]], [0.9, 0.8, 0.99, 0.1])], "c array<array<double>>, s array<double>")
    kept = corners.select(boxes.decode_corners(F.col("c"), F.col("s"), F.lit(1000.0), F.lit(500.0)).alias("k")).first().k
    assert [tuple(round(v, 6) for v in k.bounds) for k in kept] == [(100.0, 50.0, 100.0, 50.0), (500.0, 250.0, 100.0, 100.0)]


def test_regions(spark):
    width, height = 20, 12
    values = [0.9 if (2 <= x < 10 and 1 <= y < 10) or (15 <= x and y < 2) else 0.0 for y in range(height) for x in range(width)]
    got = boxes.regions(spark.createDataFrame([(1, width, values)], "id long, width int, map array<double>")).collect()
    assert [(r.x, r.y, r.width, r.height, r.area) for r in got] == [(2.0, 1.0, 8.0, 9.0, 72)]


def test_joins_of_boxes(spark):
    left = spark.createDataFrame([("p", 1, box(0, 0, 10, 10)), ("p", 2, box(50, 50, 10, 10)), ("q", 3, box(0, 0, 10, 10))], f"k string, id int, bounds {BOX}")
    right = spark.createDataFrame([("p", 7, box(0, 0, 10, 9)), ("p", 8, box(0, 0, 10, 9.5)), ("p", 9, box(51, 50, 30, 30))], f"k string, id int, bounds {BOX}")
    best = {r.l_id: r.r_id for r in boxes.nearest(left, right, ["k"], "id", "id").collect()}
    assert best == {1: 7, 2: 9}
    assert {r.id for r in boxes.unmatched_containment(right, left, ["k"]).collect()} == {9}
    labels = spark.createDataFrame([("p", 1, box(10, 10, 50, 10))], f"k string, id int, bounds {BOX}")
    values = spark.createDataFrame([("p", 2, box(12, 60, 50, 10)), ("p", 3, box(12, 40, 50, 10)), ("p", 4, box(12, 200, 50, 10)), ("p", 5, box(400, 30, 50, 10))], f"k string, id int, bounds {BOX}")
    assert boxes.value_below_label(labels, values, ["k"], "id", "id").first().r_id == 3


def test_summaries(spark):
    for values in ([5.0], list(range(1, 21)), [3.0, 1.0, 2.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        row = evaluation.summary(df, "v").first()
        ordered = sorted(values)
        assert (row.n, row.min, row.max, row.p95) == (len(values), ordered[0], ordered[-1], ordered[-(-95 * len(values) // 100) - 1])
    assert [tuple(r) for r in evaluation.grade_counts(spark.createDataFrame([(3,), (None,), (1,)], "grade int")).orderBy("grade").collect()] == [(1, 1), (2, 0), (3, 2)]
    tasks = spark.createDataFrame([(True, 2), (False, 4), (None, 9)], "success boolean, steps int")
    assert tuple(evaluation.task_success(tasks).first()) == (2, 0.5, 3.0)


def test_integrity_and_coverage(spark):
    cases = spark.createDataFrame([("a", True), ("b", False), ("a", True)], "case_id string, synthetic boolean")
    seen = spark.createDataFrame([("a", False), ("z", True)], "case_id string, raw_image_retained boolean")
    got = {tuple(r) for r in evaluation.integrity_errors(cases, seen).collect()}
    assert got == {("a", "duplicate_case"), ("b", "not_synthetic"), ("z", "unknown_case"), ("z", "raw_image_retained")}
    assert {tuple(r) for r in evaluation.coverage(cases, seen).collect()} == {(2, 1, None), (None, None, "b")}


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 1, 2), ("k", 5, 7), ("k", 9, 10)], "k string, start int, end int")
    assert sorted((r.start, r.end) for r in evaluation.merged_intervals(df, ["k"]).collect()) == [(0, 7), (9, 10)]


def test_confusion(spark):
    df = spark.createDataFrame(pd.DataFrame({"actual": [True, True, False, False], "predicted": [True, False, True, False]}))
    row = evaluation.confusion(df, []).first()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.tn, row.precision) == (1, 1, 1, 1, 0.5)
    assert (row.precision_low, row.precision_high) == (pytest.approx(0.09453, abs=1e-4), pytest.approx(0.90547, abs=1e-4))
