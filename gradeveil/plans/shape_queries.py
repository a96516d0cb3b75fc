"""Queries over boxes and pixels: transforms, greedy merges, joins by place, detections decoded from tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g
from gradeveil.operators import boxes, evaluation, reports, validation
from gradeveil.plans.catalogue import BOXES, COMMON, _boxes, _truth_and_predictions, _union_sql
from gradeveil.plans.registry import query, table
from gradeveil.sources import readers

SIDES = ("x", "y", "width", "height")


def _sides(rect: Column, name: str, digits: int = 4) -> list[Column]:
    return [F.round(rect[s], digits).alias(f"{name}_{s}") for s in SIDES]


def _clip(name: str, x: str, y: str, r: str, b: str, w: str = "1500", h: str = "1200") -> str:
    """SQL of the four sides of a rectangle that is clipped to an image."""
    left, top = f"least(greatest({x}, 0), {w})", f"least(greatest({y}, 0), {h})"
    right, bottom = f"least(greatest({r}, {left}), {w})", f"least(greatest({b}, {top}), {h})"
    return ", ".join(f"round({v}, 4)::DOUBLE AS {name}_{s}" for s, v in zip(SIDES, (left, top, f"{right} - {left}", f"{bottom} - {top}"), strict=True))


def _grown(name: str, dx: str, dy: str) -> str:
    return _clip(name, f"x - {dx}", f"y - {dy}", f"x + w + {dx}", f"y + h + {dy}")


@query(
    f"""SELECT vec_id, {_clip('scaled', 'x * 0.5', 'y * 0.25', '(x + w) * 0.5', '(y + h) * 0.25', '800', '250')},
        {_grown('padded', 'greatest(4, w * 0.12)', 'greatest(4, h * 0.16)')}, {_grown('tight', 'least(4, greatest(2, w * 0.025))', 'least(3, greatest(2, h * 0.08))')},
        {_grown('mask', '3', '3')}, {_clip('whole', 'floor(x)', 'floor(y)', 'ceil(x + w)', 'ceil(y + h)')},
        {_clip('boxed', '(x - 20) / 0.8', '(y - 10) / 0.8', '(x + w - 20) / 0.8', '(y + h - 10) / 0.8')},
        round(x * 0.37, 2) AS less_x, round(y * 0.37, 2) AS less_y, round(w * 0.37, 2) AS less_width, round(h * 0.37, 2) AS less_height FROM ({BOXES})"""
)
def box_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w, h = F.col("bounds"), F.lit(1500.0), F.lit(1200.0)
    made = {
        "scaled": g.scaled(b, F.lit(0.5), F.lit(0.25), F.lit(800.0), F.lit(250.0)),
        "padded": g.padded(b, w, h),
        "tight": g.tightly_padded(b, w, h),
        "mask": g.semantic_mask(b, w, h),
        "whole": g.integer_mask(b, w, h),
        "boxed": g.letterbox_inverse(b, F.lit(0.8), F.lit(20), F.lit(10), w, h),
        "less": g.rounded(b, F.lit(0.37)),
    }
    return _boxes(spark, sf_dir).select("vec_id", *(c for name, rect in made.items() for c in _sides(rect, name)))


@query(
    f"""SELECT vec_id, round(least(1, 960 / greatest(w, h), sqrt(460800 / (w * h))), 9) AS factor, abs(w - h) <= 0.02 * greatest(w, h) AS uniform,
        x <= 2 AND y <= 2 AND x + w >= 798 AND y + h >= 498 AS covers, round(least(255, greatest(0, ((w % 256) * 0.299 + (h % 256) * 0.587 + (x % 256) * 0.114 - 128) * 1.8 + 128)), 6) AS grey FROM ({BOXES})"""
)
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bounds")
    grey = g.contrasted(b["width"] % 256, b["height"] % 256, b["x"] % 256)
    return _boxes(spark, sf_dir).select("vec_id", F.round(g.resize_budget(b["width"], b["height"]), 9).alias("factor"), g.uniform_scale(b["width"], b["height"]).alias("uniform"), g.covers_whole(b, F.lit(800), F.lit(500)).alias("covers"), F.round(grey, 6).alias("grey"))


@query(f"SELECT picture, round(min(x), 4) AS box_x, round(min(y), 4) AS box_y, round(max(x + w) - min(x), 4) AS box_width, round(max(y + h) - min(y), 4) AS box_height FROM ({BOXES}) GROUP BY picture")
def box_bounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _boxes(spark, sf_dir).groupBy("picture").agg(F.collect_list("bounds").alias("b"))
    return grouped.select("picture", *_sides(g.bounding(F.col("b")), "box"))


@query(
    f"""SELECT vec_id, round(CASE WHEN s < 20 THEN x + w * s / 20.0 ELSE x END, 4) AS value_x, round(y, 4) AS value_y,
        round(CASE WHEN s < 20 THEN greatest(1, x + w - (x + w * s / 20.0)) ELSE w END, 4) AS value_width, round(h, 4) AS value_height FROM (SELECT *, vec_id % 25 AS s FROM ({BOXES}))"""
)
def box_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = g.value_after_label(F.col("bounds"), F.lit("Full name: Ann Demo."), (F.col("vec_id") % 25).cast("double"))
    return _boxes(spark, sf_dir).select("vec_id", *_sides(value, "value"))


SNAPPED = f"SELECT vec_id, picture, label, score, floor(x / 80) * 80 AS x, floor(y / 80) * 80 AS y, floor(w / 80) * 80 + 100 AS w, floor(h / 80) * 80 + 100 AS h FROM ({BOXES})"


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a coarse grid, so that many are equal."""
    snap = lambda s: F.floor(F.col("bounds")[s] / 80) * 80
    return _boxes(spark, sf_dir).withColumn("bounds", g.rect(snap("x"), snap("y"), snap("width") + 100, snap("height") + 100))


@query(f"SELECT DISTINCT picture, x, y, w AS width, h AS height FROM ({SNAPPED})")
def box_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _snapped(spark, sf_dir).groupBy("picture").agg(F.collect_list("bounds").alias("b"))
    return listed.select("picture", F.explode(g.distinct_boxes(F.col("b"))).alias("d")).select("picture", "d.*")


HIT = "greatest(least(k.x + k.w, n.x + n.w) - greatest(k.x, n.x), 0) * greatest(least(k.y + k.h, n.y + n.h) - greatest(k.y, n.y), 0)"


def _greedy_sql(rows: str, order: str, step: str, out: str) -> str:
    """Boxes of a picture one after another, with a list of what was kept so far."""
    return f"""WITH RECURSIVE o AS (SELECT *, struct_pack(id := vec_id, x := x, y := y, w := w, h := h) AS n, row_number() OVER (PARTITION BY picture ORDER BY {order}) AS rn FROM ({rows})),
        s AS (SELECT picture, rn, [n] AS kept FROM o WHERE rn = 1
            UNION ALL SELECT o.picture, o.rn, {step} FROM s JOIN o ON o.picture = s.picture AND o.rn = s.rn + 1),
        last AS (SELECT picture, arg_max(kept, rn) AS kept FROM s GROUP BY picture)
        SELECT picture, {out} FROM (SELECT picture, unnest(kept) AS k FROM last)"""


NMS = _greedy_sql(BOXES, "score DESC, vec_id", f"CASE WHEN len(list_filter(s.kept, lambda k: {HIT.replace('n.', 'o.n.')} / (k.w * k.h + o.n.w * o.n.h - {HIT.replace('n.', 'o.n.')}) > 0.35)) > 0 THEN s.kept ELSE list_append(s.kept, o.n) END", "k.id AS vec_id")


@query(NMS)
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _boxes(spark, sf_dir).groupBy("picture").agg(F.sort_array(F.collect_list(F.struct("vec_id", "bounds", "score"))).alias("b"))
    return listed.select("picture", F.explode(g.suppressed(F.col("b"), 0.35)).alias("k")).select("picture", "k.vec_id")


TOUCH = "k.x <= o.n.x + o.n.w AND o.n.x <= k.x + k.w AND k.y <= o.n.y + o.n.h AND o.n.y <= k.y + k.h"
FIRST = f"coalesce(list_position(list_transform(s.kept, lambda k: {TOUCH}), true), 0)"
JOINED = "struct_pack(id := k.id, x := least(k.x, o.n.x), y := least(k.y, o.n.y), w := greatest(k.x + k.w, o.n.x + o.n.w) - least(k.x, o.n.x), h := greatest(k.y + k.h, o.n.y + o.n.h) - least(k.y, o.n.y))"
MERGE = f"CASE WHEN {FIRST} = 0 THEN list_append(s.kept, o.n) ELSE list_transform(s.kept, lambda k, i: CASE WHEN i = {FIRST} THEN {JOINED} ELSE k END) END"
SHRUNK = f"SELECT vec_id, picture, label, score, x, y, w / 8 AS w, h / 8 AS h FROM ({BOXES})"
PLACED = "round(k.x, 4) AS m_x, round(k.y, 4) AS m_y, round(k.w, 4) AS m_width, round(k.h, 4) AS m_height"


def _shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bounds")
    return _boxes(spark, sf_dir).withColumn("bounds", g.rect(b["x"], b["y"], b["width"] / 8, b["height"] / 8))


@query(_greedy_sql(SHRUNK, "vec_id", MERGE, PLACED))
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _shrunk(spark, sf_dir).groupBy("picture").agg(F.sort_array(F.collect_list(F.struct("vec_id", "bounds"))).alias("b"))
    return listed.select("picture", F.explode(g.merged(F.transform("b", lambda x: x["bounds"]))).alias("m")).select("picture", *_sides(F.col("m"), "m"))


BUCKETED = f"SELECT * REPLACE (picture || ' ' || CASE label % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'pii-text' ELSE 'face' END || ' ' || CASE vec_id % 2 WHEN 0 THEN 'regex' ELSE 'field' END || ' ' || CASE WHEN vec_id % 4 = 0 THEN 'Name' ELSE '' END AS picture) FROM ({SHRUNK}) WHERE label % 3 < 2"


@query(f"SELECT split_part(picture, ' ', 1)::BIGINT AS picture, split_part(picture, ' ', 2) AS kind, CASE WHEN split_part(picture, ' ', 3) = 'regex' THEN 'regex' ELSE 'dom' END AS source, nullif(split_part(picture, ' ', 4), '') AS field_label, m_x, m_y, m_width, m_height FROM ({_greedy_sql(BUCKETED, 'vec_id', MERGE, PLACED)})")
def redactions_merged_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("password", "pii-text", "face"))), (F.col("label") % 3 + 1).cast("int"))
    rows = _shrunk(spark, sf_dir).select("picture", v.alias("position"), kind.alias("kind"), F.when(v % 2 == 0, "regex").otherwise("field").alias("source"), F.when(v % 4 == 0, "Name").alias("field_label"), "bounds")
    return boxes.merged_redactions(rows, ["picture"]).select("picture", "kind", "source", "field_label", *_sides(F.col("bounds"), "m"))


PAIRS = f"FROM ({BOXES}) a JOIN ({BOXES}) b ON a.picture = b.picture AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _boxes(spark, sf_dir).select("picture", "vec_id", "bounds")
    return b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1")


@query(f"SELECT a.vec_id AS line_id, b.vec_id AS media_id {PAIRS} WHERE {COMMON} / least(a.w * a.h, b.w * b.h) >= 0.45")
def lines_in_media_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.lines_in_media(*_two(spark, sf_dir), ["picture"]).select(F.col("l_vec_id").alias("line_id"), F.col("r_vec_id").alias("media_id"))


@query(
    f"""SELECT label_id, value_id FROM (SELECT a.vec_id AS label_id, b.vec_id AS value_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.y, b.vec_id) AS rank {PAIRS}
        WHERE b.y - (a.y + a.h) >= -4 AND b.y - (a.y + a.h) <= greatest(90, 4 * a.h) AND abs(b.x - a.x) <= greatest(120, a.w)) WHERE rank = 1"""
)
def values_below_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.value_below_label(*_two(spark, sf_dir), ["picture"], "vec_id", "vec_id")
    return found.select(F.col("l_vec_id").alias("label_id"), F.col("r_vec_id").alias("value_id"))


@query(f"SELECT DISTINCT b.vec_id {PAIRS} WHERE abs(b.y + b.h / 2 - a.y - a.h / 2) <= greatest(64, 3 * a.h) AND abs(a.x + a.w / 2 - b.x - b.w / 2) <= greatest(a.w, b.w) + 80")
def values_near_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, values = _two(spark, sf_dir)
    near = boxes.pairs(labels, values, ["picture"], boxes.by_proximity(F.col("l_bounds"), F.col("r_bounds")))
    return near.select(F.col("r_vec_id").alias("vec_id")).distinct()


HOLDS = "{0}.x <= {1}.x AND {0}.y <= {1}.y AND {0}.x + {0}.w >= {1}.x + {1}.w AND {0}.y + {0}.h >= {1}.y + {1}.h"


@query(
    f"""WITH a AS (SELECT * FROM ({BOXES}) WHERE vec_id % 2 = 0), b AS (SELECT * FROM ({BOXES}) WHERE vec_id % 2 = 1)
    SELECT vec_id, 'inside' AS test FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.picture = b.picture AND {HOLDS.format('b', 'a')})
    UNION ALL SELECT vec_id, 'either' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.picture = b.picture AND ({HOLDS.format('b', 'a')} OR {HOLDS.format('a', 'b')}))"""
)
def uncontained_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner, outer = _two(spark, sf_dir)
    alone = lambda either, name: boxes.unmatched_containment(inner, outer, ["picture"], either).select("vec_id", F.lit(name).alias("test"))
    return alone(False, "inside").unionByName(alone(True, "either"))


@query(f"SELECT a.vec_id, min(b.vec_id) AS hint FROM ({SNAPPED}) a LEFT JOIN ({SNAPPED}) b ON a.picture = b.picture AND a.label % 2 = b.label % 2 AND b.vec_id % 2 = 1 AND abs(a.x - b.x) < 1 AND abs(a.y - b.y) < 1 AND abs(a.w - b.w) < 1 AND abs(a.h - b.h) < 1 WHERE a.vec_id % 2 = 0 GROUP BY a.vec_id")
def redaction_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _snapped(spark, sf_dir).select("picture", F.col("vec_id").alias("redaction_id"), (F.col("label") % 2).cast("string").alias("kind"), "bounds")
    hints = b.where("redaction_id % 2 = 1").select("picture", F.col("redaction_id").alias("hint_id"), "kind", "bounds", F.col("redaction_id").alias("label"))
    joined = reports.hinted_redactions(b.where("redaction_id % 2 = 0"), hints, "picture")
    return joined.select(F.col("redaction_id").alias("vec_id"), F.col("label").alias("hint"))


KIND_OF = "CASE vec_id % 4 WHEN 0 THEN 'face' WHEN 1 THEN 'uninspectable-media' WHEN 2 THEN 'pii-text' ELSE 'visual-fallback' END"
WHOLE = "kind = 'visual-fallback' AND x <= 2 AND y <= 2 AND x + w >= 98 AND y + h >= 98"
FUSED = f"SELECT *, {KIND_OF} AS kind FROM (SELECT * REPLACE (CASE WHEN picture % 2 = 0 AND vec_id % 20 = 3 THEN 0 ELSE x END AS x, CASE WHEN picture % 2 = 0 AND vec_id % 20 = 3 THEN 0 ELSE y END AS y) FROM ({SNAPPED}))"


@query(
    f"""WITH r AS (SELECT DISTINCT picture, kind, x, y, w, h FROM (SELECT *, {WHOLE} AS whole, bool_or({WHOLE}) OVER (PARTITION BY picture) AS any_whole FROM ({FUSED})) WHERE whole OR NOT any_whole)
    SELECT picture, kind, x, y, w AS width, h AS height FROM r a WHERE kind <> 'face' OR NOT EXISTS (SELECT 1 FROM r b WHERE b.kind = 'uninspectable-media' AND a.picture = b.picture AND {HOLDS.format('b', 'a')})"""
)
def fused_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, whole = F.col("vec_id"), (F.col("picture") % 2 == 0) & (F.col("vec_id") % 20 == 3)
    b = F.col("bounds")
    corner = g.rect(F.when(whole, 0).otherwise(b["x"]), F.when(whole, 0).otherwise(b["y"]), b["width"], b["height"])
    kind = F.element_at(F.array(*map(F.lit, ("face", "uninspectable-media", "pii-text", "visual-fallback"))), (v % 4 + 1).cast("int"))
    rows = _snapped(spark, sf_dir).select("picture", kind.alias("kind"), F.lit("dom").alias("source"), corner.alias("bounds"), "vec_id")
    images = rows.select("picture").distinct().select("picture", F.lit(100).alias("width"), F.lit(100).alias("height"))
    sources = [rows.where(v % 2 == i) for i in (0, 1)]
    return reports.fused(sources, images, "picture").select("picture", "kind", "bounds.*")


@query(
    f"""WITH docs AS (SELECT picture, min(vec_id) AS vec_id FROM ({SNAPPED}) GROUP BY picture),
    seen AS (SELECT picture, count(DISTINCT label % 3) AS n FROM ({SNAPPED}) WHERE label % 4 < 3 GROUP BY picture),
    known AS (SELECT s.* FROM ({SNAPPED}) s JOIN docs USING (picture, vec_id) JOIN seen USING (picture) WHERE n = 3 AND picture % 5 > 0)
    SELECT vec_id FROM ({SNAPPED}) r WHERE vec_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM known k WHERE k.picture = r.picture AND abs(k.x - r.x) < 0.5 AND abs(k.y - r.y) < 0.5 AND abs(k.w - r.w) < 0.5 AND abs(k.h - r.h) < 0.5)"""
)
def narrowed_media_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of PAN cards go where all three secrets were found with confidence."""
    rows = _snapped(spark, sf_dir)
    v = F.col("vec_id")
    redactions = rows.select("picture", "vec_id", F.when(v % 2 == 1, "pii-text").otherwise("uninspectable-media").alias("kind"), "bounds")
    found = rows.groupBy("picture").agg(F.min_by("bounds", "vec_id").alias("bounds")).select("picture", F.lit(0).alias("document_id"), F.lit("pan-card").alias("kind"), "bounds", F.when(F.col("picture") % 5 > 0, 0.95).otherwise(0.1).alias("confidence"))
    names = F.array(*map(F.lit, ("pan", "name", "date-of-birth")))
    secrets = rows.where("label % 4 < 3").select("picture", F.lit(0).alias("document_id"), F.element_at(names, (F.col("label") % 3 + 1).cast("int")).alias("secret"), "bounds")
    return reports.narrowed_masks(redactions, found, secrets, "picture", 3).select("vec_id")


# Detection and redaction quality

MATCHED = f"SELECT a.picture, a.vec_id AS a_id, b.vec_id AS b_id, a.label % 3 AS kind, {COMMON} / (a.w * a.h + b.w * b.h - {COMMON}) AS quality {PAIRS} AND a.label % 3 = b.label % 3"
UNIQUE = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY a_id) AS m, count(*) OVER (PARTITION BY b_id) AS n FROM ({MATCHED}) WHERE quality >= 0.2) WHERE m = 1 AND n = 1"
COUNTS = f"""WITH u AS ({UNIQUE}), e AS (SELECT kind::VARCHAR AS kind, (a_id IS NOT NULL)::INT AS tp, (a_id IS NULL)::INT AS fn, 0 AS fp FROM (SELECT v.label % 3 AS kind, u.a_id FROM ({BOXES}) v LEFT JOIN u ON u.a_id = v.vec_id WHERE v.vec_id % 2 = 0)
    UNION ALL SELECT (v.label % 3)::VARCHAR, 0, 0, 1 FROM ({BOXES}) v WHERE v.vec_id % 2 = 1 AND v.vec_id NOT IN (SELECT b_id FROM u)),
    s AS (SELECT kind, sum(tp)::BIGINT AS true_positives, sum(fp)::BIGINT AS false_positives, sum(fn)::BIGINT AS false_negatives FROM e GROUP BY kind),
    r AS (SELECT *, round(true_positives / nullif(true_positives + false_positives, 0), 6) AS precision, round(true_positives / nullif(true_positives + false_negatives, 0), 6) AS recall FROM s),
    f AS (SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM r)"""


def _unique_matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that are each other's only candidate, so that the matching is no choice."""
    truths, predictions = _truth_and_predictions(spark, sf_dir)
    predictions = predictions.withColumn("wildcard", F.lit(False))
    candidates = evaluation.candidate_matches(truths, predictions, 0.2)
    once = lambda c: candidates.groupBy(c).count().where("count = 1").select(c)
    return truths, predictions, evaluation.maximum_matching(candidates.join(once("annotation_id"), "annotation_id").join(once("detection_id"), "detection_id"))


@query(f"{COUNTS} SELECT kind, true_positives, false_positives, false_negatives, precision, recall, f1 FROM f")
def detection_metrics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.detection_metrics(*_unique_matches(spark, sf_dir), by_kind=True)


@query(f"{COUNTS} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f")
def detection_metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro(evaluation.detection_metrics(*_unique_matches(spark, sf_dir), by_kind=True))


@query(f"SELECT round(avg(quality), 6) AS mean_matched_iou FROM ({UNIQUE})")
def matched_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_matched_iou(_unique_matches(spark, sf_dir)[2])


def _area_sql(rows: str) -> str:
    return f"SELECT coalesce(sum(union_area), 0) FROM ({_union_sql(rows)})"


_SIDE = [f"SELECT picture, x, y, w, h FROM ({BOXES}) WHERE vec_id % 2 = {i}" for i in (0, 1)]
_BOTH = f"SELECT a.picture, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS h {PAIRS} AND {COMMON} > 0"


@query(f"SELECT round(s) AS sensitive, round(r) AS redacted, round(c) AS covered, round(s - c) AS missed, round(r - c) AS excess, round(c / s, 6) AS coverage, round(c / r, 6) AS precision, round((r - c) / r, 6) AS excess_rate FROM (SELECT ({_area_sql(_SIDE[0])}) AS s, ({_area_sql(_SIDE[1])}) AS r, ({_area_sql(_BOTH)}) AS c)")
def redaction_pixel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select(F.col("picture").alias("case_id"), "vec_id", "bounds")
    found = evaluation.redaction_pixels(b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1"))
    whole = ("sensitive", "redacted", "covered", "missed", "excess")
    return found.select(*(F.round(c).alias(c) for c in whole), "coverage", "precision", "excess_rate")


# Detections decoded from tensors

@query(
    f"""SELECT vec_id, label FROM (SELECT vec_id, arg_max(name, score) AS label, max(score) AS score FROM (
        SELECT vec_id, unnest(['a', 'b', 'c']) AS name, unnest([abs(embedding[5]::DOUBLE), abs(embedding[6]::DOUBLE), abs(embedding[7]::DOUBLE)]) AS score FROM embeddings) GROUP BY vec_id) WHERE score >= 0.15"""
)
def decoded_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a tensor with one box of four numbers and three class scores."""
    n = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    tensors = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(*(n(i) * (1000 if i < 5 else 1) for i in range(1, 8)))).alias("boxes"))
    found = boxes.decode_yolo(tensors, ["a", "b", "c"], min_score=0.15)
    return found.select("vec_id", F.explode("detections").alias("d")).select("vec_id", F.col("d.label").alias("label"))


CORNERS = "SELECT vec_id, picture, score, x / 1000 AS l, y / 1000 AS t, (x + w) / 2000 AS r, (y + h) / 2000 AS b FROM (" + BOXES + ")"
_CLIPPED = f"SELECT vec_id, picture, score, least(greatest(l * 640, 0), 640) AS x, least(greatest(t * 480, 0), 480) AS y, least(greatest(r * 640, least(greatest(l * 640, 0), 640)), 640) - least(greatest(l * 640, 0), 640) AS w, least(greatest(b * 480, least(greatest(t * 480, 0), 480)), 480) - least(greatest(t * 480, 0), 480) AS h FROM ({CORNERS}) WHERE score >= 0.1 AND r > l AND b > t"


@query(_greedy_sql(_CLIPPED, "score DESC, vec_id", f"CASE WHEN len(list_filter(s.kept, lambda k: {HIT.replace('n.', 'o.n.')} / (k.w * k.h + o.n.w * o.n.h - {HIT.replace('n.', 'o.n.')}) > 0.35)) > 0 THEN s.kept ELSE list_append(s.kept, o.n) END", "round(k.x, 4) AS face_x, round(k.y, 4) AS face_y, round(k.w, 4) AS face_width, round(k.h, 4) AS face_height"))
def decoded_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bounds")
    corners = F.array(b["x"] / 1000, b["y"] / 1000, g.right(b) / 2000, g.bottom(b) / 2000)
    listed = F.sort_array(F.collect_list(F.struct("vec_id", corners.alias("c"), "score")))
    rows = _boxes(spark, sf_dir).groupBy("picture").agg(listed.alias("l"))
    faces = boxes.decode_corners(F.transform("l", lambda x: x["c"]), F.transform("l", lambda x: x["score"]), F.lit(640.0), F.lit(480.0), min_score=0.1)
    return rows.select("picture", F.explode(faces).alias("f")).select("picture", *_sides(F.col("f.bounds"), "face"))


@query(
    """WITH RECURSIVE c AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
    o AS (SELECT * FROM c WHERE v >= 0.02),
    e AS (SELECT a.id, a.i AS f, b.i AS t FROM o a JOIN o b ON a.id = b.id AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
    r AS (SELECT id, i AS f, i AS t FROM o UNION SELECT r.id, r.f, e.t FROM r JOIN e ON e.id = r.id AND e.f = r.t),
    g AS (SELECT id, t AS i, min(f) AS seed FROM r GROUP BY id, t)
    SELECT id, min(i % 8)::DOUBLE AS x, min(i // 8)::DOUBLE AS y, (max(i % 8) - min(i % 8) + 1)::DOUBLE AS width, (max(i // 8) - min(i // 8) + 1)::DOUBLE AS height, count(*) AS area, round(avg(v), 6) AS score
    FROM g JOIN o USING (id, i) GROUP BY id, seed HAVING count(*) >= 2 AND avg(v) >= 0.03"""
)
def probability_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a map with rows of eight."""
    maps = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.transform("embedding", lambda v: v.cast("double")).alias("map"))
    return boxes.regions(maps, threshold=0.02, min_area=2, min_score=0.03).withColumn("score", F.round("score", 6))


# Pixels: pictures of 12 by 8, one for each nation, encoded as PNG by the query and read by the operators

COLOUR = {"r": "(n * 7 + x * 11 + y * 3) % 256", "g": "(n * 5 + x) % 256", "b": "(y * 29) % 256"}
PIXELS = f"SELECT n_nationkey AS n, x::INTEGER AS x, y::INTEGER AS y, {', '.join(f'{e} AS {c}' for c, e in COLOUR.items())} FROM (SELECT n_nationkey, n_nationkey AS n FROM nation), range(12) a(x), range(8) b(y)"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n and png: with every kind of row filter in turn."""
    import struct
    import zlib

    import numpy as np
    import pyarrow as pa

    def encode(n: int) -> bytes:
        y, x = np.mgrid[0:8, 0:12]
        picture = np.stack([(n * 7 + x * 11 + y * 3) % 256, (n * 5 + x) % 256, (y * 29) % 256], 2).astype(np.int32)
        raw = b""
        for row in range(8):
            kind = (n + row) % 5
            left = np.concatenate([np.zeros((1, 3), np.int32), picture[row, :-1]])
            up = picture[row - 1] if row else np.zeros((12, 3), np.int32)
            corner = np.concatenate([np.zeros((1, 3), np.int32), up[:-1]])
            estimate = left + up - corner
            a, b, c = abs(estimate - left), abs(estimate - up), abs(estimate - corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            guess = (0, left, up, (left + up) // 2, paeth)[kind]
            raw += bytes([kind]) + ((picture[row] - guess) & 255).astype(np.uint8).tobytes()
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return readers.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 12, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([encode(k) for k in keys], pa.binary())], names=["n", "png"])

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).mapInArrow(run, "n long, png binary")


@query(f"SELECT n::BIGINT AS n, x, y, r::INTEGER AS r, g::INTEGER AS g, b::INTEGER AS b, 255::INTEGER AS a FROM ({PIXELS})")
def picture_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.pictures_to_pixels(_pictures(spark, sf_dir), "n").drop("error")


@query("SELECT n_nationkey::BIGINT AS n, name, size FROM nation, (VALUES ('IHDR', 13), ('IEND', 0)) c(name, size)")
def picture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def chunks(png: bytes) -> list[tuple[str, int]]:
        return [(name, len(body)) for name, body in readers.png_chunks(png) if name != "IDAT"]

    listed = F.udf(chunks, "array<struct<name:string,size:int>>")
    return _pictures(spark, sf_dir).select("n", F.explode(listed("png")).alias("c")).select("n", "c.name", "c.size")


@query("SELECT n_nationkey::BIGINT AS n, CASE n_nationkey % 3 WHEN 0 THEN 'tEXt' ELSE 'damaged' END AS chunk FROM nation WHERE n_nationkey % 3 < 2")
def forbidden_picture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One picture in three has a comment behind its header, one has lost its end."""
    n, png = F.col("n"), F.col("png")
    text = F.concat(F.lit(b"tEXt"), F.lit(b"Comment\0x"))
    chunk = F.concat(F.unhex(F.lit("00000009")), text, F.unhex(F.lpad(F.hex(F.crc32(text)), 8, "0")))
    size = F.octet_length(png)
    changed = F.when(n % 3 == 0, F.concat(F.substring(png, 1, 33), chunk, F.expr("substring(png, 34)"))).when(n % 3 == 1, F.substring(png, F.lit(1), size - 5)).otherwise(png)
    return readers.forbidden_chunks(_pictures(spark, sf_dir).withColumn("png", changed), "n")


@query(f"SELECT vec_id, label % 2 = 0 AS wildcard FROM ({BOXES})")
def wildcard_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("label") % 2 == 1, "aadhaar-card").when(F.col("label") % 4 == 0, "pii-text").otherwise("visual-fallback")
    return evaluation.with_wildcards(_boxes(spark, sf_dir).select("vec_id", kind.alias("kind"))).drop("kind")


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    where = F.explode(F.array(*(F.struct(F.lit(i).alias("annotation_id"), g.rect(F.lit(float(x)), F.lit(float(y)), F.lit(float(w)), F.lit(float(h))).alias("bounds")) for i, (x, y, w, h) in enumerate(((0, 0, 3, 2), (2, 1, 5, 5), (9, 0, 3, 8))))))
    colour = [(n * 7) % 256, (n * 5) % 256, F.lit(0)]
    return table(spark, sf_dir, "nation").select(n.alias("n"), where.alias("w"), *(c.cast("int").alias(k) for c, k in zip(colour, "rgb", strict=True))).select("n", "w.*", "r", "g", "b")


PLACES = "(VALUES (0, 0, 0, 3, 2), (1, 2, 1, 5, 5), (2, 9, 0, 3, 8)) p(annotation_id, px, py, pw, ph)"


@query(
    f"""SELECT n::BIGINT AS n, annotation_id, count(*) AS pixels, count(*) FILTER (r = 0 AND g = 0 AND b = 0) AS masked, count(*) FILTER (r = 7 AND g = 1 AND b = 29) AS placeholder,
        count(*) FILTER (r = (n * 7) % 256 AND g = (n * 5) % 256 AND b = 0) AS source FROM ({PIXELS}), {PLACES} WHERE x >= px AND x < px + pw AND y >= py AND y < py + ph GROUP BY n, annotation_id"""
)
def annotation_mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = readers.pictures_to_pixels(_pictures(spark, sf_dir), "n")
    return reports.mask_pixels(pixels, _annotations(spark, sf_dir), "n", placeholder=(7, 1, 29))


@query(
    f"""SELECT n::BIGINT AS n, annotation_id AS mask_id, 'mask_not_applied' AS error FROM ({PIXELS}), {PLACES} WHERE x >= px AND x < px + pw AND y >= py AND y < py + ph GROUP BY n, annotation_id
        HAVING max(greatest(r, g, b)) > 0 AND count(*) FILTER (x IN (px, px + pw - 1) AND y IN (py, py + ph - 1) AND r = 0 AND g = 0 AND b = 0) = 0"""
)
def mask_pixel_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = readers.pictures_to_pixels(_pictures(spark, sf_dir), "n")
    masks = _annotations(spark, sf_dir).select("n", F.col("annotation_id").alias("mask_id"), "bounds")
    return validation.masks_violations(masks, pixels, masks, "n", background=(0, 0, 0))


@query(
    f"""WITH once AS ({_union_sql(BOXES)})
    SELECT picture, sha256(picture::VARCHAR) AS image_sha256, count(*) AS redactions, least(100.0, round(100 * sum(w * h) / 4e6)) AS masked_percent, round(100 * any_value(union_area) / 4e6, 2) AS covered_percent FROM ({BOXES}) JOIN once USING (picture) GROUP BY picture"""
)
def observation_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).withColumn("kind", F.lit("EMAIL"))
    images = rows.select("picture").distinct().select("picture", F.col("picture").cast("string").cast("binary").alias("png"), F.lit(2000).alias("width"), F.lit(2000).alias("height"))
    return reports.receipt(rows, images, "picture").drop("categories")


@query(f"SELECT picture, round(least(1, greatest(0, avg(score))), 6) AS confidence FROM ({BOXES}) GROUP BY picture")
def mean_line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _boxes(spark, sf_dir).groupBy("picture").agg(F.collect_list(F.struct(F.col("score").alias("confidence"))).alias("l"))
    return listed.select("picture", F.round(reports.mean_confidence(F.col("l")), 6).alias("confidence"))
