"""Rectangles in tables: exact union areas, pairs, nearest matches and connected regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g


def union_area(boxes: DataFrame, keys: list[str], bounds: str = "bounds") -> DataFrame:
    """keys and union_area: the area that a group's boxes cover, overlaps once.

    A sweep over x: between neighbouring edges the boxes that span the slice are merged along y by a running maximum.
    Slices are joined to boxes within the group only."""
    rows = boxes.where(g.valid(F.col(bounds))).select(*keys, F.col(bounds).alias("b"))
    sides = rows.select(*keys, F.explode(F.array(F.col("b.x"), g.right(F.col("b")))).alias("left")).distinct()
    slices = sides.withColumn("right", F.lead("left").over(Window.partitionBy(*keys).orderBy("left"))).where("right is not null")
    spans = rows.join(slices, keys).where((F.col("b.x") <= F.col("left")) & (g.right(F.col("b")) >= F.col("right")))
    spans = spans.select(*keys, "left", "right", F.col("b.y").alias("top"), g.bottom(F.col("b")).alias("bottom"))
    in_slice = Window.partitionBy(*keys, "left").orderBy("top", "bottom")
    before = F.max("bottom").over(in_slice.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("bottom") - F.greatest(F.col("top"), F.coalesce(before, F.col("top"))), F.lit(0.0))
    heights = spans.withColumn("height", new).groupBy(*keys, "left", "right").agg(F.sum("height").alias("height"))
    return heights.groupBy(*keys).agg(F.sum((F.col("right") - F.col("left")) * F.col("height")).alias("union_area"))


def pairs(left: DataFrame, right: DataFrame, keys: list[str], on: Column | None = None) -> DataFrame:
    """All pairs of a group that satisfy a condition on columns of both sides, prefixed l_ and r_. The groups are the
    equi-join, so no cross join of the tables arises."""
    a = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys))
    b = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    out = a.join(b, keys)
    return out if on is None else out.where(on)


def intersection_of_unions(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and union_area of what both sets of boxes cover: the union of their pairwise intersections."""
    both = pairs(left.select(*keys, "bounds"), right.select(*keys, "bounds"), keys)
    common = both.select(*keys, g.intersection(F.col("l_bounds"), F.col("r_bounds")).alias("bounds")).where("bounds is not null")
    return union_area(common, keys)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, min_overlap: float = 0.82) -> DataFrame:
    """For each box of the left the most overlapping one of the right in its group, if they are the same box or overlap
    enough; ties by right_id."""
    a, b = F.col("l_bounds"), F.col("r_bounds")
    near = pairs(left, right, keys, g.same_scaled(a, b) | (g.overlap_ratio(a, b) >= min_overlap)).withColumn("overlap", g.overlap_ratio(a, b))
    best = Window.partitionBy(*keys, f"l_{left_id}").orderBy(F.desc("overlap"), f"r_{right_id}")
    return near.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def lines_in_media(lines: DataFrame, media: DataFrame, keys: list[str], share: float = 0.45) -> DataFrame:
    """Pairs of lines and media where the overlap is at least a share of the smaller one."""
    return pairs(lines, media, keys, g.overlap_ratio(F.col("l_bounds"), F.col("r_bounds")) >= share)


def value_below_label(labels: DataFrame, values: DataFrame, keys: list[str], label_id: str, value_id: str) -> DataFrame:
    """For each label the topmost value line below it: within 4 above its bottom and max(90, 4 heights) below, and
    max(120, its width) sideways."""
    label, value = F.col("l_bounds"), F.col("r_bounds")
    gap = value["y"] - g.bottom(label)
    near = (gap >= -4) & (gap <= F.greatest(F.lit(90.0), label["height"] * 4)) & (F.abs(value["x"] - label["x"]) <= F.greatest(F.lit(120.0), label["width"]))
    first = Window.partitionBy(*keys, f"l_{label_id}").orderBy(value["y"], f"r_{value_id}")
    return pairs(labels, values, keys, near).withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def by_proximity(label: Column, value: Column) -> Column:
    """Whether a value stands near its label."""
    gap = F.abs((value["y"] + value["height"] / 2) - (label["y"] + label["height"] / 2))
    aside = F.abs((label["x"] + label["width"] / 2) - (value["x"] + value["width"] / 2))
    return (gap <= F.greatest(F.lit(64.0), label["height"] * 3)) & (aside <= F.greatest(label["width"], value["width"]) + 80)


def unmatched_containment(inner: DataFrame, outer: DataFrame, keys: list[str], either: bool = False) -> DataFrame:
    """Rows of inner whose box no box of outer contains (either: nor is contained in)."""
    o = outer.select(*keys, F.col("bounds").alias("__outer"))
    holds = g.contains(F.col("__outer"), F.col("bounds"))
    if either:
        holds = holds | g.contains(F.col("bounds"), F.col("__outer"))
    same_group = F.lit(True)
    for k in keys:
        same_group = same_group & (inner[k] == o[k])
    return inner.join(o, same_group & holds, "left_anti")


def regions(maps: DataFrame, threshold: float = 0.3, min_area: int = 64, min_score: float = 0.6) -> DataFrame:
    """Connected regions (4 neighbours) of probability maps: rows of id, width and map (array of float, row by row)
    give id, x, y, width, height, area and score (mean of the region)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, width, values in zip(batch["id"], batch["width"], batch["map"], strict=True):
                on = {i for i, v in enumerate(values) if v >= threshold}
                for seed in sorted(on):
                    if seed not in on:
                        continue
                    on.discard(seed)
                    stack, members = [seed], []
                    while stack:
                        i = stack.pop()
                        members.append(i)
                        x = i % width
                        for j in (i - width, i + width, *([i - 1] if x else []), *([i + 1] if x + 1 < width else [])):
                            if j in on:
                                on.discard(j)
                                stack.append(j)
                    score = sum(values[i] for i in members) / len(members)
                    if len(members) >= min_area and score >= min_score:
                        xs, ys = [i % width for i in members], [i // width for i in members]
                        out.append((id_, float(min(xs)), float(min(ys)), float(max(xs) - min(xs) + 1), float(max(ys) - min(ys) + 1), len(members), float(score)))
            yield pd.DataFrame(out, columns=["id", "x", "y", "width", "height", "area", "score"])

    return maps.select("id", "width", "map").mapInPandas(find, "id long, x double, y double, width double, height double, area long, score double")


def decode_yolo(tensors: DataFrame, classes: list[str], min_score: float = 0.45, nms: float | None = 0.5) -> DataFrame:
    """Rows of id and boxes (array of array: centre x, centre y, width, height, then a score for each class) give
    detections: array of struct<bounds,score,label>, best class each, suppressed unless nms is None."""

    def decoded(b: Column) -> Column:
        scores = F.slice(b, 5, len(classes))
        score = F.array_max(scores)
        label = F.element_at(F.array(*(F.lit(c) for c in classes)), F.array_position(scores, score).cast("int"))
        bounds = g.rect(b[0] - b[2] / 2, b[1] - b[3] / 2, b[2], b[3])
        return F.struct(bounds.alias("bounds"), score.cast("double").alias("score"), label.alias("label"))

    all_ = F.filter(F.transform("boxes", decoded), lambda d: d["score"] >= min_score)
    found = tensors.withColumn("detections", all_)
    return found.withColumn("detections", g.suppressed(F.col("detections"), nms)) if nms is not None else found


def decode_corners(boxes: Column, scores: Column, width: Column, height: Column, min_score: float = 0.72, nms: float = 0.35) -> Column:
    """Boxes as relative corners with one score each: kept where the score is high and the corners in order, scaled to
    the image and suppressed."""
    both = F.arrays_zip(boxes.alias("c"), scores.alias("s"))
    good = F.filter(both, lambda d: (d["s"] >= min_score) & (d["c"][2] > d["c"][0]) & (d["c"][3] > d["c"][1]))
    found = F.transform(good, lambda d: F.struct(g.clipped(d["c"][0] * width, d["c"][1] * height, d["c"][2] * width, d["c"][3] * height, width, height).alias("bounds"), d["s"].cast("double").alias("score")))
    return g.suppressed(found, nms)


# Kinds of redactions whose touching boxes are merged, in this order; others stay as they are.
MERGED_KINDS = ["password", "sensitive-field", "pii-text", "uninspectable-frame"]


def merged_redactions(redactions: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """keys, kind, source, field_label and bounds of redactions (keys, kind, source, field_label, bounds, position)
    whose kinds are merged: bucketed by kind, then by source and label, touching boxes of a bucket joined in one pass
    in the order of position. Buckets from patterns keep their source, all others come from the page."""
    rows = redactions.where(F.col("kind").isin(MERGED_KINDS)).withColumn("__label", F.coalesce("field_label", F.lit("")))
    listed = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.col("bounds").alias("b"))))
    buckets = rows.groupBy(*keys, "kind", "source", "__label").agg(listed.alias("bs"))
    merged = F.explode(g.merged(F.transform("bs", lambda x: x["b"])))
    source = F.when(F.col("source") == "regex", "regex").otherwise("dom")
    return buckets.select(*keys, "kind", source.alias("source"), F.when(F.col("__label") != "", F.col("__label")).alias("field_label"), merged.alias("bounds"))
