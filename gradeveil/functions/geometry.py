"""Rectangles as structs of x, y, width and height: column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = "struct<x:double,y:double,width:double,height:double>"


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def valid(b: Column) -> Column:
    return F.coalesce((b["width"] > 0) & (b["height"] > 0), F.lit(False))


def intersection_area(a: Column, b: Column) -> Column:
    width = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    height = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    # greatest() and least() skip nulls
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)))


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle, or null where there is none."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    return F.when(intersection_area(a, b) > 0, rect(x, y, F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y))


def iou(a: Column, b: Column) -> Column:
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller rectangle."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection_area(a, b) / smaller).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x"] <= inner["x"]) & (outer["y"] <= inner["y"]) & (right(outer) >= right(inner)) & (bottom(outer) >= bottom(inner))


def covers_whole(b: Column, width: Column, height: Column, tolerance: float = 2.0) -> Column:
    return (b["x"] <= tolerance) & (b["y"] <= tolerance) & (right(b) >= width - tolerance) & (bottom(b) >= height - tolerance)


def _near(a: Column, b: Column, test: Callable[[Column], Column]) -> Column:
    out = F.lit(True)
    for side in ("x", "y", "width", "height"):
        out = out & test(F.abs(a[side] - b[side]))
    return out


def same(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    return _near(a, b, lambda d: d < tolerance)


def same_scaled(a: Column, b: Column) -> Column:
    """Equal but for 0.2 % of the longest side, 0.75 at least."""
    limit = F.greatest(F.lit(0.75), F.greatest(a["width"], a["height"], b["width"], b["height"]) * 0.002)
    return _near(a, b, lambda d: d <= limit)


def touching(a: Column, b: Column) -> Column:
    return (a["x"] <= right(b)) & (b["x"] <= right(a)) & (a["y"] <= bottom(b)) & (b["y"] <= bottom(a))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, value))


def clipped(x: Column, y: Column, r: Column, b: Column, width: Column, height: Column) -> Column:
    """The rectangle from (x, y) to (r, b) inside an image."""
    zero = F.lit(0.0)
    x, y = clamp(x, zero, width), clamp(y, zero, height)
    return rect(x, y, clamp(r, x, width) - x, clamp(b, y, height) - y)


def scaled(b: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    return clipped(b["x"] * sx, b["y"] * sy, right(b) * sx, bottom(b) * sy, width, height)


def uniform_scale(sx: Column, sy: Column, tolerance: float = 0.02) -> Column:
    return F.abs(sx - sy) <= tolerance * F.greatest(sx, sy)


def grown(b: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    return clipped(b["x"] - dx, b["y"] - dy, right(b) + dx, bottom(b) + dy, width, height)


def padded(b: Column, width: Column, height: Column) -> Column:
    """12 % and 16 % on each side, 4 at least."""
    return grown(b, F.greatest(F.lit(4.0), b["width"] * 0.12), F.greatest(F.lit(4.0), b["height"] * 0.16), width, height)


def tightly_padded(b: Column, width: Column, height: Column) -> Column:
    """2.5 % from 2 to 4 sideways, 8 % from 2 to 3 above and below."""
    return grown(b, clamp(b["width"] * 0.025, F.lit(2.0), F.lit(4.0)), clamp(b["height"] * 0.08, F.lit(2.0), F.lit(3.0)), width, height)


def semantic_mask(b: Column, width: Column, height: Column) -> Column:
    return grown(b, F.lit(3.0), F.lit(3.0), width, height)


def integer_mask(b: Column, width: Column, height: Column) -> Column:
    return clipped(F.floor(b["x"]), F.floor(b["y"]), F.ceil(right(b)), F.ceil(bottom(b)), width, height)


def bounding(boxes: Column) -> Column:
    """The least rectangle around an array of them; null around none."""
    left, top = (F.array_min(F.transform(boxes, lambda b: b[side])) for side in ("x", "y"))
    return F.when(F.size(boxes) > 0, rect(left, top, F.array_max(F.transform(boxes, right)) - left, F.array_max(F.transform(boxes, bottom)) - top))


def letterbox_inverse(b: Column, scale: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> Column:
    """A box of a letterboxed input in its image."""
    return clipped((b["x"] - pad_x) / scale, (b["y"] - pad_y) / scale, (right(b) - pad_x) / scale, (bottom(b) - pad_y) / scale, width, height)


def resize_budget(width: Column, height: Column, edge: int = 960, pixels: int = 460_800) -> Column:
    """The factor, 1 at most, that brings an image within the longest edge and the number of pixels."""
    return F.least(F.lit(1.0), edge / F.greatest(width, height), F.sqrt(pixels / (width * height)))


def rounded(b: Column, scale: Column, digits: int = 2) -> Column:
    return rect(*(F.round(b[side] * scale, digits) for side in ("x", "y", "width", "height")))


def masked_percent(boxes: Column, width: Column, height: Column) -> Column:
    """Sum of areas (overlaps count twice) as a percentage of the image, 100 at most."""
    total = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + area(b))
    return F.least(F.lit(100.0), F.round(100 * total / (width * height)))


def merged(boxes: Column) -> Column:
    """Boxes with those that touch an earlier one joined to the first they touch: one pass in the order given, so a
    grown box is not compared again. Empty boxes are dropped."""

    def step(done: Column, b: Column) -> Column:
        hit = F.array_position(F.transform(done, lambda d: touching(d, b)), True)

        def join(d: Column) -> Column:
            x, y = F.least(d["x"], b["x"]), F.least(d["y"], b["y"])
            return rect(x, y, F.greatest(right(d), right(b)) - x, F.greatest(bottom(d), bottom(b)) - y)

        grown_ = F.transform(done, lambda d, i: F.when(i + 1 == hit, join(d)).otherwise(d))
        return F.when(~valid(b), done).when(hit == 0, F.concat(done, F.array(b))).otherwise(grown_)

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)


def suppressed(boxes: Column, threshold: float) -> Column:
    """Non-maximum suppression of structs with bounds and score, whatever their class: by falling score, a box that
    has an IoU above the threshold with a kept one goes. Ties keep their order."""
    numbered = F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("s"), i.alias("i"), b.alias("b")))
    ordered = F.transform(F.sort_array(numbered), lambda x: x["b"])
    return F.aggregate(ordered, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k["bounds"], b["bounds"]) > threshold), kept).otherwise(F.concat(kept, F.array(b))))


def distinct_boxes(boxes: Column, tolerance: float = 0.5) -> Column:
    """Boxes but for those that equal an earlier kept one."""
    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: same(k, b, tolerance)), kept).otherwise(F.concat(kept, F.array(b))))


def value_after_label(line: Column, text: Column, value_start: Column) -> Column:
    """The part of a line's box behind a character, if the characters share its width evenly."""
    share = clamp(value_start / F.greatest(F.lit(1), F.length(text)), F.lit(0.0), F.lit(1.0))
    x = line["x"] + line["width"] * share
    return F.when(value_start < F.length(text), rect(x, line["y"], F.greatest(F.lit(1.0), right(line) - x), line["height"])).otherwise(line)


def contrasted(r: Column, g: Column, b: Column) -> Column:
    """The luminance of a colour, its distance from the middle stretched by 1.8, from 0 to 255."""
    luminance = r * 0.299 + g * 0.587 + b * 0.114
    return clamp((luminance - 128) * 1.8 + 128, F.lit(0.0), F.lit(255.0))
