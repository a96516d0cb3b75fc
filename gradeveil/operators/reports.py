"""What is reported about observations, and joins whose rule is a count: receipts, gates, transfers, narrowed masks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g
from gradeveil.functions.columns import ratio
from gradeveil.operators import boxes, classify, documents, spans

# Messages that may be shown as they are; others become the first.
SAFE_MESSAGES = ["Local operation failed", "Page changed during capture", "Private value found in outgoing data", "Reasoning service unavailable"]


def category_counts(redactions: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """keys and a map of categories to their numbers of redactions."""
    counted = redactions.groupBy(*keys, classify.category_of_kind(F.col(kind)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"))


def receipt(redactions: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """One row per observation: digest of the image (key, png, width, height), redactions, categories, and masked share,
    both as a sum of areas and as the area covered once."""
    per = redactions.groupBy(key).agg(F.count(F.lit(1)).alias("redactions"), F.collect_list("bounds").alias("__b"))
    once = boxes.union_area(redactions, [key]).withColumnRenamed("union_area", "__once")
    rows = images.join(per, key, "left").join(category_counts(redactions, [key]), key, "left").join(once, key, "left")
    size = F.col("width") * F.col("height")
    masked = F.coalesce(g.masked_percent(F.col("__b"), F.col("width"), F.col("height")), F.lit(0.0))
    return rows.select(key, F.sha2("png", 256).alias("image_sha256"), F.coalesce("redactions", F.lit(0)).alias("redactions"), "categories", masked.alias("masked_percent"), F.round(100 * F.coalesce("__once", F.lit(0.0)) / size, 2).alias("covered_percent"))


def mask_pixels(pixels: DataFrame, annotations: DataFrame, key: str, mask: tuple[int, int, int] = (0, 0, 0), placeholder: tuple[int, int, int] = (243, 244, 246)) -> DataFrame:
    """Per annotation (key, annotation_id, bounds, r, g, b of its source colour): pixels, and how many have the mask's,
    the placeholder's and the source colour."""
    a = annotations.select(key, "annotation_id", "bounds", *(F.col(c).alias(f"s{c}") for c in "rgb"))
    b = F.col("bounds")
    inside = pixels.join(a, key).where((F.col("x") >= b["x"]) & (F.col("x") < g.right(b)) & (F.col("y") >= b["y"]) & (F.col("y") < g.bottom(b)))
    like = lambda colour: (F.col("r") == colour[0]) & (F.col("g") == colour[1]) & (F.col("b") == colour[2])
    return inside.groupBy(key, "annotation_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(like(mask)).alias("masked"), F.count_if(like(placeholder)).alias("placeholder"), F.count_if(like([F.col("sr"), F.col("sg"), F.col("sb")])).alias("source"))


def exact_match_rate(rows: DataFrame, truth: str, read: str) -> DataFrame:
    """Share of texts that equal the truth but for blanks and compatibility forms; null counts as empty."""
    from gradeveil.operators.texts import nfkc

    plain = lambda c: F.regexp_replace(nfkc(F.coalesce(F.col(c), F.lit(""))), r"(?U)\s+", "")
    judged = rows.select(plain(truth).alias("t"), plain(read).alias("r"))
    return judged.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(F.col("t") == F.col("r")), F.count(F.lit(1))).alias("exact"))


def mean_confidence(lines: Column) -> Column:
    """Mean confidence of an array of lines from 0 to 1; 0 for none."""
    total = F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["confidence"])
    return F.when(F.size(lines) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.size(lines)))).otherwise(F.lit(0.0))


def gate(checks: DataFrame) -> DataFrame:
    """Whether all checks (name, passed) hold, and those that do not. An unknown result does not hold."""
    failed = F.sort_array(F.collect_list(F.when(~F.coalesce("passed", F.lit(False)), F.col("name"))))
    return checks.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False)).alias("passed"), failed.alias("failed"))


def handles(redactions: DataFrame, key: str, kind: str = "kind", order: str = "position") -> DataFrame:
    """redactions with a handle per kind ([KIND_1], ...) and one over all (FIELD_1, ...), in order."""
    of_kind = F.row_number().over(Window.partitionBy(key, kind).orderBy(order))
    of_all = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return redactions.withColumn("handle", F.concat(F.lit("["), F.upper(kind), F.lit("_"), of_kind, F.lit("]"))).withColumn("field", F.concat(F.lit("FIELD_"), of_all))


def numbered(df: DataFrame, keys: list[str], order: list[str], part: str, out: str) -> DataFrame:
    """df with the number, from 1, of each row among those of its keys in an order. part: a column that never falls in
    that order (a day); rows are numbered within it and the counts of the parts before are added, so that a key with
    many rows is not one task."""
    counts = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*(F.col(c).alias(f"__{c}") for c in (*keys, part)), F.coalesce(before, F.lit(0)).alias("__before"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), (*keys, part), F.lit(True))
    within = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
    return within.join(offsets, same).withColumn(out, F.col("__row") + F.col("__before")).drop("__row", "__before", *(f"__{c}" for c in (*keys, part)))


def transfers(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Source fields (keys, source_id, label, value) with the one target control (keys, target_id, label, disabled) whose
    label has the same key: status transferred, ambiguous, unmatched or disabled. A field goes over only if exactly one
    control matches."""
    s = sources.select(*keys, "source_id", "value", classify.transfer_key(F.col("label")).alias("label_key"))
    t = targets.select(*keys, classify.transfer_key(F.col("label")).alias("label_key"), "target_id", "disabled")
    candidates = t.groupBy(*keys, "label_key").agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("target_id"), F.bool_or("disabled").alias("disabled"))
    joined = s.join(candidates, [*keys, "label_key"], "left")
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").when(F.col("disabled"), "disabled").otherwise("transferred")
    return joined.select(*keys, "source_id", F.when(status == "transferred", F.col("target_id")).alias("target_id"), F.when(status == "transferred", F.col("value")).alias("value"), status.alias("status"))


def transfer_counts(moved: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return moved.groupBy(*keys).agg(*(count(s) for s in ("transferred", "ambiguous", "unmatched", "disabled")))


def filled_fields(tasks: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """Page fields (key, field_id, name) with the value that the task (key, fields: map of name to value) gives them."""
    named = tasks.select(key, F.explode("fields").alias("name", "value"))
    return fields.join(named, [key, "name"])


def hinted_redactions(redactions: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Each redaction (key, redaction_id, kind, bounds) with the first hint (key, hint_id, kind, bounds, label) of its kind
    less than a pixel away, or null."""
    b = hints.select(key, "kind", F.col("bounds").alias("__b"), "hint_id", "label")
    near = redactions.join(b, [key, "kind"]).where(g.same(F.col("bounds"), F.col("__b"), 1.0))
    first = near.groupBy(key, "redaction_id").agg(F.min_by("label", "hint_id").alias("label"))
    return redactions.join(first, [key, "redaction_id"], "left")


def narrowed_masks(redactions: DataFrame, found: DataFrame, secrets: DataFrame, key: str, grade: int) -> DataFrame:
    """redactions without whole-media masks of documents (key, document_id, kind, bounds, confidence) whose secrets (key,
    document_id, secret, bounds) are all there that the grade hides."""
    seen = secrets.groupBy(key, "document_id").agg(F.collect_set("secret").alias("seen"))
    required = F.array().cast("array<string>")
    for kind, fields in documents.FIELDS.items():
        names = [f for f in fields if documents.FIELD_GRADES[f] <= grade]
        required = F.when(F.col("kind") == kind, F.array(*map(F.lit, names))).otherwise(required)
    sure = found.join(seen, [key, "document_id"]).where(F.col("confidence") >= documents.MIN_CONFIDENCE)
    sure = sure.where((F.size(required) > 0) & (F.size(F.array_except(required, "seen")) == 0)).select(F.col(key).alias("__k"), F.col("bounds").alias("__b"))
    gone = (F.col(key) == F.col("__k")) & (F.col("kind") == "uninspectable-media") & g.same(F.col("bounds"), F.col("__b"))
    return redactions.join(sure, gone, "left_anti")


def fused(sources: Iterable[DataFrame], image: DataFrame, key: str) -> DataFrame:
    """All redactions (key, kind, source, bounds) of several sources: those that cover the whole image (key, width,
    height) stand alone, and faces inside masked media go."""
    rows = None
    for df in sources:
        df = df.select(key, "kind", "source", "bounds")
        rows = df if rows is None else rows.unionByName(df)
    rows = rows.join(image.select(key, "width", "height"), key).withColumn("__whole", (F.col("kind") == "visual-fallback") & g.covers_whole(F.col("bounds"), F.col("width"), F.col("height")))
    any_whole = rows.groupBy(key).agg(F.bool_or("__whole").alias("__any"))
    rows = rows.join(any_whole, key).where(F.col("__whole") | ~F.col("__any")).select(key, "kind", "source", "bounds").dropDuplicates()
    media = rows.where("kind = 'uninspectable-media'")
    faces = boxes.unmatched_containment(rows.where("kind = 'face'"), media, [key])
    return rows.where("kind <> 'face'").unionByName(faces)


def verification_store(events: DataFrame, key: str) -> DataFrame:
    """Per key the number of observations and the digest of the last one (ts, event_id, json)."""
    last = F.max_by(F.substring(F.sha2("json", 256), 1, 16), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("observations"), last.alias("digest"))


def safe_message(message: Column, limit: int = 240) -> Column:
    """A message that may be shown: one of the known ones, clipped, else the general one."""
    known = F.exists(F.array(*map(F.lit, SAFE_MESSAGES)), lambda m: F.startswith(message, m))
    return F.when(F.coalesce(known, F.lit(False)), F.substring(spans.normalized(message), 1, limit)).otherwise(SAFE_MESSAGES[0])


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Policy blocks without repeats of code and message."""
    return blocks.dropDuplicates(["code", "message"])


def canonical_digest(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys, no blanks and ASCII only."""
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Names whose versions or digests (name, value) differ: missing, unexpected or changed."""
    joined = expected.alias("e").join(actual.alias("a"), "name", "full")
    what = F.when(F.col("a.value").isNull(), "missing").when(F.col("e.value").isNull(), "unexpected").when(F.col("a.value") != F.col("e.value"), "changed")
    return joined.select("name", what.alias("drift")).where("drift is not null")
