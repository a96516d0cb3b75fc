"""How well detections and redactions do against labelled truth."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeveil.functions import geometry as g
from gradeveil.functions.columns import f1, ratio, wilson
from gradeveil.operators import boxes

#: Redactions of these kinds stand for any sensitive kind where a run reports no detections.
WILDCARD_KINDS = ["pii-text", "sensitive-field", "password", "visual-fallback"]


def integrity_errors(cases: DataFrame, observations: DataFrame, case_id: str = "case_id") -> DataFrame:
    """case_id and error: repeated cases, cases that are not synthetic, repeated observations, unknown case ids, and
    observations that kept a raw image."""
    many = lambda df, code: df.groupBy(case_id).count().where("count > 1").select(case_id, F.lit(code).alias("error"))
    found = many(cases, "duplicate_case").unionByName(many(observations, "duplicate_observation"))
    found = found.unionByName(observations.join(cases, case_id, "left_anti").select(case_id, F.lit("unknown_case").alias("error")))
    found = found.unionByName(cases.where("not synthetic or synthetic is null").select(case_id, F.lit("not_synthetic").alias("error")))
    return found.unionByName(observations.where("raw_image_retained or raw_image_retained is null").select(case_id, F.lit("raw_image_retained").alias("error"))).distinct()


def candidate_matches(truths: DataFrame, predictions: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """Pairs of a case that may match, with their quality.

    truths: case_id, annotation_id, kind, bounds, source_ref, field; predictions: case_id, detection_id, kind, wildcard,
    bounds, source_ref, field. Kinds must be equal unless the prediction is a wildcard; boxes count by IoU, and where
    one side has none, equal source and field are a match of quality 1."""
    p = predictions.select("case_id", "detection_id", F.col("kind").alias("p_kind"), F.coalesce("wildcard", F.lit(False)).alias("wildcard"), F.col("bounds").alias("p_bounds"), F.col("source_ref").alias("p_ref"), F.col("field").alias("p_field"))
    both = truths.join(p, "case_id").where(F.col("wildcard") | (F.col("kind") == F.col("p_kind")))
    by_box = F.col("bounds").isNotNull() & F.col("p_bounds").isNotNull()
    located = (F.col("source_ref") == F.col("p_ref")) & (F.col("field") == F.col("p_field"))
    quality = F.when(by_box, g.iou(F.col("bounds"), F.col("p_bounds"))).when(F.coalesce(located, F.lit(False)), F.lit(1.0))
    return both.withColumn("quality", quality).where(F.when(by_box, F.col("quality") >= iou_threshold).otherwise(F.col("quality").isNotNull())).select("case_id", "annotation_id", "detection_id", "quality")


def with_wildcards(redactions: DataFrame) -> DataFrame:
    """Redactions as predictions, where a run reports no detections: those of general kinds match any sensitive kind."""
    return redactions.withColumn("wildcard", F.coalesce(F.col("kind").isin(WILDCARD_KINDS), F.lit(False)))


def _augment(edges: dict[str, list[str]]) -> dict[str, str]:
    """A maximum matching (annotation to detection), by augmenting paths in the order of detections; iterative, so
    that long paths are no matter."""
    owner: dict[str, str] = {}
    for first in sorted(edges):
        visited: set[str] = set()
        path: list[tuple[str, Iterator[str]]] = [(first, iter(edges[first]))]
        chosen: list[str] = []
        while path:
            detection, options = path[-1]
            step = next((t for t in options if t not in visited), None)
            if step is None:
                path.pop()
                if chosen:
                    chosen.pop()
                continue
            visited.add(step)
            chosen.append(step)
            if step in owner:
                path.append((owner[step], iter(edges[owner[step]])))
                continue
            for (d, _), t in zip(path, chosen, strict=True):
                owner[t] = d
            break
    return owner


def maximum_matching(candidates: DataFrame) -> DataFrame:
    """case_id, annotation_id, detection_id and quality of a maximum-cardinality matching per case: detections in the
    order of their ids, each trying annotations by falling quality, then id."""

    def match(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["detection_id", "quality", "annotation_id"], ascending=[True, False, True])
        edges = ordered.groupby("detection_id")["annotation_id"].apply(list).to_dict()
        owner = pd.DataFrame(_augment(edges).items(), columns=["annotation_id", "detection_id"])
        return group.merge(owner, on=["annotation_id", "detection_id"])[["case_id", "annotation_id", "detection_id", "quality"]]

    return candidates.groupBy("case_id").applyInPandas(match, "case_id string, annotation_id string, detection_id string, quality double")


def counts(tp, fp, fn) -> list:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1")]


def detection_metrics(truths: DataFrame, predictions: DataFrame, matches: DataFrame, by_kind: bool = False) -> DataFrame:
    """Precision, recall and F1 over all cases, or per kind. A false positive counts under its own kind."""
    hits = matches.select("case_id", "annotation_id", F.lit(1).alias("hit"))
    t = truths.join(hits, ["case_id", "annotation_id"], "left").select("kind", F.coalesce("hit", F.lit(0)).alias("tp"), (1 - F.coalesce("hit", F.lit(0))).alias("fn"), F.lit(0).alias("fp"))
    used = matches.select("case_id", "detection_id")
    p = predictions.join(used, ["case_id", "detection_id"], "left_anti").select("kind", F.lit(0).alias("tp"), F.lit(0).alias("fn"), F.lit(1).alias("fp"))
    grouped = t.unionByName(p).groupBy(*(["kind"] if by_kind else []))
    sums = grouped.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select(*(["kind"] if by_kind else []), *counts(F.col("tp"), F.col("fp"), F.col("fn")))


def mean_matched_iou(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean quality of matches to six decimals, null where there are none."""
    return matches.groupBy(*(keys or [])).agg(F.round(F.avg("quality"), 6).alias("mean_matched_iou"))


def macro(per_kind: DataFrame) -> DataFrame:
    """Means over kinds, without those that have none."""
    return per_kind.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def redaction_pixels(sensitive: DataFrame, redactions: DataFrame) -> DataFrame:
    """Pixels over all cases (case_id, bounds on both sides): sensitive, redacted, covered, missed and excess, and their
    ratios. Overlaps count once."""
    area = lambda df, name: df.withColumnRenamed("union_area", name)
    s, r = area(boxes.union_area(sensitive, ["case_id"]), "s"), area(boxes.union_area(redactions, ["case_id"]), "r")
    both = area(boxes.intersection_of_unions(sensitive, redactions, ["case_id"]), "c")
    joined = s.join(r, "case_id", "full").join(both, "case_id", "full").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("s", "r", "c")))
    s, r, c = F.col("s"), F.col("r"), F.col("c")
    return joined.select(s.alias("sensitive"), r.alias("redacted"), c.alias("covered"), (s - c).alias("missed"), (r - c).alias("excess"), ratio(c, s).alias("coverage"), ratio(c, r).alias("precision"), ratio(r - c, r).alias("excess_rate"))


#: Slots into which the values of a group are counted to find a rank.
SLOTS = 4096


def summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, min, median, mean, p95 (nearest rank) and max of the finite numbers of a column; no row for a group without.

    Ranks are found in two steps, so that no task holds a group's values: the values are counted in SLOTS equal parts
    of the group's range, then the distinct values of the slots that hold a wanted rank are counted."""
    out = list(keys or [])
    keys = [*out, "__all"]
    ok = df.withColumn("__all", F.lit(0)).select(*keys, F.col(value).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    sums = ok.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    width = (F.col("max") - F.col("min")) / SLOTS
    slot = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("min")) / width), F.lit(SLOTS - 1))).otherwise(0).cast("long")
    slotted = _equal_join(ok, sums.select(*keys, "n", "min", "max"), keys).select(*keys, "v", "n", slot.alias("slot"))
    ranks = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1, F.ceil(F.col("n") * 19 / 20))

    def upto(counts: DataFrame, by: list[str], order: str) -> DataFrame:
        return counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))

    slots = upto(slotted.groupBy(*keys, "slot", "n").agg(F.count(F.lit(1)).alias("c")), keys, "slot")
    wanted = slots.select(*keys, "slot", "upto", (F.col("upto") - F.col("c")).alias("before"), F.posexplode(ranks).alias("which", "rank")).where("rank > before and rank <= upto")
    inside = _equal_join(slotted.select(*keys, "slot", "v"), wanted.select(*keys, "slot", "before").distinct(), [*keys, "slot"])
    values = upto(inside.groupBy(*keys, "slot", "before", "v").agg(F.count(F.lit(1)).alias("c")), [*keys, "slot"], "v").withColumn("upto", F.col("upto") + F.col("before"))
    hit = _equal_join(values.drop("before"), wanted.select(*keys, "slot", "which", "rank"), [*keys, "slot"]).where("rank <= upto and rank > upto - c")
    ranked = lambda i: F.max(F.when(F.col("which") == i, F.col("v")))
    found = hit.groupBy(*keys).agg(((ranked(0) + ranked(1)) / 2).alias("median"), ranked(2).alias("p95"))
    return _equal_join(sums, found, keys).select(*out, "n", "min", "median", "mean", "p95", "max")


def _equal_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    renamed = right.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns))
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True))
    return left.join(renamed, on).drop(*(f"__{k}" for k in keys))


def grade_counts(df: DataFrame, grade: str = "grade") -> DataFrame:
    """Observations of each grade, 0 for grades without; a missing grade is 3."""
    spark = df.sparkSession
    found = df.groupBy(F.coalesce(F.col(grade), F.lit(3)).alias("grade")).count()
    return spark.createDataFrame([(1,), (2,), (3,)], "grade int").join(found, "grade", "left").select("grade", F.coalesce("count", F.lit(0)).alias("observations"))


def coverage(cases: DataFrame, observations: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Cases in all and observed ones in one row, and each missing case in a row of its own, where both are null. No
    list is built, however many are missing."""
    seen = observations.select(case_id).distinct().withColumn("__seen", F.lit(True))
    marked = cases.select(case_id).distinct().join(seen, case_id, "left")
    counts = marked.agg(F.count("*").alias("total"), F.count("__seen").alias("observed"))
    missing = marked.where("__seen is null").select(F.col(case_id).alias("missing"))
    return counts.unionByName(missing, allowMissingColumns=True)


def task_success(results: DataFrame) -> DataFrame:
    """Share of successful tasks and mean steps; rows with null success are not tasks."""
    tasks = results.where("success is not null")
    return tasks.agg(F.count("*").alias("tasks"), ratio(F.count_if("success"), F.count("*")).alias("success_rate"), F.round(F.avg("steps"), 6).alias("mean_steps"))


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn, the metrics and the Wilson interval of precision per group; rows have booleans actual, predicted."""
    a, p = F.col("actual"), F.col("predicted")
    sums = rows.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return sums.select(*keys, "tn", *counts(F.col("tp"), F.col("fp"), F.col("fn")), F.round(low, 6).alias("precision_low"), F.round(high, 6).alias("precision_high"))


def confusion_by_grade(rows: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """The confusion of each group, category and grade. rows: keys, category, min_grade, and booleans actual, predicted;
    a category counts as expected or found at a grade only if it is hidden there."""
    graded = rows.withColumn("grade", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    hidden = F.col("min_grade") <= F.col("grade")
    return confusion(graded.withColumn("actual", F.col("actual") & hidden).withColumn("predicted", F.col("predicted") & hidden), [*keys, category, "grade"])


def merged_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of a group with overlapping or touching ones merged."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(order))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
