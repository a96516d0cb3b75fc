"""Texts beyond spans: normalisation for detection, planted values, identities, task fields and the server's floor."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradeveil.functions import guards, policy
from gradeveil.functions.columns import bound, first_match, hmac_sha256
from gradeveil.operators import classify, spans

# Digits of other scripts, and dashes.
DIGITS = "०१२३४५६७८९٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DASHES = r"[\u2010-\u2015\u2212]"
INVISIBLE = r"[\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFEFF]"
PLACEHOLDER = r"^\[REDACTED:[A-Z0-9_-]{2,40}\]$"

# Keys that no outgoing record may have.
UNSAFE_KEYS = ["html", "innerhtml", "outerhtml", "textcontent", "value", "password", "cookie", "cookies", "localstorage", "sessionstorage", "screenshot", "dataurl", "raw", "rawdom", "accessibilitytree"]


def _nfkc(texts):
    return texts.str.normalize("NFKC")


_nfkc.__annotations__ = {"texts": pd.Series, "return": pd.Series}
nfkc = F.pandas_udf(_nfkc, StringType())


def for_detection(text: Column, compatibility: bool = True) -> Column:
    """Text for classification only: compatibility forms, no invisible characters, ASCII digits and hyphens, nothing
    around @ and full stops, no blanks between digits. Offsets in it mean nothing in the original."""
    t = nfkc(text) if compatibility else text
    t = F.translate(F.regexp_replace(t, INVISIBLE, ""), DIGITS, "0123456789" * 3)
    t = F.regexp_replace(F.regexp_replace(t, DASHES, "-"), f"[{policy.BLANKS}]*([@.])[{policy.BLANKS}]*", "$1")
    return F.regexp_replace(t, f"(?<=[0-9])[{policy.BLANKS}]+(?=[0-9])", "")


def is_placeholder(text: Column) -> Column:
    return text.rlike(PLACEHOLDER)


def floor_hit(text: Column, grade: int) -> Column:
    """The first of the server profile's patterns that a text violates at a grade, or null. Placeholders pass."""
    own = [p for p in policy.SERVER_FLOOR if p.min_grade <= grade]
    shared = [p for p in policy.SHARED if policy.grade_of(p.kind) <= grade]
    order = [p for p in own if p.min_grade == 1] + shared + [p for p in own if p.min_grade > 1]
    return F.when(~is_placeholder(text) & (text != ""), _first_hit(text, order))


def _first_hit(text: Column, patterns: list[policy.Pattern]) -> Column:
    """The kind of the first pattern that a text matches; each is tried only where the text holds what it needs."""

    def decide(x: Column) -> Column:
        return first_match([(guards.may_match(x["fold"], x["signs"], x["digits"], p.regex) & text.rlike(policy.java_pattern(p, "server")), p.kind) for p in patterns])

    def prepare(signs: Column) -> Column:
        return bound(F.struct(guards.folded(text).alias("fold"), signs.alias("signs"), guards.digits_in(signs).alias("digits")), decide)

    return bound(guards.signs_in(text), prepare)


def rejected_by_floor(df: DataFrame, text: str, grade: int, out: str = "rejected") -> DataFrame:
    """Whether the floor rejects a text as it stands, or the shared patterns its normalised form. Null texts pass."""
    df = df.withColumn("__n", for_detection(F.col(text)))
    shared = [p for p in policy.SHARED if policy.grade_of(p.kind) <= grade]
    folded = _first_hit(F.col("__n"), shared).isNotNull() & ~is_placeholder(F.col(text))
    return df.withColumn(out, F.coalesce(floor_hit(F.col(text), grade).isNotNull() | folded, F.lit(False))).drop("__n")


def hits_of_values(df: DataFrame, values: DataFrame, text: str, value: str, keys: list[str]) -> DataFrame:
    """Rows of df with the values that their text holds, any letter case, three characters and more. Values are matched
    within the keys that both sides share, by an equi-join; a value is searched only in its own group's texts."""
    needles = values.select(*keys, F.trim(value).alias("__needle")).where("length(__needle) >= 3").distinct()
    return df.join(needles, keys).where(F.contains(F.lower(text), F.lower("__needle"))).withColumnRenamed("__needle", "needle")


def canary_forms(canaries: DataFrame, profile: str = "client") -> DataFrame:
    """canary_id, form and needle: the forms in which a planted value may turn up. client: plain, URL and base64, from
    three characters; verifier: with URL-plus and URL-safe base64 too, from one."""

    def swapped(c: Column, pairs: dict[str, str]) -> Column:
        for old, new in pairs.items():
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    v = F.trim("value")
    form, base64 = swapped(F.url_encode(v), {"%7E": "~"}), F.base64(F.encode(v, "UTF-8"))
    if profile == "client":  # leaves !'()* as they are
        forms = {"plain": v, "url": swapped(form, {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}), "base64": base64}
    else:
        plus = swapped(form, {"*": "%2A"})
        forms = {"plain": v, "url": swapped(plus, {"+": "%20"}), "urlPlus": plus, "base64": base64, "base64Url": F.rtrim(F.translate(base64, "+/", "-_"), F.lit("="))}
    listed = F.explode(F.array(*(F.struct(F.lit(name).alias("form"), needle.alias("needle")) for name, needle in forms.items())))
    return canaries.where(F.length(v) >= (3 if profile == "client" else 1)).select("canary_id", listed.alias("f")).select("canary_id", "f.form", "f.needle").distinct()


#: Characters of the needles that are searched in one pass; more go in further passes.
CANARY_CHARS = 8_000_000
BARE = r"[^\p{L}\p{N}]"


def canaries_for_grade(canaries: DataFrame, grade: int, min_grade: str = "min_grade") -> DataFrame:
    """The planted values that must not be seen at a grade: those whose least grade is at most it. A missing or unknown
    grade counts as 1, so that the value is always looked for."""
    least = F.col(min_grade)
    return canaries.where(F.when(least.between(1, 3), least).otherwise(1) <= grade)


def canary_leaks(df: DataFrame, canaries: DataFrame, text: str, key: str, profile: str = "client") -> DataFrame:
    """key, canary_id and form of each planted value that a text holds, in order. The canaries are a query set: they
    are searched in blocks of bounded size, each with one automaton that reads a text once, so that no join of all
    texts with all canaries arises. verifier: eight letters and digits or more are also found with anything between
    them (form separated)."""
    spark, t = df.sparkSession, F.col(f"`{text}`")
    client = profile == "client"
    forms = canary_forms(canaries, profile)
    bare = F.when((F.col("form") == "plain") & F.lit(not client), F.regexp_replace(F.upper("needle"), BARE, ""))
    forms = forms.select("canary_id", "form", (F.lower("needle") if client else F.col("needle")).alias("needle"), F.when(F.length(bare) >= 8, bare).alias("bare"))
    texts = df.select(F.col(f"`{key}`").alias("__key"), (F.lower(t) if client else t).alias("__text"), (F.lit(None).cast("string") if client else F.regexp_replace(F.upper(t), BARE, "")).alias("__bare")).where("__text is not null")
    kinds = dict(texts.dtypes)["__key"], dict(forms.dtypes)["canary_id"]

    def search(shared) -> DataFrame:
        def run(batches):
            import ahocorasick
            import pyarrow as pa

            needles = shared.value
            plain, squeezed = ahocorasick.Automaton(), ahocorasick.Automaton()
            for automaton, at in ((plain, 2), (squeezed, 3)):
                numbers: dict[str, list[int]] = {}
                for i, needle in enumerate(needles):
                    if needle[at]:
                        numbers.setdefault(needle[at], []).append(i)
                for word, i in numbers.items():
                    automaton.add_word(word, i)
                automaton.make_automaton()
            found_in = lambda automaton, value: {i for _, each in automaton.iter(value) for i in each} if value and len(automaton) else set()
            for batch in batches:
                rows, leaks, names = [], [], []
                for row, (value, bare) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__bare").to_pylist(), strict=True)):
                    hits = found_in(plain, value)
                    for i in sorted(hits):
                        rows.append(row)
                        leaks.append(needles[i][0])
                        names.append(needles[i][1])
                    for i in sorted(found_in(squeezed, bare) - hits):
                        rows.append(row)
                        leaks.append(needles[i][0])
                        names.append("separated")
                yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(rows, pa.int64())), pa.array(leaks, leak_type), pa.array(names, pa.string())], names=["__key", "canary_id", "form"])

        return texts.mapInArrow(run, f"__key {kinds[0]}, canary_id {kinds[1]}, form string")

    from pyspark.sql.pandas.types import to_arrow_type

    leak_type = to_arrow_type(forms.schema["canary_id"].dataType)
    out, held, chars = None, [], 0

    def searched(out: DataFrame | None) -> DataFrame:
        found = search(spark.sparkContext.broadcast(list(held)))
        return found if out is None else out.unionByName(found)

    for r in forms.toLocalIterator():
        if held and chars + len(r.needle) > CANARY_CHARS:
            out, held, chars = searched(out), [], 0
        held.append((r.canary_id, r.form, r.needle, r.bare))
        chars += len(r.needle)
    return searched(out).dropDuplicates().withColumnRenamed("__key", key)


def has_unsafe_keys(json: Column) -> Column:
    """Whether JSON text has one of the unsafe keys at any depth, any letter case. Null or unreadable text has (fails
    closed)."""
    return F.coalesce(json.rlike(r'(?i)"(?:%s)"\s*:' % "|".join(UNSAFE_KEYS)), F.lit(True)) | F.try_parse_json(json).isNull()


def dlp_blocked(df: DataFrame, texts: list[str], grade: int, out: str = "blocked") -> DataFrame:
    """The last gate: whether the joined texts still have a finding at a grade."""
    df = df.withColumn("__joined", F.concat_ws("\n", *texts))
    df = spans.with_findings(df, "__joined", out="__findings")
    return df.withColumn(out, F.size(spans.for_grade(F.col("__findings"), grade)) > 0).drop("__joined", "__findings")


def identity_variants(value: Column, category: Column) -> Column:
    """Forms in which an identity value may appear: dates of birth in four."""
    v = F.trim(value)
    iso, local = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    part = lambda p, i: F.regexp_extract(v, p, i)
    year = F.when(v.rlike(iso), part(iso, 1)).otherwise(part(local, 3))
    month = F.when(v.rlike(iso), part(iso, 2)).otherwise(F.lpad(part(local, 2), 2, "0"))
    day = F.when(v.rlike(iso), part(iso, 3)).otherwise(F.lpad(part(local, 1), 2, "0"))
    dates = F.array(v, F.concat_ws("-", year, month, day), F.concat_ws("/", day, month, year), F.concat_ws("-", day, month, year))
    return F.when((category == "date-of-birth") & (v.rlike(iso) | v.rlike(local)), dates).otherwise(F.array(v))


def identity_findings(text: Column, values: Column, grade: int) -> Column:
    """Places of identity values (array of struct<value,category>) in a text, as whole words with flexible blanks, in
    order of start, longer first."""
    visible = F.filter(values, lambda v: classify.hidden(v["category"], grade))
    forms = F.flatten(F.transform(visible, lambda v: F.transform(identity_variants(v["value"], v["category"]), lambda f: F.struct(f.alias("form"), F.when(v["category"] == "name", "NAME").otherwise("DOB").alias("kind")))))
    usable = F.filter(forms, lambda f: F.length(f["form"]).between(3, 200))

    def found(f: Column) -> Column:
        quoted = F.regexp_replace(F.regexp_replace(f["form"], r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
        regex = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))
        return F.transform(spans.matches(text, regex), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), f["kind"].alias("kind")))

    ordered = F.sort_array(F.array_distinct(F.flatten(F.transform(usable, found))))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["kind"].alias("kind")))


def without_identities(text: Column, values: Column, grade: int) -> Column:
    """Text with identity values replaced, leftmost first, without overlap."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    apart = F.aggregate(identity_findings(text, values, grade), empty, lambda done, f: F.when((F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] <= f["start"]), F.concat(done, F.array(f))).otherwise(done))
    return spans.spliced(text, apart)


def learned_identities(fields: DataFrame, key: str, limit: int = 256) -> DataFrame:
    """key and the distinct identity values of labelled fields (label, value), `limit` at most, in order of position."""
    category = classify.sensitive_label(F.col("label"))
    known = fields.withColumn("category", category).where(F.col("category").isin("name", "date-of-birth") & (F.trim("value") != ""))
    first = known.groupBy(key, F.trim("value").alias("value"), "category").agg(F.min("position").alias("position"))
    ranked = first.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy("position", "value"))).where(F.col("__rank") <= limit)
    values = F.sort_array(F.collect_list(F.struct("__rank", F.struct("value", "category").alias("v"))))
    return ranked.groupBy(key).agg(F.transform(values, lambda x: x["v"]).alias("values"))


# Markers of fields in a task, in lower case with single blanks.
TASK_MARKER = r"\b(preferred\s+name|applicant\s+name|work\s+email|official\s+email|(?:phone|mobile)(?:\s+number)?|city|benefit\s+plan|coverage\s+start\s+date|requested\s+cent(?:re|er)|transfer\s+type|effective\s+date)\b\s*(?:(?:is|equals?)\s+|[:=]\s*)?"
TASK_TAIL = r"(?is),?\s+(?:then|and then)\s+(?:check|submit|confirm|review|ask)\b.*$"


def task_fields(task: Column, max_length: int = 200) -> Column:
    """A map of the public fields that a task names to their values: the text up to the next marker, the first of each
    field."""
    regex = "(?i)" + TASK_MARKER.replace(r"\b", policy.ASCII_BOUNDARY)

    def key_of(label: Column) -> Column:
        rules = [
            (label.endswith("name"), "preferredName"),
            (label.endswith("email"), "workEmail"),
            (label.rlike("^(?:phone|mobile)"), "phoneNumber"),
            (label.rlike("requested cent(?:re|er)"), "requestedCentre"),
            (label == "transfer type", "transferType"),
            (label == "effective date", "effectiveDate"),
            (label == "city", "city"),
            (label == "benefit plan", "benefitPlan"),
        ]
        return first_match(rules, "startDate")

    def field(span: Column, i: Column, all_: Column) -> Column:
        label = F.regexp_replace(F.lower(F.regexp_extract(F.substring(task, span["start"] + 1, span["end"] - span["start"]), regex, 1)), r"\s+", " ")
        until = F.coalesce(F.get(all_, i + 1)["start"], F.length(task))
        value = F.regexp_replace(F.trim(F.substring(task, span["end"] + 1, until - span["end"])), r"^[,;:\s]+", "")
        value = F.trim(F.regexp_replace(F.regexp_replace(value, TASK_TAIL, ""), r"[\s,;.]+$", ""))
        return F.struct(key_of(label).alias("key"), value.alias("value"))

    from gradeveil.functions.columns import bound

    fields = bound(spans.matches(task, regex), lambda m: F.transform(m, lambda s, i: field(s, i, m)))
    usable = F.filter(fields, lambda f: (f["value"] != "") & (F.length(f["value"]) <= max_length))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    first = F.aggregate(usable, empty, lambda done, f: F.when(F.exists(done, lambda d: d["key"] == f["key"]), done).otherwise(F.concat(done, F.array(f))))
    return F.map_from_entries(first)


def origin_alias(origin: Column, key: bytes) -> Column:
    """A stable alias of a web origin under a key."""
    return F.concat(F.lit("https://site-"), F.substring(hmac_sha256(key, origin), 1, 20), F.lit(".invalid"))


def origin_of(url: Column) -> Column:
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))))


def element_id(snapshot: Column, position: Column) -> Column:
    """A stable id of a page's element: e_ and the first 18 bytes of a digest in URL-safe base64."""
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("\u0001", snapshot, position.cast("string")), 256), 1, 36))
    return F.concat(F.lit("e_"), F.translate(F.base64(digest), "+/", "-_"))
