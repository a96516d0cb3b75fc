"""Sources and sinks: strict JSON documents, PNG pixels, markup, test reports, lock files, secrets, reports and ledgers."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeveil.functions.columns import bound

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
# Ancillary chunks that no outgoing picture may have.
FORBIDDEN_CHUNKS = ["tEXt", "zTXt", "iTXt", "eXIf", "iCCP", "acTL", "fcTL", "fdAT"]
HIGH_CONFIDENCE_SECRET = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}"


def json_objects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents whose top level is an object; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def raw_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one file of JSON text with sorted keys and an indent of two, on any of Spark's file systems;
    more rows are refused."""
    rows = report.limit(2).toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a report has one row")
    text = json.dumps(json.loads(rows[0]), indent=2, sort_keys=True, ensure_ascii=False) + "\n"
    context = report.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def flattened(records: DataFrame, key: str, json_text: str) -> DataFrame:
    """key, path and value (JSON text) of every leaf of JSON records, lists by number: a.b[0].c. Unreadable text gives
    none, empty objects and lists are leaves."""
    kind = dict(records.dtypes)[key]

    def leaves(value: object, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict) and value:
            for name, inner in value.items():
                yield from leaves(inner, f"{path}.{name}" if path else name)
        elif isinstance(value, list) and value:
            for i, inner in enumerate(value):
                yield from leaves(inner, f"{path}[{i}]")
        else:
            yield path, json.dumps(value, ensure_ascii=False)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, paths, values = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(leaves(json.loads(text or ""), ""))
                except ValueError:
                    continue
                rows += [row] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[key, "path", "value"])

    return records.select(key, json_text).mapInArrow(run, f"`{key}` {kind}, path string, value string")


def png_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Types and contents of a PNG's chunks; ValueError for anything damaged."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    at = len(PNG_MAGIC)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body, end = data[at + 8 : at + 8 + size], at + 12 + size
        if end > len(data) or zlib.crc32(name + body) != struct.unpack(">I", data[end - 4 : end])[0]:
            raise ValueError("damaged chunk")
        yield name.decode("ascii", "replace"), body
        at = end
        if name == b"IEND":
            if at != len(data):
                raise ValueError("data behind the end")
            return
    raise ValueError("no end")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit RGB or RGBA picture without interlacing."""
    chunks = list(png_chunks(data))
    if not chunks or chunks[0][0] != "IHDR" or len(chunks[0][1]) != 13:
        raise ValueError("no header")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if depth != 8 or colour not in (2, 6) or packing or filtering or interlace or not width or not height:
        raise ValueError("unsupported format")
    channels = 3 if colour == 2 else 4
    raw = zlib.decompress(b"".join(body for name, body in chunks if name == "IDAT"))
    stride = width * channels
    if len(raw) != height * (stride + 1):
        raise ValueError("wrong amount of data")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, width + 1, channels), np.int32)  # with a border of zeros above and to the left
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].reshape(width, channels).astype(np.int32)
        if kind > 4:
            raise ValueError("unknown filter")
        above = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 2:
            out[y + 1, 1:] = (line + above) & 255
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        else:
            left = np.zeros(channels, np.int32)
            for x in range(width):
                up, corner = out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    estimate = left + up - corner
                    a, b, c = abs(estimate - left), abs(estimate - up), abs(estimate - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = (line[x] + guess) & 255
                out[y + 1, x + 1] = left
    return out[1:, 1:].astype(np.uint8)


def pictures_to_pixels(pictures: DataFrame, key: str, png: str = "png") -> DataFrame:
    """key, x, y, r, g, b, a of every pixel; pictures that cannot be decoded give one row with nulls and an error."""
    kind = dict(pictures.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, data in zip(batch.column(key).to_pylist(), batch.column(png).to_pylist(), strict=True):
                try:
                    pixels = decode_png(data or b"")
                    height, width, channels = pixels.shape
                    y, x = np.divmod(np.arange(height * width), width)
                    flat = pixels.reshape(-1, channels)
                    alpha = flat[:, 3] if channels == 4 else np.full(len(flat), 255)
                    columns = [pa.array([k] * len(flat), batch.schema.field(key).type), *(pa.array(c.astype(np.int32)) for c in (x, y, flat[:, 0], flat[:, 1], flat[:, 2], alpha)), pa.nulls(len(flat), pa.string())]
                except (ValueError, zlib.error) as e:
                    columns = [pa.array([k], batch.schema.field(key).type), *(pa.nulls(1, pa.int32()) for _ in range(6)), pa.array([str(e)])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "x", "y", "r", "g", "b", "a", "error"])

    return pictures.select(key, png).mapInArrow(run, f"`{key}` {kind}, x int, y int, r int, g int, b int, a int, error string")


def forbidden_chunks(pictures: DataFrame, key: str, png: str = "png") -> DataFrame:
    """key and the names of the ancillary chunks that a picture has and must not have; pictures that cannot be read are
    named damaged."""
    kind = dict(pictures.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, names = [], []
            for row, data in enumerate(batch.column(png).to_pylist()):
                try:
                    found = sorted({name for name, _ in png_chunks(data or b"")} & set(FORBIDDEN_CHUNKS))
                except ValueError:
                    found = ["damaged"]
                rows += [row] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], names=[key, "chunk"])

    return pictures.select(key, png).mapInArrow(run, f"`{key}` {kind}, chunk string")


def png_bytes(base64_text: Column) -> Column:
    return F.when(base64_text.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.unbase64(base64_text))


# Markup

TAG = r"(?is)<{0}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


def tags(html: Column, names: str) -> Column:
    """All opening tags with one of the names (a regex alternation)."""
    return F.regexp_extract_all(html, F.lit(TAG.format(f"(?:{names})")), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, or null."""
    value = F.regexp_extract(tag, rf"(?is)\s{re.escape(name)}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.when(value != "", F.regexp_replace(value, r"^[\"']|[\"']$", ""))


def without_scripts(html: Column) -> Column:
    """Markup without scripts, styles, noscript parts and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")


def text_nodes(html: Column, limit: int = 5000) -> tuple[Column, Column]:
    """The texts between tags, and whether there are more than `limit` (then the whole page has to be masked)."""
    nodes = F.filter(F.transform(F.split(without_scripts(html), r"(?s)<[^>]*>"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    return F.slice(nodes, 1, limit), F.size(nodes) > limit


def text_regions(nodes: Column, regions: int = 128, chars: int = 24_000, each: int = 1500) -> Column:
    """The first texts within a budget of regions and characters, each clipped."""
    clipped = F.slice(F.transform(nodes, lambda t: F.substring(t, 1, each)), 1, regions)
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        fits = acc["n"] + F.length(t) <= chars
        return F.struct((acc["n"] + F.length(t)).alias("n"), F.when(fits, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(clipped, start, step, lambda acc: acc["kept"])


# Elements that a person can act on.
INTERACTIVE = "a|button|input|select|textarea|summary|label"


def interactive_elements(pages: DataFrame, key: str, html: str = "html", limit: int = 500) -> DataFrame:
    """key, position, tag, name, type, id and label of a page's controls, `limit` at most, hidden ones left out."""
    found = bound(tags(F.col(html), INTERACTIVE), lambda t: F.filter(t, lambda x: ~x.rlike(r"(?i)\stype\s*=\s*[\"']?hidden")))
    rows = pages.select(key, F.posexplode(F.slice(found, 1, limit)).alias("position", "markup"))
    kind = F.lower(F.regexp_extract("markup", r"^<\s*([A-Za-z0-9]+)", 1))
    label = F.coalesce(attribute(F.col("markup"), "aria-label"), attribute(F.col("markup"), "placeholder"), attribute(F.col("markup"), "title"))
    return rows.select(key, "position", kind.alias("tag"), *(attribute(F.col("markup"), a).alias(a) for a in ("name", "type", "id")), label.alias("label"))


def transferable_controls(pages: DataFrame, key: str, html: str = "html", limit: int = 100, max_value: int = 1000) -> DataFrame:
    """key, position, name, label and value of the text controls of a page whose values may be carried over: `limit` at
    most, without passwords, files and hidden ones, values clipped."""
    found = bound(tags(F.col(html), "input|textarea|select"), lambda t: F.filter(t, lambda x: ~x.rlike(r"(?i)\stype\s*=\s*[\"']?(?:hidden|password|file|checkbox|radio|submit|button|image|reset)")))
    rows = pages.select(key, F.posexplode(F.slice(found, 1, limit)).alias("position", "markup"))
    tag = F.col("markup")
    label = F.coalesce(attribute(tag, "aria-label"), attribute(tag, "placeholder"), attribute(tag, "name"))
    return rows.select(key, "position", attribute(tag, "name").alias("name"), label.alias("label"), F.substring(attribute(tag, "value"), 1, max_value).alias("value"))


# Reports, lock files, secrets

def test_counts(spark: SparkSession, path: str) -> DataFrame:
    """tests, failures, errors, skipped of JUnit reports."""
    cases = spark.read.format("xml").option("rowTag", "testsuite").option("attributePrefix", "_").load(path)
    number = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)) if c in cases.columns else F.lit(0)
    return cases.agg(*(number(f"_{c}").alias(c) for c in ("tests", "failures", "errors", "skipped")))


def lock_components(spark: SparkSession, npm_lock: str) -> DataFrame:
    """name and version of the packages in an npm lock file."""
    text = spark.read.text(npm_lock, wholetext=True)
    packages = F.explode(F.from_json(F.get_json_object("value", "$.packages"), "map<string,struct<version:string>>"))
    rows = text.select(packages.alias("place", "package")).where("place <> ''")
    return rows.select(F.regexp_extract("place", r"(?:.*node_modules/)?(.+)$", 1).alias("name"), F.col("package.version").alias("version")).distinct()


def project_components(spark: SparkSession, pyproject: str) -> DataFrame:
    """name and version requirement of the dependencies in a pyproject file."""
    text = spark.read.text(pyproject, wholetext=True)
    block = F.regexp_extract("value", r"(?s)\bdependencies\s*=\s*\[((?:[^\]\"]|\"[^\"]*\")*)\]", 1)
    entry = F.explode(F.regexp_extract_all(block, F.lit(r"\"([^\"]+)\""), F.lit(1)))
    return text.select(entry.alias("e")).select(F.regexp_extract("e", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.trim(F.regexp_replace("e", r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?", "")).alias("version"))


def secret_files(files: DataFrame) -> DataFrame:
    """Paths of files (path, text) that hold a high-confidence secret."""
    return files.where(F.col("text").rlike(HIGH_CONFIDENCE_SECRET)).select("path")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return raw_bytes(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def lock_violations(locked: DataFrame, files: DataFrame) -> DataFrame:
    """Locked files (path, length, sha256) that are missing or differ."""
    joined = locked.alias("l").join(files.alias("f"), "path", "left")
    what = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("f.length") != F.col("l.length"), "size").when(F.col("f.sha256") != F.col("l.sha256"), "hash")
    return joined.select("path", what.alias("error")).where("error is not null")


# Ledger of jobs, as a table of snapshots by time

LEDGER = "job_id string, snapshot_id string, state string, response_json string, failure string, updated_at double"


def append_jobs(jobs: DataFrame, path: str) -> None:
    jobs.select("job_id", "snapshot_id", "state", "response_json", "failure", "updated_at").write.mode("append").parquet(path)


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each job."""
    last = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.desc("state"))
    return spark.read.schema(LEDGER).parquet(path).withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


def job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """Point lookup; the filter reaches the files."""
    rows = spark.read.schema(LEDGER).parquet(path).where(F.col("job_id") == job_id)
    return rows.orderBy(F.desc("updated_at")).limit(1)


def retained(jobs: DataFrame, now: float, seconds: float = 86_400.0) -> DataFrame:
    return jobs.where(F.col("updated_at") > F.lit(now - seconds))
