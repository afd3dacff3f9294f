"""Readers of records, manifests, logs and artifacts. Each checks its contract when it is called and raises ValueError,
KeyError or FileNotFoundError.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas
from ..operators.dataset import dense_places, duplicates
from .json_arrays import elements
from .shared import literal, plain, qualified, stored

REQUIRED = ("page_id", "image_path", "language", "contains_table", "is_english_table_page")


def _kind_of(v: Column) -> Column:
    """BOOLEAN, STRING, BIGINT, DECIMAL..., VOID, OBJECT... of a value, without what follows in brackets; null if there
    is none.
    """
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def as_text(v: Column) -> Column:
    """A value as a string; null stays null."""
    return F.when(_kind_of(v) != "VOID", v.cast("string"))


def as_number(v: Column) -> Column:
    """A value as a whole number: numbers lose what follows the point, strings of digits are read, true is 1; null stays
    null, and any other fails the query.
    """
    kind, text = _kind_of(v), F.try_variant_get(v, "$", "string")
    written = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(F.trim(text), F.lit("_"), F.lit("")).cast("int"))
    value = F.when(kind == "STRING", written).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).otherwise(F.try_variant_get(v, "$", "double").cast("int"))
    bad = F.raise_error(F.concat(F.lit("no whole number: "), F.to_json(v))).cast("int")
    return F.when(kind.isNotNull() & (kind != "VOID"), F.coalesce(value, bad))


def as_flag(v: Column) -> Column:
    """Whether a value counts as true: not false, 0, empty or null."""
    kind, text = _kind_of(v), F.to_json(v)
    return F.when(kind.isNull() | (kind == "VOID"), F.lit(False)).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(
        kind.isin("STRING", "OBJECT", "ARRAY"), ~text.isin('""', "{}", "[]")
    ).otherwise(F.try_variant_get(v, "$", "double") != 0)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of page records. Unknown keys are passed over, values are coerced (counts given as strings, flags of
    any kind), flags default to false; a file that is no list, a missing key, a count that is no number and a repeated
    page_id raise ValueError.

    The array is read in byte ranges, and each element is parsed once: checks and later uses read the table that the
    parsed rows are kept in.
    """
    entry = elements(spark, path).select(F.parse_json("element").alias("e"))
    get = lambda c: F.try_variant_get("e", f"$.{c}", "variant")
    kinds = dict(f.split() for f in schemas.PAGE_RECORD.split(", "))
    turn = {"string": as_text, "int": as_number, "boolean": as_flag}
    lack = F.array_compact(F.array(*(F.when(get(c).isNull(), F.lit(c)) for c in REQUIRED)))
    try:
        rows = stored(entry.select(*(turn[kind](get(c)).alias(c) for c, kind in kinds.items()), lack.alias("lack")), "records")
    except PySparkException as e:
        raise ValueError(f"{path}: {e}") from e
    if missing := rows.where(F.size("lack") > 0).select(F.explode("lack").alias("c")).distinct().collect():
        raise ValueError(f"{path}: page records lack {[c for c in REQUIRED if c in {r.c for r in missing}]}")
    rows = rows.select(*kinds)
    if again := duplicates(rows, "page_id").take(5):
        raise ValueError(f"{path}: repeated page ids {[r.page_id for r in again]}")
    return rows


def split_page_ids(spark: SparkSession, path: str) -> DataFrame:
    """ord (from 0) and page_id of a split manifest, in its order. Ids that are no strings are taken as they are written.
    """
    rows = stored(elements(spark, path, kinds="", keys=("page_ids",)), "page-ids")
    return dense_places(rows, "offset").select(F.col("place").alias("ord"), as_text(F.parse_json("element")).alias("page_id"))


def log_rows(spark: SparkSession, paths: dict[str, str], schema: str = schemas.ANY_LOG) -> DataFrame:
    """The rows of several systems' JSONL logs (files or folders): system_id, line_no and the log's columns. Blank lines
    are skipped; a line that is no object raises ValueError, a path that isn't there FileNotFoundError.

    A log that its rows number (a key line_no) keeps these numbers. Otherwise lines are numbered in the order of files
    and lines: files are read as lines, in splits; each split's lines are counted, and a line's number is its place in
    its split and the lines of the splits before.
    """
    if not paths:
        return spark.createDataFrame([], f"system_id string, line_no long, {schema}")
    own = {}
    for system, path in paths.items():
        try:
            own[system] = [plain(f) for f in spark.read.text(literal(path)).inputFiles()]
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
    listed = spark.createDataFrame([(f, s) for s, files in own.items() for f in files], "file string, system_id string")
    if len({f for files in own.values() for f in files}) < listed.count():
        raise ValueError("two systems share a log")
    lines = spark.read.text([literal(f) for files in own.values() for f in files]).select(
        "value", plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id")
    )
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).join(listed, "file")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("system_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.join(splits.select("system_id", "file", "block", "low", before.alias("before")), ["file", "block"])
    rows = rows.select("system_id", (F.col("before") + F.col("id") - F.col("low")).alias("line_no"), "value").where(F.trim("value") != "")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    if bad := rows.where(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).orderBy("system_id", "line_no").take(1):
        raise ValueError(f"{bad[0].system_id}: line {bad[0].line_no} is no object")
    rows = rows.withColumn("row", F.from_json("value", schema)).withColumn("line_no", F.coalesce(F.get_json_object("value", "$.line_no").cast("long"), "line_no"))
    return rows.select("system_id", "line_no", "row.*")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """page_id and html of a flat JSON object, of which a repeated key's last value counts; values that are no strings
    raise ValueError.
    """
    member = elements(spark, path, kinds="{").select("offset", F.concat(F.lit("{"), "element", F.lit("}")).alias("m"))
    pair = member.select("offset", F.explode(F.from_json("m", "map<string,variant>", {"mode": "FAILFAST"})).alias("page_id", "v"))
    html = F.when(_kind_of(F.col("v")) == "STRING", F.col("v").cast("string"))
    try:
        rows = stored(pair.select("offset", "page_id", html.alias("html")), "gold")
    except PySparkException as e:
        raise ValueError(f"{path}: {e}") from e
    if bad := rows.where("html is null").take(1):
        raise ValueError(f"{path}: the HTML of {bad[0].page_id} is no string")
    return rows.groupBy("page_id").agg(F.max_by("html", "offset").alias("html"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """A column `entry` (VARIANT) of a JSON list, or of the list under data or annotations."""
    return elements(spark, path, keys=("data", "annotations")).select(F.parse_json("element").alias("entry"))


def images(spark: SparkSession, records: DataFrame, root: str) -> DataFrame:
    """Records with their image's bytes; FileNotFoundError names images that aren't there."""
    base = qualified(spark, root.rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal(base)).select(F.regexp_replace("path", r"^(\w+):/+", "$1:/").alias("file"), "content")
    wanted = records.withColumn("file", F.concat(F.lit(f"{base}/"), "image_path"))
    if lost := wanted.join(files.select("file"), "file", "left_anti").take(5):
        raise FileNotFoundError(", ".join(r.image_path for r in lost))
    return wanted.join(files, "file").drop("file")


def sidecars(spark: SparkSession, run_dir: str) -> DataFrame:
    """A run's page sidecars and their raw text, by page_id: from pages/, else final/pages/; FileNotFoundError without
    either. The text stands at the sidecar's raw_output_path, from the run's folder or from the one that holds pages/; a
    page whose text is missing has a null.

    The folder's name may hold any letters: where a file stands in the run is what follows the folder's length.
    """
    base = qualified(spark, run_dir.rstrip("/"))
    for place in ("", "final/"):
        try:
            rows = spark.read.option("pathGlobFilter", "*.json").json(literal(f"{base}/{place}pages"), multiLine=True)
        except AnalysisException:
            continue
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(literal(f"{base}/{place}".rstrip("/")), wholetext=True)
        raw = texts.select(F.col("value").alias("raw_text"), F.substr(plain(F.col("_metadata.file_path")), F.lit(len(base) + 2)).alias("file"))
        rows = rows.drop("raw_text")
        named = rows.withColumn("file", F.when(F.col("raw_output_path").startswith(place), F.col("raw_output_path")).otherwise(F.concat(F.lit(place), "raw_output_path")))
        return named.join(raw, "file", "left").drop("file").orderBy("page_id")
    raise FileNotFoundError(f"{run_dir}: neither pages nor final/pages")


def sha256(spark: SparkSession, path: str) -> str:
    rows = spark.read.format("binaryFile").load(literal(path)).select(F.sha2("content", 256)).take(1)
    if not rows:
        raise FileNotFoundError(path)
    return rows[0][0]
