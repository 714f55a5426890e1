"""Readers for delimited, JSON, fixed-width and archived sources, all with explicit schemas."""

from __future__ import annotations

import csv
import json
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.operators.quality import union_all


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def head_lines(path: str, n: int = 50) -> list[str]:
    """The first lines of a file or folder on any file system that Spark reads."""
    spark = SparkSession.active()
    return [r[0] for r in spark.read.text(path).head(n)]


def sniff_delimiter(path: str) -> str:
    """The likeliest of comma, tab, pipe and semicolon in the head of a file: the one that most often splits its lines evenly,
    outside of quotes."""
    head = [re.sub(r'"[^"]*"', "", line) for line in head_lines(path)]
    score = {d: min((line.count(d) for line in head if line), default=0) * 1000 + sum(line.count(d) for line in head) for d in (",", "\t", "|", ";")}
    return max(score, key=score.get)


def header(path: str, delimiter: str) -> list[str]:
    """Column names of the first line, quoted ones too; blank names become col_i, repeated ones get their place."""
    first = head_lines(path, 1)
    names = [c.strip() for c in next(csv.reader(first, delimiter=delimiter), [])]
    seen: set[str] = set()
    out = []
    for i, c in enumerate(names):
        c = c or f"col_{i}"
        out.append(f"{c}_{i}" if c in seen else c)
        seen.add(c)
    return out


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str | None = None, mode: str = "PERMISSIVE", multiline: bool = True) -> DataFrame:
    """A delimited file as strings. mode: PERMISSIVE pads short rows with nulls and cuts long ones, DROPMALFORMED leaves them
    out, FAILFAST raises. Delimiter and columns are taken from the file's head if not given."""
    delimiter = delimiter or sniff_delimiter(path)
    columns = columns or header(path, delimiter)
    return spark.read.csv(path, schema=strings(columns), header=True, sep=delimiter, quote='"', escape='"', mode=mode, multiLine=multiline, enforceSchema=True)


def read_inferred(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file with types inferred from all of it."""
    return spark.read.csv(path, header=True, inferSchema=True, sep=delimiter or sniff_delimiter(path), quote='"', escape='"', multiLine=True)


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with inferred types; if any record doesn't fit them, all of it as strings.

    The file is read once to infer and once to try, so that what is returned can't fail later.
    """
    delimiter = sniff_delimiter(path)
    typed = spark.read.csv(path, header=True, inferSchema=True, sep=delimiter, quote='"', escape='"', multiLine=True, mode="FAILFAST")
    try:
        typed.write.format("noop").mode("overwrite").save()
    except Exception:  # noqa: BLE001  whatever doesn't read as typed reads as text
        return read_delimited(spark, path, delimiter=delimiter)
    return typed


def read_many(spark: SparkSession, paths: list[str], **options) -> DataFrame:  # noqa: ANN003
    """Several delimited files of differing columns in one table, by name."""
    return union_all([read_delimited(spark, p, **options) for p in paths])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; lines that can't be read are left out; bare values go to the column `value`, if any."""
    fields = T._parse_datatype_string(schema)
    line = F.trim("value")
    parsed = spark.read.text(path).filter(line != "").select(F.from_json("value", T.StructType([*fields.fields, T.StructField("__bad", T.StringType())]), {"columnNameOfCorruptRecord": "__bad"}).alias("j"), line.alias("raw"))
    rows = parsed.filter(F.col("j.__bad").isNull() & F.col("raw").startswith("{")).select(*[F.col(f"j.{f.name}") for f in fields.fields])
    if "value" not in fields.fieldNames():
        return rows
    scalar = parsed.filter(F.col("raw").rlike(r'^(-?[0-9.eE+]+|"[^"]*"|true|false|null)$'))
    return rows.unionByName(scalar.select(F.trim("raw", F.lit('"')).alias("value")), allowMissingColumns=True)


def read_json_records(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON document that is an object of records, or an array of them: one row per record, with its key or position."""
    text = spark.read.text(path, wholetext=True)
    record = T._parse_datatype_string(value_schema)
    as_map = F.from_json("value", T.MapType(T.StringType(), record))
    as_list = F.from_json("value", T.ArrayType(record))
    is_list = F.ltrim("value").startswith("[")
    maps = text.filter(~is_list).select(F.explode(as_map).alias("key", "r")).select("key", "r.*")
    lists = text.filter(is_list).select(F.posexplode(as_list).alias("key", "r")).select(F.col("key").cast("string"), "r.*")
    return maps.unionByName(lists)


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that is a list of bare values, or one bare value: a row each, as text in the column `value`."""
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    rows = spark.read.text(path, wholetext=True).select(text.alias("t"))
    bare = F.transform(F.from_json("t", "array<string>"), lambda x: x)
    one = F.when(F.col("t").rlike('^".*"$'), F.from_json(F.concat(F.lit("["), F.col("t"), F.lit("]")), "array<string>")).otherwise(F.array("t"))
    return rows.select(F.explode(F.when(F.col("t").startswith("["), bare).otherwise(one)).alias("value"))


def read_series(spark: SparkSession, path: str, series: str | None = None) -> DataFrame:
    """Energy-series JSON lines: series_id, name, units, period, value, place (1 is the newest point)."""
    j = F.from_json("value", "series_id string, name string, units string, data array<array<string>>")
    rows = spark.read.text(path).select(j.alias("j")).filter(F.col("j.series_id").isNotNull())
    if series:
        rows = rows.filter(F.col("j.series_id").contains(series))
    points = rows.select("j.series_id", "j.name", "j.units", F.posexplode("j.data").alias("i", "p"))
    return points.select("series_id", "name", "units", F.col("p")[0].alias("period"), F.col("p")[1].try_cast("double").alias("value"), (F.col("i") + 1).alias("place"))


def read_fixed_width(df: DataFrame, fields: dict[str, tuple[int, int]], column: str = "value") -> DataFrame:
    """Text rows cut at fixed places: name to (start, end), from 0, end exclusive; trimmed."""
    return df.select(*[F.trim(F.substring(column, a + 1, b - a)).alias(n) for n, (a, b) in fields.items()])


def read_positional_imports(df: DataFrame, column: str = "value") -> DataFrame:
    """Import records by place: hs (first 10), month (first 20YYMM behind them), weight (first number of 4 digits or more
    behind place 60, 1 if none)."""
    return df.select(
        F.trim(F.substring(column, 1, 10)).alias("hs"), F.nullif(F.regexp_extract(F.substring(F.col(column), 11, 1 << 20), r"(20[0-9]{4})", 1), F.lit("")).alias("month"),
        F.coalesce(F.nullif(F.regexp_extract(F.substring(F.col(column), 61, 1 << 20), r"([0-9]{4,})", 1), F.lit("")).try_cast("double"), F.lit(1.0)).alias("weight"),
    )


def _salvaged(text: str) -> Iterator[dict]:
    """Features of a GeoJSON text, up to the first that is cut off."""
    at = text.find('"features"')
    at = text.find("[", at) + 1 if at >= 0 else len(text)
    decoder = json.JSONDecoder()
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] != "{":
            return
        try:
            feature, at = decoder.raw_decode(text, at)
        except ValueError:
            return
        yield feature


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features: properties and geometry as JSON text, one row each; a truncated file gives what is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f for raw in batch.column("content").to_pylist() for f in _salvaged(bytes(raw).decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([json.dumps(f.get(k), separators=(",", ":")) if f.get(k) is not None else None for f in rows], pa.string()) for k in ("properties", "geometry")], names=["properties", "geometry"]
            )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "properties string, geometry string")


def read_zipped_lines(spark: SparkSession, path: str, member: str = "", encoding: str = "latin-1") -> DataFrame:
    """Lines of the members of zip archives whose name contains `member`: archive, member, line_no, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(BytesIO(bytes(raw))) as z:
                    for info in z.infolist():
                        if member in info.filename and not info.is_dir():
                            lines = z.read(info).decode(encoding, "replace").splitlines()
                            for a in range(0, len(lines), 50_000):
                                part = lines[a : a + 50_000]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([name] * len(part)), pa.array([info.filename] * len(part)), pa.array(range(a, a + len(part)), pa.int64()), pa.array(part)], names=["archive", "member", "line_no", "value"]
                                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line_no bigint, value string")


def sheet_metric(cells: DataFrame, sheet: str, label: str, least: float = 100.0) -> DataFrame:
    """The largest number of at least `least` in the rows of a workbook's sheets that hold a label.

    `cells`: sheet, row, text, numbers (array). Sheets and labels are matched as substrings without case.
    """
    rows = cells.filter(F.lower("sheet").contains(sheet.lower()) & F.lower("text").contains(label.lower()))
    value = F.array_max(F.filter("numbers", lambda x: x >= least))
    return rows.groupBy("sheet").agg(F.max(value).alias("metric"))


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an xlsx workbook as (sheet, row, text, numbers), read on the driver; needs the optional package openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    rows = []
    for sheet in book:
        for i, row in enumerate(sheet.iter_rows(values_only=True)):
            rows.append((sheet.title, i, " ".join(str(c) for c in row if isinstance(c, str)), [float(c) for c in row if isinstance(c, (int, float))]))
    return spark.createDataFrame(rows, "sheet string, row int, text string, numbers array<double>")


def inventory(spark: SparkSession, path: str, most: int = 500 << 20) -> DataFrame:
    """Files below a path with size, time, format and release; the signature is that of the content up to `most` bytes, of
    larger ones of size and time. The content of larger files isn't read: the scan filters by length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = ["path", "length", "modificationTime", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format")]
    release = F.regexp_extract("path", r"release=(\d{4}-\d{2}-\d{2})", 1).alias("release")
    small = files.filter(F.col("length") <= most).select(*columns, F.md5("content").alias("signature"), release)
    large = files.filter(F.col("length") > most).select(*columns, F.concat_ws("-", F.col("length"), F.unix_timestamp("modificationTime")).alias("signature"), release)
    return small.unionByName(large)


def ranked_candidates(files: DataFrame, family: str = "family") -> DataFrame:
    """The file to use of each family: valid ones first, then today's overlay, the root, the newest release; then time and size.

    `files`: family, path, place (today, root or release), release, length, modificationTime, reason (null if valid).
    """
    from loadstone.operators.quality import newest

    place = F.when(F.col("place") == "today", 0).when(F.col("place") == "root", 1).otherwise(2)
    order = [F.col("reason").isNotNull(), place, F.col("release").desc_nulls_last(), F.col("modificationTime").desc_nulls_last(), F.col("length").desc_nulls_last(), F.col("path")]
    return newest(files, [F.col(family)], order)
