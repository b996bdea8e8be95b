"""Series files: CSV, DAT, Arrow, Parquet and tick files as series frames.

The result has ``row`` (the line's place, from 1), ``t`` (null without time
column) and ``x`` (null where missing). The order of a file is that of its lines,
that of a folder's files that of their names. Text is read in splits: a first pass
counts the lines of each, one row a split, and a second numbers them.
"""

from __future__ import annotations

import csv
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.neighbours import numbered

# Fixed values of the data model: nanoseconds in a unit of the time axis.
UNIT_NANOSECONDS = {"nanosecond": 1, "microsecond": 1000, "millisecond": 10**6, "second": 10**9, "minute": 60 * 10**9, "hour": 3600 * 10**9, "day": 86400 * 10**9}
TIME_UNITS = ("sample", *UNIT_NANOSECONDS)
FORMATS = {".csv": "csv", ".dat": "dat", ".arrow": "arrow", ".feather": "arrow", ".parquet": "parquet"}
TICK = {"time_column": "time_ns", "value_column": "price", "time_unit": "nanosecond", "epoch_unit": "nanosecond"}


@dataclass(frozen=True)
class SeriesOptions:
    format: str = ""
    value_column: str | int = 1
    time_column: str | int = ""
    time_unit: str = "sample"
    time_format: str = ""
    epoch_unit: str = "second"
    delimiter: str = ""
    header: bool = True
    missing_policy: str = "drop"
    order_column: str = ""


def infer_format(path: str) -> str:
    suffix = re.search(r"\.[^./]*$", path.rstrip("/"))
    if not suffix or suffix[0].lower() not in FORMATS:
        raise ValueError(f"can't tell the format of {path!r}; known are {', '.join(FORMATS)}")
    return FORMATS[suffix[0].lower()]


def column_name(columns: list[str], wanted: str | int) -> str:
    """A column by its name or its place, counted from 1."""
    if isinstance(wanted, int) or wanted.isdigit() and wanted not in columns:
        if not 1 <= int(wanted) <= len(columns):
            raise ValueError(f"no column {wanted}; there are {columns}")
        return columns[int(wanted) - 1]
    if wanted not in columns:
        raise ValueError(f"no column {wanted!r}; there are {columns}")
    return wanted


def java_format(text: str) -> str:
    """Date letters ``yyyymmdd HHMMSS`` as Spark writes them."""
    return re.sub(r"y+|m+|d+|H+|M+|S+|s+", lambda m: {"y": "y", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "s": "S"}[m[0][0]] * len(m[0]), text)


def nanoseconds(text: Column, time_format: str, epoch_unit: str) -> Column:
    """Epoch nanoseconds of a number in ``epoch_unit``, an ISO 8601 stamp of up to nine decimals, or a format.

    ``text`` is the column ``_text``. Stamps without zone are in UTC, whatever the session's zone.
    """
    wall = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
    if time_format:
        parsed = f"cast(try_to_timestamp(trim(_text), '{java_format(time_format)}') as timestamp_ntz)"
        return F.expr(wall.format(parsed)) * 1000
    clean = F.trim(text)
    number = F.expr("try_cast(_text as decimal(38,9))")
    if epoch_unit not in UNIT_NANOSECONDS:
        raise ValueError(f"unknown epoch unit {epoch_unit!r}")
    counted = (number * F.lit(UNIT_NANOSECONDS[epoch_unit])).cast("long")
    whole = "regexp_replace(trim(_text), '[.][0-9]+', '')"
    part = F.rpad(F.regexp_extract(clean, r"\.(\d{1,9})", 1), 9, "0").cast("long")
    zoned = clean.rlike(r"(?i)(z|[+-]\d\d(:?\d\d)?)$") & clean.contains(":")
    second = F.when(zoned, F.expr(f"unix_micros(try_to_timestamp({whole}))")).otherwise(F.expr(wall.format(f"try_cast({whole} as timestamp_ntz)")))
    stamp = second * 1000 + F.coalesce(F.when(clean.contains("."), part), F.lit(0))
    return F.when(number.isNotNull(), counted).otherwise(stamp)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, at, value)``: lines with their place in their file and among all; blank ones count."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts, place, last, at = {}, 0, None, 0
    for file, block, n in sorted(map(tuple, raw.groupBy("file", "block").count().collect())):
        place = place if file == last else 0
        starts[file, block] = (place, at)
        place, at, last = place + n, at + n, file
    shared = spark.sparkContext.broadcast(starts)

    def numbered(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            value, files, blocks = (c.to_pylist() for c in b.columns)
            lines, places = [], []
            for key in zip(files, blocks):
                n = seen[key] = seen.get(key, 0) + 1
                line, at = shared.value[key]
                lines.append(line + n)
                places.append(at + n)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(lines, pa.int64()), pa.array(places, pa.int64()), b.column(0)], names=["file", "line", "at", "value"])

    return raw.mapInArrow(numbered, "file string, line long, at long, value string")


def _split(lines: DataFrame, delimiter: str | None) -> DataFrame:
    """``lines`` with their ``cells``: quoted as CSV files do it, or between runs of blanks without a delimiter."""

    def split(batches):
        for b in batches:
            values = b.column("value").to_pylist()
            cells = [v.split() for v in values] if delimiter is None else [next(csv.reader([v], delimiter=delimiter), []) for v in values]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("line"), b.column("at"), pa.array(cells, pa.list_(pa.string()))], names=["file", "line", "at", "cells"])

    return lines.mapInArrow(split, "file string, line long, at long, cells array<string>")


def _arrow_tables(spark: SparkSession, path: str) -> DataFrame:
    def numbered(batches):
        for b in batches:
            for content in b.column("content"):
                t = pa.ipc.open_file(pa.BufferReader(content.as_buffer())).read_all()
                cols = [c.cast(pa.string()) if not pa.types.is_floating(c.type) else pa.array([None if x is None else repr(x) for x in c.to_pylist()], pa.string()) for c in t.columns]
                yield from pa.table([pa.array(range(1, t.num_rows + 1), pa.int64()), *cols], names=["row", *t.column_names]).to_batches()

    def named(batches):
        for b in batches:
            for content in b.column("content"):
                schema = pa.ipc.open_file(pa.BufferReader(content.as_buffer())).schema
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(schema.names)])], names=["names"])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(named, "names string").distinct().collect()
    if len(found) != 1:
        raise ValueError(f"{path} must be one Arrow file or several with the same columns")
    return files.mapInArrow(numbered, ", ".join(["row long", *(f"`{n}` string" for n in json.loads(found[0][0]))]))


def _cells(spark: SparkSession, path: str, form: str, o: SeriesOptions) -> DataFrame:
    if form == "parquet":
        df = spark.read.parquet(path)
        if not o.order_column:
            raise ValueError("a Parquet series needs order_column")
        if df.schema[o.order_column].dataType.typeName() in ("integer", "long", "short", "byte"):
            return numbered(df, (), o.order_column, "row")
        return df.withColumn("row", F.row_number().over(Window.orderBy(o.order_column)).cast("long"))
    if form == "arrow":
        return _arrow_tables(spark, path)
    lines = _split(_lines(spark, path), None if form == "dat" else o.delimiter or ",")
    head = lines.where("line = 1").select("cells").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = [n.strip() for n in head[0]] if o.header else [f"Column{i + 1}" for i in range(len(head[0]))]
    if not o.header:
        body, row = lines, F.col("at")
    else:
        # every file has its own header
        before = {f: i + 1 for i, (f,) in enumerate(sorted(map(tuple, lines.where("line = 1").select("file").collect())))}
        headers = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        body, row = lines.where("line > 1"), F.col("at") - headers[F.col("file")]
    return body.select(row.cast("long").alias("row"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_series(spark: SparkSession, path: str, **options) -> DataFrame:
    """The series of a file; see :class:`SeriesOptions` for the options.

    Blank, unreadable and non-finite values are missing, or an error under
    ``missing_policy="error"``. Times must be whole numbers of the unit.
    """
    form = options.get("format") or infer_format(path)
    if form == "tick":
        if options.get("epoch_unit", "nanosecond") != "nanosecond":
            raise ValueError("tick files count nanoseconds")
        options = {**TICK, **{k: v for k, v in options.items() if v not in ("", None)}}
        form = "csv"
    o = SeriesOptions(**{**options, "format": form})
    if (o.time_column == "") != (o.time_unit == "sample"):
        raise ValueError("a time column needs a unit other than sample, and the other way round")
    if o.time_unit not in TIME_UNITS or o.missing_policy not in ("drop", "error"):
        raise ValueError("unknown time unit or missing policy")
    cells = _cells(spark, path, form, o)
    columns = [c for c in cells.columns if c != "row"]
    value = F.col(column_name(columns, o.value_column)).cast("string")
    x = F.expr("try_cast(trim(_value) as double)")
    picked = cells.select("row", value.alias("_value"), (F.col(column_name(columns, o.time_column)).cast("string") if o.time_column != "" else F.lit(None).cast("string")).alias("_text"))
    ns = nanoseconds(F.col("_text"), o.time_format, o.epoch_unit) if o.time_column != "" else None
    out = picked.select("row", F.lit(None).cast("long").alias("_ns") if ns is None else ns.alias("_ns"), F.col("_text"), x.alias("x"))
    out = out.withColumn("x", F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")))
    if ns is None:
        t = F.col("_ns")
    else:
        unit = UNIT_NANOSECONDS[o.time_unit]
        bad = F.col("_ns").isNull() | (F.col("_ns") % unit != 0)
        t = F.when(bad, F.raise_error(F.concat(F.lit("not a whole number of the unit: "), F.coalesce("_text", F.lit("")))).cast("long")).otherwise(F.expr(f"_ns div {unit}"))
    if o.missing_policy == "error":
        out = out.withColumn("x", F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("missing value in row "), F.col("row").cast("string"))).cast("double")).otherwise(F.col("x")))
    return out.select("row", t.alias("t"), "x")


def sample_axis(df: DataFrame) -> DataFrame:
    """Times of a series without any: places counted from the first observed row; missing rows keep theirs."""
    seen = F.when(F.col("x").isNotNull(), F.col("row"))
    return df.crossJoin(F.broadcast(df.agg(F.min(seen).alias("_a"), F.max(seen).alias("_b")))).where("row BETWEEN _a AND _b").select("row", (F.col("row") - F.col("_a") + 1).alias("t"), "x")


def read_declared_gaps(path: str) -> list[tuple[int, int, str, str]]:
    """``(start, stop, kind, source)`` of a TOML file with ``intervals`` and ``[[gaps]]``."""
    import tomllib

    with open(path, "rb") as f:
        table = tomllib.load(f)
    kind, source = table.get("kind", "declared"), table.get("source", "")
    found = [(int(a), int(b), kind, source) for a, b in table.get("intervals", [])]
    return found + [(int(g["start"]), int(g["stop"]), g.get("kind", kind), g.get("source", source)) for g in table.get("gaps", [])]
