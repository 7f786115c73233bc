"""CSV with inferred or given row types, and Parquet."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import parsed, text_of
from ..operators.frame import Frame, hidden, quoted
from ..shared import located, new_folder
from ..types import BOOL, CHAR, DATE, FLOAT, INT, STRING, TIME, TIMESTAMP, Row, Type, from_spark

#: Data rows from which a row type is inferred.
SAMPLE_ROWS = 9
#: Buffer with which parts of a stored CSV are copied.
COPY_BYTES = 1 << 20
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8})"
_TIME = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
#: In order of trial: what each non-empty cell must be, and whether cells may be empty.
_SHAPES = (
    (INT, re.compile(r"[+-]?\d+"), True),
    (FLOAT, re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(nan|inf)", re.IGNORECASE), True),
    (BOOL, re.compile("true|false"), False),
    (TIME, re.compile(_TIME), True),
    (DATE, re.compile(_DATE), True),
    (TIMESTAMP, re.compile(rf"{_DATE}[ T]{_TIME}"), True),
)


def _cell_type(cells: list[str]) -> Type:
    held = [c for c in cells if c]
    if not held:
        return STRING
    for t, shape, blanks in _SHAPES:
        if (blanks or len(held) == len(cells)) and all(shape.fullmatch(c) for c in held):
            if t is not INT or all(-(2**63) <= int(c) < 2**63 for c in held):
                return t
    return STRING


def column_names(header: list[str]) -> list[str]:
    """Names fit for expressions: other characters to ``_``, lower case, numbered where alike."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, cell in enumerate(header):
        name = re.sub(r"[^0-9A-Za-z_]", "_", cell).lower() or f"unnamed_{i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


def infer_row(spark: SparkSession, path: str) -> Row:
    """Row type of a CSV from its header and first rows; a bounded read on the driver."""
    lines = [r[0] for r in spark.read.text(path).limit(50 * (SAMPLE_ROWS + 1)).collect()]
    rows = []
    for r in csv.reader(io.StringIO("\n".join(lines))):
        rows.append(r)
        if len(rows) > SAMPLE_ROWS:
            break
    if not rows:
        return {}
    names = column_names(rows[0])
    cells = [[r[i] if i < len(r) else "" for r in rows[1:]] for i in range(len(names))]
    return {n: _cell_type(c) for n, c in zip(names, cells)}


def _cells(spark: SparkSession, path: str, row: Row, reader=None) -> DataFrame:
    """Text cells by position: short rows padded, further cells ignored."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(row))])
    return (reader or spark.read).schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=True, quote='"', escape='"', nullValue="\0", emptyValue="")


def typed(cells: DataFrame, row: Row, *keep) -> DataFrame:
    return cells.select(*(parsed(F.coalesce(F.col(f"c{i}"), F.lit("")), t).alias(n) for i, (n, t) in enumerate(row.items())), *keep)


def csv_load(spark: SparkSession, path: str, row: Row) -> Frame:
    """A CSV under a given row type; a cell that does not parse is missing."""
    f, b, h = hidden(), hidden(), hidden()
    cells = _cells(spark, path, row)
    at = [F.col("_metadata.file_path").alias(f), F.col("_metadata.file_block_start").alias(b), F.monotonically_increasing_id().alias(h)]
    return Frame(typed(cells, row, *at), row, [(f, True), (b, True), (h, True)])


def load(spark: SparkSession, path: str) -> Frame:
    """A CSV under its inferred row type."""
    return csv_load(spark, path, infer_row(spark, path))


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> Frame:
    """A Parquet table in file order; columns of other types than the nine stay untyped in ``df``."""
    df = spark.read.parquet(path)
    f, i = hidden(), hidden()
    row = {x.name: t for x in df.schema if (t := from_spark(x.dataType)) and (columns is None or x.name in columns)}
    from ..functions.nil import stored

    cols = [stored(quoted(n), t, df.schema[n].dataType).alias(n) for n, t in row.items()]
    rest = [] if columns else [quoted(c) for c in df.columns if c not in row]
    return Frame(df.select(*cols, *rest, F.col("_metadata.file_path").alias(f), F.col("_metadata.row_index").alias(i)), row, [(f, True), (i, True)])


def _cell(text: Column, t: Type) -> Column:
    """Text of a value as a cell; only texts and characters can need quotes."""
    if t not in (STRING, CHAR):
        return text
    needs = text.contains(",") | text.contains('"') | text.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_store(frame: Frame, path: str, single: bool = True) -> None:
    """Write CSV with a header, in row order.

    Sorted parts are written in parallel.  ``single`` joins them to one file at ``path``,
    whose bytes the driver copies; without it they stay a folder, and have no header.  A
    cell is quoted where it holds a comma; a quote inside is doubled.  Floats take six
    decimals without the zeros at the end.
    """
    cells = [_cell(text_of(quoted(n), t), t) for n, t in frame.row.items()]
    df = frame.df.orderBy(*frame.order_by()) if frame.order else frame.df
    lines = df.select(F.concat_ws(",", *cells).alias("value"))
    if not single:
        lines.write.mode("overwrite").text(path)
        return
    spark = frame.spark
    hadoop = spark._jvm.org.apache.hadoop
    folder = new_folder(spark)
    lines.write.mode("overwrite").option("compression", "none").option("lineSep", "\n").text(folder)
    at, source = located(spark, folder)
    parts = [p.getPath() for p in source.listStatus(at) if p.getPath().getName().startswith("part-")]
    parts.sort(key=lambda p: [*map(int, re.fullmatch(r"part-(\d+).*-c(\d+)\D*", p.getName()).groups())])
    target, files = located(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray((",".join(frame.row) + "\n").encode()))
        for p in parts:  # bytes from file to file, within the JVM
            part = source.open(p)
            try:
                hadoop.io.IOUtils.copyBytes(part, out, COPY_BYTES)
            finally:
                part.close()
            source.delete(p, False)
    finally:
        out.close()
        source.delete(at, True)
