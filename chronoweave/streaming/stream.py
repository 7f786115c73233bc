"""Streams of typed rows: projections, filters and running aggregates.

A running aggregate is a stateful group-by whose state merges partial results, so an
empty or one-row batch leaves means and variances right.  Row order, sorts and joins that
need it are refused on a stream; ``each_batch`` gives them per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import QueryError
from ..functions.expr import Expr, column, compiled, has_aggregate
from ..functions.nil import stored
from ..operators.frame import Frame, Items, quoted
from ..shared import new_folder
from ..sources.files import _cells, infer_row, typed
from ..types import BOOL, Row, from_spark


class StreamFrame:
    """An unbounded table of ``row`` types."""

    mode = "Stream"

    def __init__(self, df: DataFrame, row: Row):
        if not df.isStreaming:
            raise QueryError("a StreamFrame needs a streaming DataFrame")
        self.df, self.row = df, dict(row)

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_") or name not in self.row:
            raise AttributeError(name)
        return column(name, self.row[name])

    def __getitem__(self, name: str) -> Expr:
        if name not in self.row:
            raise QueryError(f"no column {name}")
        return column(name, self.row[name])

    def _items(self, items: Items, what: str) -> list[tuple[str, Expr]]:
        return Frame(self.df, self.row)._items(items, what)

    def watermark(self, time: str, delay: str) -> StreamFrame:
        """Drop state that is ``delay`` behind the latest ``time``."""
        df = self.df.withColumn(time, quoted(time).cast("timestamp")).withWatermark(time, delay)
        return StreamFrame(df, self.row)

    def where(self, p: Expr) -> StreamFrame:
        if p.type is not BOOL or has_aggregate(p):
            raise QueryError("where takes a Bool of each row")
        return StreamFrame(self.df.where(compiled(p)), self.row)

    def query(self, select: Items = None, by: Items = None, where: Expr | None = None) -> StreamFrame:
        """Rows one by one, or running aggregates by keys (of the whole stream: by=())."""
        if where is not None:
            return self.where(where).query(select, by)
        if select is None:
            return self
        items = self._items(select, "column")
        if by is None and not any(has_aggregate(e) for _, e in items):
            if any(not e.array for _, e in items):
                raise QueryError("resulting column must be an array")
            return StreamFrame(self.df.select(*(compiled(e).alias(n) for n, e in items)), {n: e.type for n, e in items})
        keys = self._items(by, "group")
        for n, e in items:
            if e.array:
                raise QueryError(f"resulting column must be a scalar: {n}")
        out = self.df.groupBy(*(compiled(e).alias(n) for n, e in keys)).agg(*(compiled(e).alias(n) for n, e in items))
        return StreamFrame(out, {n: e.type for n, e in [*keys, *items]})

    def windowed(self, time: str, width: str, select: Items, by: Items = (), slide: str | None = None) -> StreamFrame:
        """Aggregates by event-time windows, which a watermark can close."""
        items, keys = self._items(select, "column"), self._items(by, "group")
        window = F.window(quoted(time), width, slide) if slide else F.window(quoted(time), width)
        out = self.df.groupBy(window.alias("_w"), *(compiled(e).alias(n) for n, e in keys)).agg(*(compiled(e).alias(n) for n, e in items))
        start = F.col("_w.start").cast("timestamp_ntz").alias(time)
        return StreamFrame(out.select(start, *(quoted(n) for n, _ in [*keys, *items])), {time: self.row[time]} | {n: e.type for n, e in [*keys, *items]})

    def sort(self, *by: object) -> StreamFrame:
        raise QueryError("a stream has no order; sort inside each_batch")

    reverse = join = sort

    def each_batch(self, f: Callable[[Frame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Call ``f`` with each micro-batch as a Frame."""
        def run(df: DataFrame, n: int) -> None:
            f(Frame(df, self.row), n)

        writer = self.df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def start(self, folder: str, mode: str = "complete", trigger: dict | None = None) -> StreamingQuery:
        """Write each micro-batch's rows as Parquet under ``folder``/rows, by its number.

        A batch that is repeated after a failure overwrites its own rows.  In complete mode
        each batch holds the whole result.  Offsets and state are kept under ``folder`` too,
        which driver and executors must share.
        """

        def write(df: DataFrame, n: int) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

        writer = self.df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def so_far(self, mode: str = "complete", folder: str | None = None) -> Frame:
        """The result over all input that is there now."""
        spark = self.df.sparkSession
        folder = folder or new_folder(spark)
        q = self.start(folder, mode)
        try:
            q.awaitTermination()
        finally:
            q.stop()
        try:
            rows = spark.read.parquet(f"{folder}/rows")
        except AnalysisException:  # no batch was written
            return Frame(spark.createDataFrame([], self.df.schema).select(*map(quoted, self.row)), self.row)
        if mode == "complete":
            rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
        return Frame(rows.select(*map(quoted, self.row)), self.row)


def stream_csv_load(spark: SparkSession, folder: str, row: Row) -> StreamFrame:
    """CSV files that arrive in a folder, under a row type."""
    return StreamFrame(typed(_cells(spark, folder, row, spark.readStream), row), row)


def stream_load(spark: SparkSession, folder: str) -> StreamFrame:
    """As :func:`stream_csv_load`, under the row type inferred from the files there."""
    return stream_csv_load(spark, folder, infer_row(spark, folder))


def stream_parquet(spark: SparkSession, path: str) -> StreamFrame:
    """Parquet files of a folder, or that match a pattern."""
    schema = spark.read.parquet(path).schema
    row = {f.name: t for f in schema if (t := from_spark(f.dataType))}
    folder, _, last = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    df = reader.option("pathGlobFilter", last).parquet(folder) if last.endswith(".parquet") else reader.parquet(path)
    return StreamFrame(df.select(*(stored(quoted(n), t, schema[n].dataType).alias(n) for n, t in row.items())), row)
