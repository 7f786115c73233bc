"""Ordered, typed tables over DataFrames.

Row order is part of a table, but nothing is sorted until rows are shown or stored: a
Frame carries hidden order columns and their directions, and a sort or reversal only
changes that list.  Catalyst prunes hidden columns that no result needs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expr import Expr, column, compiled, has_aggregate, literal, nanos
from ..functions.nil import nanos_interval, stored
from ..types import BOOL, TIMEDELTA, Row, from_spark

_fresh = itertools.count()
Item = Expr | str
Items = Sequence[Item] | Mapping[str, Item] | None


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hidden() -> str:
    return f"_cw_{next(_fresh)}"


class Frame:
    """Rows of ``row`` types in ``df``, ordered by hidden columns ``order``: (name, ascending)."""

    def __init__(self, df: DataFrame, row: Row, order: Sequence[tuple[str, bool]] = ()):
        self.df, self.row, self.order = df, dict(row), list(order)

    # -- building ---------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, row: Row | None = None, order_by: Sequence[str] = ()) -> Frame:
        """A DataFrame as a typed table; columns of other types pass through under no type."""
        row = row or {f.name: t for f in df.schema if (t := from_spark(f.dataType))}
        rest = [quoted(c) for c in df.columns if c not in row]
        keys = [(hidden(), quoted(c)) for c in order_by]
        cols = [stored(quoted(n), t, df.schema[n].dataType).alias(n) for n, t in row.items()]
        return cls(df.select(*cols, *rest, *(k.alias(h) for h, k in keys)), row, [(h, True) for h, _ in keys])

    @classmethod
    def rows(cls, spark: SparkSession, row: Row, rows: Sequence[Sequence[object]]) -> Frame:
        """A table of Python values, in their order; None is a missing value."""
        from pyspark.sql import types as T

        h = hidden()
        schema = T.StructType([T.StructField(n, t.spark) for n, t in row.items()] + [T.StructField(h, T.LongType())])
        df = spark.createDataFrame([(*map(nanos, r), i) for i, r in enumerate(rows)], schema)
        return cls(df.select(*(stored(quoted(n), t).alias(n) for n, t in row.items()), h), row, [(h, True)])

    # -- looking ----------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return list(self.row)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("_") or name not in self.row:
            raise AttributeError(name)
        return column(name, self.row[name])

    def __getitem__(self, name: str) -> Expr:
        if name not in self.row:
            raise QueryError(f"no column {name}; there are {', '.join(self.row)}")
        return column(name, self.row[name])

    def order_key(self) -> Column:
        """One value that sorts rows; needs ascending order columns."""
        return F.struct(*(quoted(n).alias(f"o{i}") for i, (n, _) in enumerate(self.order)))

    def order_by(self) -> list[Column]:
        return [quoted(n).asc_nulls_last() if up else quoted(n).desc_nulls_first() for n, up in self.order]

    def to_df(self, ordered: bool = False) -> DataFrame:
        """The visible columns, durations as intervals; with ``ordered``, physically sorted."""
        out = self.kept(ordered)
        return out.select(*((nanos_interval(quoted(n)) if t is TIMEDELTA else quoted(n)).alias(n) for n, t in self.row.items()))

    def kept(self, ordered: bool = False) -> DataFrame:
        """The visible columns in the form in which they are kept: durations in nanoseconds."""
        df = self.df.orderBy(*self.order_by()) if ordered and self.order else self.df
        return df.select(*map(quoted, self.row))

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.to_df(ordered=True).collect()]

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def with_row_id(self) -> Frame:
        """The same rows with one ascending order column, from one range-partitioned sort."""
        if not self.order:
            raise QueryError("this table has no row order; name columns with order_by")
        if len(self.order) == 1 and self.order[0][1]:
            return self
        h = hidden()
        df = self.df.orderBy(*self.order_by()).withColumn(h, F.monotonically_increasing_id())
        return Frame(df.drop(*(n for n, _ in self.order)), self.row, [(h, True)])

    # -- queries ----------------------------------------------------------

    def _items(self, items: Items, what: str) -> list[tuple[str, Expr]]:
        pairs = items.items() if isinstance(items, Mapping) else [(None, i) for i in (items or ())]
        out: list[tuple[str, Expr]] = []
        for name, item in pairs:
            e = self[item] if isinstance(item, str) and item in self.row and name is None else item
            e = self[e] if isinstance(e, str) and e in self.row else literal(e)
            name = name or e.name
            if not name:
                raise QueryError(f"a {what} of no column needs a name")
            if any(n == name for n, _ in out):
                raise QueryError(f"two columns would be named {name}")
            out.append((name, e))
        return out

    def where(self, p: Expr) -> Frame:
        if p.type is not BOOL:
            raise QueryError(f"where takes a Bool, not {p.type}")
        if has_aggregate(p):
            total, df = self._totals([p])
            return Frame(df.where(_plain(p, total)), self.row, self.order)
        return Frame(self.df.where(compiled(p)), self.row, self.order)

    def query(self, select: Items = None, by: Items = None, where: Expr | None = None) -> Frame:
        """``from self select … by … where …``: the filter comes first, then groups, then columns."""
        if where is not None:
            return self.where(where).query(select, by)
        if by is not None:
            return self._grouped(select, by)
        if select is None:
            return self
        items = self._items(select, "column")
        for name, e in items:
            if not e.array:
                raise QueryError(f"resulting column must be an array: {name}")
        total, df = self._totals([e for _, e in items])
        keep = [quoted(n) for n, _ in self.order]
        cols = [_plain(e, total).alias(n) for n, e in items]
        return Frame(df.select(*cols, *keep), {n: e.type for n, e in items}, self.order)

    exec = query

    def _totals(self, exprs: Sequence[Expr]) -> tuple[Callable[[Expr], Column], DataFrame]:
        """Aggregates in a query without by, as values over the whole table.

        They are aggregated apart, in parallel, and joined as a table of one row.
        """
        found: list[Expr] = []

        def walk(e: Expr) -> None:
            if e.aggregate:
                found.append(e)
            else:
                for a in e.args:
                    walk(a)

        for e in exprs:
            walk(e)
        if not found:
            return compiled, self.df
        names = {id(e): hidden() for e in found}
        one = self.df.agg(*(compiled(e, self._rows_order([e])).alias(names[id(e)]) for e in found))
        return (lambda e: quoted(names[id(e)])), self.df.join(F.broadcast(one))  # one row

    def _rows_order(self, exprs: Sequence[Expr]) -> Column | None:
        if not any(_ordered(e) for e in exprs):
            return None
        if not self.order or not all(up for _, up in self.order):
            raise QueryError("an ordered aggregate needs ascending row order; use with_row_id")
        return self.order_key()

    def _grouped(self, select: Items, by: Items) -> Frame:
        if not select:
            raise QueryError("a query with by needs columns")
        if self.order and not all(up for _, up in self.order):
            return self.with_row_id()._grouped(select, by)
        keys, items = self._items(by, "group"), self._items(select, "column")
        for name, e in keys:
            if not e.array:
                raise QueryError(f"a group must be an array: {name}")
        for name, e in items:
            if e.array:
                raise QueryError(f"resulting column must be a scalar with by: {name}")
        names = [n for n, _ in keys] + [n for n, _ in items]
        if len(set(names)) != len(names):
            raise QueryError(f"two columns would be named alike: {', '.join(names)}")
        held = [(hidden(), compiled(e)) for _, e in keys]
        df = self.df.select("*", *(c.alias(h) for h, c in held))
        order = self._rows_order([e for _, e in items])
        # an aggregate inside another's argument is a value of the group: aggregated first, and joined on the keys
        inner: dict[int, str] = {}
        left = list({id(e): e for e in _inner_aggregates([e for _, e in items])}.values())
        while left:
            now = [e for e in left if all(id(x) in inner for x in _inner_aggregates([e]))]
            names = {id(e): hidden() for e in now}
            made = [compiled(e, order, lambda x: quoted(inner[id(x)])).alias(names[id(e)]) for e in now]
            side = df.groupBy(*(quoted(h).alias(f"{h}k") for h, _ in held)).agg(*made)
            match = F.lit(True)
            for h, _ in held:
                match = match & quoted(h).eqNullSafe(quoted(f"{h}k"))
            df = df.join(side, match).drop(*(f"{h}k" for h, _ in held))
            inner |= names
            left = [e for e in left if id(e) not in inner]
        columns = [compiled(e, order, lambda x: quoted(inner[id(x)])).alias(n) for n, e in items]
        first = [F.min(self.order_key()).alias(o := hidden())] if self.order else []
        out = df.groupBy(*(quoted(h) for h, _ in held)).agg(*columns, *first)
        out = out.select(*(quoted(h).alias(n) for (h, _), (n, _) in zip(held, keys)), *(quoted(n) for n, _ in items), *([quoted(o)] if first else []))
        return Frame(out, {n: e.type for n, e in [*keys, *items]}, [(o, True)] if first else [])

    def evaluate(self, e: Expr) -> object:
        """An aggregate of whole columns as a Python value."""
        if e.array:
            raise QueryError("a value must be a scalar")
        return self.df.agg(compiled(e, self._rows_order([e])).alias("v")).first()[0] if has_aggregate(e) else self.spark.range(1).select(compiled(e)).first()[0]

    # -- order ------------------------------------------------------------

    def sort(self, *by: Item) -> Frame:
        """Ascending and stable; missing numbers and times come last."""
        if not by:
            raise QueryError("sort needs by")
        keys = [(hidden(), e) for _, e in self._items({f"k{i}": b for i, b in enumerate(by)}, "key")]
        total, df = self._totals([e for _, e in keys])
        df = df.select("*", *(_plain(e, total).alias(h) for h, e in keys))
        return Frame(df, self.row, [*((h, True) for h, _ in keys), *self.order])

    def reverse(self) -> Frame:
        if not self.order:
            raise QueryError("this table has no row order to reverse")
        return Frame(self.df, self.row, [(n, not up) for n, up in self.order])

    # -- joins ------------------------------------------------------------

    def join(self, right: Frame, on: Items = None, asof: Item | None = None, strict: bool = False, direction: str | None = None, within: object = None) -> Frame:
        """One row per left row, in left order: lookup by ``on``, or as-of, or both."""
        from .joins import join

        return join(self, right, on, asof, strict, direction, within)

    def __repr__(self) -> str:
        from ..render import frame_text

        return frame_text(self)


def _plain(e: Expr, nested: Callable[[Expr], Column]) -> Column:
    return nested(e) if e.aggregate else e.build(*(_plain(a, nested) for a in e.args))


def _ordered(e: Expr) -> bool:
    return e.ordered or any(map(_ordered, e.args))


def _inner_aggregates(exprs: Sequence[Expr]) -> list[Expr]:
    """Aggregates inside the arguments of aggregates, innermost first."""
    out: list[Expr] = []

    def walk(e: Expr, inside: bool) -> None:
        for a in e.args:
            walk(a, inside or e.aggregate)
        if inside and e.aggregate:
            out.append(e)

    for e in exprs:
        walk(e, False)
    return out
