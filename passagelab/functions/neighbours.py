"""Rows and their neighbours in series of any length.

With keys each series is sorted by itself. A long series without keys is cut into
ranges of an integer column, each sorted in a task of its own; what a range needs of
the others is a few numbers for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one series without keys that are sorted in one task.
TASK_ROWS = 250_000
#: Equal cells from which ranges are put together; one with too many rows is cut into cells again.
CELLS = 4096


def kept(df: DataFrame) -> DataFrame:
    """The frame computed once: in the checkpoint folder, or on the executors where none is set."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def lookup(values: list, at: str = "_range", kind: str = "bigint") -> Column:
    """``values[at]``, null where that is null."""
    return F.expr(f"get(cast(array({', '.join('null' if v is None else f'{v}L' for v in values)}) as array<{kind}>), {at})")


class Ranges:
    """Ranges of a column's values that hold about ``TASK_ROWS`` rows each; ``totals`` are their rows."""

    def __init__(self, df: DataFrame, order: str, low: int, high: int):
        self.totals: list[int] = []
        self.cells = self._cut(df.select(F.col(order).alias("v")), low, high)

    def _cut(self, df: DataFrame, low: int, high: int):
        width = max(1, -(-(high - low + 1) // CELLS))
        inside = df.where(f"v between {low}L and {high}L")
        counts = dict(map(tuple, inside.groupBy(F.expr(f"(v - ({low}L)) div {width}L").alias("cell")).count().collect()))
        ids, finer, begun = [], {}, False
        for cell in range(-(-(high - low + 1) // width)):
            n = counts.get(cell, 0)
            if n > 2 * TASK_ROWS and width > 1:
                begin = low + cell * width
                finer[cell] = self._cut(df, begin, min(high, begin + width - 1))
                begun = False
            else:
                if not begun or self.totals[-1] + n > TASK_ROWS:
                    self.totals.append(0)
                    begun = True
                self.totals[-1] += n
            ids.append(len(self.totals) - 1)
        return low, high, width, ids, finer

    def place(self, at: str) -> Column:
        """The range of a column's value; one outside of all belongs to the nearest, and null to the first."""
        return F.expr(self._place(at, *self.cells))

    def _place(self, at: str, low: int, high: int, width: int, ids: list[int], finer: dict) -> str:
        cell = f"cast((least(greatest({at}, ({low}L)), ({high}L)) - ({low}L)) div {width}L as int)"
        found = f"get(array({', '.join(map(str, ids))}), {cell})"
        if not finer:
            return found
        return f"case {cell} {' '.join(f'when {k} then {self._place(at, *v)}' for k, v in finer.items())} else {found} end"

    def before(self) -> list[int]:
        """Rows in all ranges before each."""
        out = [0]
        for n in self.totals:
            out.append(out[-1] + n)
        return out[:-1]

    def each(self, df: DataFrame, *aggregates: Column) -> list:
        """For each range the row of aggregates over ``df``, which has ``_range``; None where it has no rows."""
        found = {r["_range"]: r for r in df.groupBy("_range").agg(*aggregates).collect()}
        return [found.get(i) for i in range(len(self.totals))]


def ranges(df: DataFrame, order: str = "t", keys=()) -> Ranges | None:
    """The ranges of a long series without keys; None where a series is sorted as a whole."""
    if keys:
        return None
    low, high, n, valued = df.agg(F.min(order), F.max(order), F.count("*"), F.count(order)).first()
    if n <= TASK_ROWS or low is None:
        return None
    cut = Ranges(df, order, low, high)
    cut.totals[0] += n - valued
    return cut


def numbered(df: DataFrame, keys=(), order: str = "t", out: str = "n") -> DataFrame:
    """The frame with each row's index in its series, from 1."""
    cut = ranges(df, order, keys)
    if cut is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    placed = df.withColumn("_range", cut.place(order))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return placed.withColumn(out, own + lookup(cut.before())).drop("_range")


def with_previous(df: DataFrame, column: str, out: str, keys=(), order: str = "t") -> DataFrame:
    """``df`` with the value ``out`` that ``column`` has in the row before, by the integer column ``order``.

    The first row of a range takes the last value of the one before it, of which
    there is one row a range. The column must not be null; the first row's value is.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    cut = ranges(df, order, keys)
    if cut is None:
        return df.withColumn(out, F.lag(column).over(by))
    ranged = df.withColumn("_range", cut.place(order))
    ends = ranged.groupBy("_range").agg(F.max_by(column, order).alias("_end"))
    before = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_before"))
    inside = ranged.withColumn(out, F.lag(column).over(Window.partitionBy("_range").orderBy(order)))
    return inside.join(F.broadcast(before), "_range").withColumn(out, F.coalesce(out, "_before")).drop("_range", "_before")


def with_top_after(df: DataFrame, column: str, out: str, keys=(), own: bool = True) -> DataFrame:
    """``df`` with the largest value of ``column`` from each row on, or after it; null after the last."""
    cut = ranges(df, "t", keys)
    by = Window.partitionBy(*(("_range",) if cut else keys)).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if cut is None:
        return df.withColumn(out, F.max(column).over(by))
    ranged = df.withColumn("_range", cut.place("t"))
    later, top = [], None
    for r in reversed(cut.each(ranged, F.max(column).alias("top"))):
        later.append(top)
        top = max((x for x in (top, r and r["top"]) if x is not None), default=None)
    return ranged.withColumn(out, F.greatest(F.max(column).over(by), lookup(later[::-1]))).drop("_range")


def over_rows(df: DataFrame, made, before: int, after: int = 0, keys=(), order: str = "row") -> DataFrame:
    """``made(df, window)``, a window by ``order`` for frames that reach so many rows back and ahead.

    A long series without keys is cut into stretches of rows, each with copies of as
    many rows on either side.
    """
    if ranges(df, order, keys) is None:
        return made(df, Window.partitionBy(*keys).orderBy(order))
    size = max(TASK_ROWS, before, after)
    place, home = F.expr(f"(_n - 1) % {size}"), F.expr(f"(_n - 1) div {size}")
    copies = F.array_compact(F.array(home, F.when(place >= size - before, home + 1), F.when(place < after, home - 1)))
    held = numbered(df, (), order, "_n").withColumns({"_home": home, "_range": F.explode(copies)})
    return made(held, Window.partitionBy("_range").orderBy(order)).where("_range = _home").drop("_n", "_home", "_range")
