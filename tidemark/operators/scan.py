"""What the rows before a row come to, in groups of any size.

A plain running window puts a whole group into one task. Here rows are cut into blocks by their place, a block is scanned
by itself and leaves one row of totals, the totals are scanned in blocks of blocks in the same way, and what they come to
is joined to the rows of each block. No task holds more than a block, and a join meets at most one row a block, so a
group that holds most rows is spread like any other. The totals are stored when the plan is made, so the rows are gone
through once for them and once for the result, and plans stay small however scans are stacked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.stored import settled

#: Bits of a place within a block, a block of blocks, and the whole: for numbers of lines.
LINES = (16, 32, 63)
#: The same for microseconds: a second, 19 hours, all times.
MICROS = (20, 36, 63)

_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def _running(how: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if how == "last" else _TOTAL[how](value)


def _both(how: str, earlier: Column, later: Column) -> Column:
    """Of two stretches; null is none."""
    if how == "sum":
        return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(earlier + later)
    return {"max": F.greatest, "min": F.least}[how](earlier, later) if how != "last" else F.coalesce(later, earlier)


def before(
    rows: DataFrame, key: Sequence[str], place: str, wanted: Mapping[str, tuple[Column, str]], *, order: Sequence[str] = (), shifts: Sequence[int] = LINES,
    overall: Mapping[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """``rows`` with a column for each of ``wanted``, {name: (value, how)}: sum, max, min or last value of the rows before.

    Rows of one ``key`` come in order of ``place``, a whole number from 0 up to 2^62, and then of ``order``. Nulls do not
    count; a row with nothing before it gets null. ``overall`` has columns over all rows of the key. Keys are not null.
    """
    block, more = f"_block{len(shifts)}", overall or {}
    marked = rows.withColumn(block, F.shiftright(F.col(place).cast("long"), shifts[0]))
    earlier = Window.partitionBy(*key, block).orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
    if len(shifts) == 1:
        return marked.withColumns({n: _running(how, v).over(earlier) for n, (v, how) in wanted.items()}).drop(block)
    at = F.struct(place, *order)
    totals = marked.groupBy(*key, block).agg(
        *[(F.max_by(v, F.when(v.isNotNull(), at)) if how == "last" else _TOTAL[how](v)).alias(f"_total_{n}") for n, (v, how) in wanted.items()],
        *[_TOTAL[how](v).alias(f"_all_{n}") for n, (v, how) in more.items()],
    )
    totals = settled(totals)
    carried = before(totals, key, block, {f"_before_{n}": (F.col(f"_total_{n}"), how) for n, (_, how) in wanted.items()}, shifts=[s - shifts[0] for s in shifts[1:]])
    if more:
        carried = carried.join(totals.groupBy(*key).agg(*[_TOTAL[how](F.col(f"_all_{n}")).alias(n) for n, (_, how) in more.items()]), list(key))
    carried = carried.select(*key, block, *[f"_before_{n}" for n in wanted], *more)
    within = marked.withColumns({f"_within_{n}": _running(how, v).over(earlier) for n, (v, how) in wanted.items()})
    joined = within.join(carried.hint("merge"), [*key, block])  # rows of compressed files look small enough to be broadcast
    return joined.select(*rows.columns, *[_both(how, F.col(f"_before_{n}"), F.col(f"_within_{n}")).alias(n) for n, (_, how) in wanted.items()], *more)
