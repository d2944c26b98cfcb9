"""Interval join: spans of two tables that overlap, by bins of as many widths as the spans have, with no comparison of all with all.

A span lies in one or two bins of the least power of two that isn't below its length. Of two spans the shorter one is also put into the bins of
the longer one's width that it meets, at most two, so a span becomes at most two rows for each width that occurs, however long
other spans are; both meet under (keys, width, bin), which deals a hot document's spans out by their places. A pair counts where the later
of its two starts lies, so no pair comes twice.

Spans are half-open; an empty one overlaps those that it lies inside of. Nulls: a null key equals no other, a null start or stop overlaps nothing.
Repeated rows give a pair each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans shorter than 2 ** LEAST share the narrowest bins.
LEAST = 6


def _level(start: str, stop: str) -> str:
    return f"greatest({LEAST}, cast(ceil(log2(greatest({stop} - {start}, 1))) as int))"


def _levels(rows: DataFrame) -> list[int]:
    """Widths that occur, at most 64."""
    return sorted(r[0] for r in rows.select("_level").distinct().collect())


def _bins(rows: DataFrame, levels: str) -> DataFrame:
    """Rows under each bin of some levels (an SQL array)."""
    rows = rows.withColumn("_at", F.explode(F.expr(levels)))
    first, last = "shiftright(cast(_start as bigint), _at)", "shiftright(cast(greatest(_stop - 1, _start) as bigint), _at)"
    return rows.withColumn("_bin", F.explode(F.expr(f"if({first} = {last}, array({first}), array({first}, {last}))")))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str] = ("start", "stop"), other: tuple[str, str] | None = None, prefix: str = "r_") -> DataFrame:
    """Pairs of rows of equal keys whose spans overlap: left's columns, and right's other columns with a prefix."""
    other = other or span
    a = left.withColumns({"_start": F.col(span[0]), "_stop": F.col(span[1])}).filter("_start is not null and _stop is not null").withColumn("_level", F.expr(_level("_start", "_stop")))
    b = right.select(*(F.col(c).alias(f"{prefix}{c}") for c in right.columns)).withColumns({"_start": F.col(prefix + other[0]), "_stop": F.col(prefix + other[1])}).filter("_start is not null and _stop is not null").withColumn("_level", F.expr(_level("_start", "_stop")))
    wide_a, wide_b = (f"cast(array({', '.join(map(str, _levels(x)))}) as array<int>)" for x in (a, b))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(*(c for c in y.columns if not c.startswith("_")), *(F.col(c).alias(f"_{c}_b") for c in ("_start", "_stop", "_at", "_bin")))
        same = (F.col("_at") == F.col("__at_b")) & (F.col("_bin") == F.col("__bin_b"))
        for k in keys:
            same = same & (F.col(k) == F.col(f"{prefix}{k}"))
        within = "_start < __stop_b and __start_b < _stop and shiftright(cast(greatest(_start, __start_b) as bigint), _at) = _bin"
        return x.join(y, same).filter(within).select(*left.columns, *(f"{prefix}{c}" for c in right.columns if c not in keys))

    # The longer span is right's (or both are as long), then left's.
    longer_b = meet(_bins(a, f"filter({wide_b}, l -> l >= _level)"), _bins(b, "array(_level)"))
    longer_a = meet(_bins(a, "array(_level)"), _bins(b, f"filter({wide_a}, l -> l > _level)"))
    return longer_b.unionByName(longer_a)
