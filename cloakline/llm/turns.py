"""Conversations in the order of their turns, dealt out by ranges, so that a conversation of any length spans as many tasks as it needs.

Rows of a conversation go by turn (nulls first), then by the first 64 characters of `role:text`, then by the MD5 of `role:text`; rows
that agree in all of these are repeats of one another and are dealt out by their row number, so a group of repeats has no task of
its own either. A null conv_id is a conversation. Only conv_id, turn, role and text (and `also`) are read; other columns may have
any names. An empty table gives no rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, input_size

#: Characters that a task gets on the average.
TASK_CHARS = 32_000_000


def conversation_rows(rows: DataFrame, blank: str, *more: Column) -> DataFrame:
    """conv_id, turn, role and text, and `more`; a null role or text becomes `blank`."""
    return rows.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), *(F.coalesce(F.col(c).cast("string"), F.lit(blank)).alias(c) for c in ("role", "text")), *more)


def parts_of(rows: DataFrame, column: str = "text", most: int = TASK_CHARS) -> int:
    """Tasks that a table is dealt to by ranges."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_size(rows, column) // most + 1)


def in_turn_order(rows: DataFrame, parts: int) -> DataFrame:
    """The rows, with `part`: the partitions go on from one another in the order of conv_id and turns, and are sorted."""
    line = F.concat_ws(":", "role", "text")
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("head_").asc(), F.col("digest_").asc()]
    rows = rows.withColumns({"head_": F.left(line, F.lit(64)), "digest_": F.md5(line.cast("binary")), "repeat_": F.monotonically_increasing_id()})
    return rows.repartitionByRange(parts, *keys, F.col("repeat_")).sortWithinPartitions(*keys).drop("head_", "digest_", "repeat_").withColumn("part", F.spark_partition_id())


def numbered(rows: DataFrame, scratch: Scratch, parts: int, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows with `pos`, their places in their conversations from 1. Places within a partition are counted in one pass over its
    rows; a conversation that goes on in the next partition starts there with the rows before it, one number for each partition."""
    kept = ("conv_id", *also)
    ordered = in_turn_order(rows, parts).select(*kept, "part")
    schema = pa.schema([*((f.name, _arrow(f.dataType)) for f in ordered.schema.fields), ("idx", pa.int64())])

    def count(batches):
        held, n = object(), 0
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                n = n + 1 if conv == held else 1
                held = conv
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], schema=schema)

    placed = scratch.table(ordered.mapInArrow(count, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", idx long"), "placed")
    # At most one conversation goes on from one partition into the next, so this has two rows a partition at most.
    conv = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")
    ends = placed.groupBy("part").agg(F.min(conv).alias("first"), F.max(conv).alias("last"))
    marked = placed.join(F.broadcast(ends), "part").filter((conv == F.col("first")) | (conv == F.col("last")))
    edges = marked.groupBy("part", "conv_id").agg(F.count("*").alias("n")).collect()
    before, starts, held = 0, [], object()
    for r in sorted(edges, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part)):
        before = before if r.conv_id == held else 0
        if before:
            starts.append((r.part, r.conv_id, before))
        held, before = r.conv_id, before + r.n
    starts = rows.sparkSession.createDataFrame(starts, "part_ int, conv_ long, before_ long")
    out = placed.join(F.broadcast(starts), (F.col("part") == F.col("part_")) & F.col("conv_id").eqNullSafe(F.col("conv_")), "left")
    return out.select(*kept, (F.col("idx") + F.coalesce("before_", F.lit(0))).alias("pos"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
