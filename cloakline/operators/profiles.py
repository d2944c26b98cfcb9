"""Column profiles: the shapes of a column's values hint at its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import shape_labels, strings
from ..functions.patterns import PRECISE_SHAPES
from ..functions.text import trim
from ..plans.storage import stored

#: Groups of values with hints (at most 19 labels each) that are broadcast; beyond that they are joined.
BROADCAST_HINTS = 20_000


def group_key() -> str:
    """What values are profiled together: a table's column, a sheet's column, the members of a JSON object."""
    return """case
      when kind = 'table' and column_index is not null then concat('table:', column_index)
      when table_index is not null and column_index is not null then concat('table:', coalesce(kind, 'text'), ':', table_index, ':', column_index)
      when kind = 'xlsx' and sheet_index is not null and column_index is not null then concat('xlsx:', sheet_index, ':', column_index)
      when kind = 'json' and size(path) > 1 then concat('json:', to_json(slice(path, 1, size(path) - 1)))
      else '' end"""


def column_profiles(values: DataFrame) -> DataFrame:
    """doc_id, group_key, label, n, total, hinted of each shape that a group's values have.

    Shapes are counted in the shuffle's first half, so a column of any length comes down to a few rows.
    """
    shown = values.filter(f"group_key <> '' and {trim('value')} <> '' and not coalesce(disable_profile, false)")
    shaped = shown.select("doc_id", "group_key", F.explode(F.expr(f"concat(array(''), {shape_labels('value')})")).alias("label"))
    counts = shaped.groupBy("doc_id", "group_key", "label").agg(F.count("*").alias("n"))
    sizes = counts.filter("label = ''").select("doc_id", "group_key", F.col("n").alias("total"))
    rows = counts.filter("label <> ''").join(sizes, ["doc_id", "group_key"])
    return rows.withColumn("hinted", F.expr(f"array_contains({strings(PRECISE_SHAPES)}, label) or n >= 2 and n / total >= 0.6"))


def with_profiles(values: DataFrame) -> DataFrame:
    """Values with the hints of their groups added to profile_hints; the shuffle is by document and group."""
    needed = {"table_index": "int", "column_index": "int", "sheet_index": "int", "disable_profile": "boolean"}
    values = values.withColumns({c: F.lit(None).cast(t) for c, t in needed.items() if c not in values.columns})
    keyed = values.withColumn("group_key", F.expr(group_key()))
    hints = column_profiles(keyed.withColumn("value", F.coalesce("value", F.lit("")))).filter("hinted").groupBy("doc_id", "group_key").agg(F.sort_array(F.collect_set("label")).alias("_hints"))
    none = "cast(array() as array<string>)"
    hints = stored(hints)
    # One table's columns are a few hints for all of its rows: sent to the rows, if they are few, rather than the rows to them.
    few = hints.limit(BROADCAST_HINTS + 1).count() <= BROADCAST_HINTS
    hints = hints.select(F.col("doc_id").alias("_hint_doc"), F.col("group_key").alias("_hint_group"), "_hints")
    joined = keyed.join(F.broadcast(hints) if few else hints, F.col("doc_id").eqNullSafe(F.col("_hint_doc")) & (F.col("group_key") == F.col("_hint_group")), "left").drop("_hint_doc", "_hint_group")
    return joined.withColumn("profile_hints", F.expr(f"array_union(coalesce(profile_hints, {none}), coalesce(_hints, {none}))")).drop("_hints", "group_key")
