"""Overlap collapse, replacement and splicing; nested and duplicate spans; selection; summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RUN, replacement
from ..plans.options import THRESHOLDS

SPAN = "struct<start:int,stop:int,label:string,confidence:double,reasoning:array<string>>"


def collapse(findings: str, mode: str) -> str:
    """Disjoint spans of an array of findings, inside the row: overlapping ones merge, those that touch don't.

    A merged span takes the label of the first finding with the highest confidence; when redacting it is REDACTED. Closed
    spans are gathered in runs, so that appending copies few of them.
    """
    ordered = f"array_sort(filter({findings}, f -> f.stop > f.start), (l, r) -> case when l.start <> r.start then l.start - r.start when l.stop <> r.stop then l.stop - r.stop when l.confidence > r.confidence then -1 when l.confidence < r.confidence then 1 else 0 end)"
    label = "'REDACTED'" if mode == "redact" else "if(x.confidence > c.last.confidence, x.label, c.last.label)"
    merged = f"named_struct('start', c.last.start, 'stop', greatest(c.last.stop, x.stop), 'label', {label}, 'confidence', greatest(c.last.confidence, x.confidence), 'reasoning', array_distinct(concat(c.last.reasoning, x.reasoning, array('overlap_collapsed'))))"
    own = "named_struct('start', x.start, 'stop', x.stop, 'label', x.label, 'confidence', x.confidence, 'reasoning', x.reasoning)"
    none = f"cast(null as {SPAN})"
    step = f"""case when c.last is null then named_struct('last', {own}, 'out', c.out)
      when x.start >= c.last.stop then named_struct('last', {own}, 'out', concat(c.out, array(c.last))) else named_struct('last', {merged}, 'out', c.out) end"""
    run = f"aggregate(slice(o, b * {RUN} + 1, {RUN}), named_struct('last', a.last, 'out', cast(array() as array<{SPAN}>)), (c, x) -> {step})"
    return f"""get(transform(array({ordered}), o -> if(size(o) = 0, cast(array() as array<{SPAN}>),
      aggregate(sequence(0, (size(o) - 1) div {RUN}), named_struct('last', {none}, 'out', cast(array() as array<array<{SPAN}>>)),
        (a, b) -> get(transform(array({run}), k -> named_struct('last', k.last, 'out', concat(a.out, array(k.out)))), 0),
        a -> flatten(concat(a.out, array(array(a.last))))))), 0)"""


def spliced(value: str, spans: str, mode: str) -> str:
    """The value with each of its disjoint, ordered spans replaced; spans is a column.

    A run of spans is cut from the value once and its pieces from that, as a place in a string is found by counting from its start.
    """
    before = "(coalesce(get(r.p, i - 1).stop, r.base) - r.base)"
    original = "substring(t, s.start - r.base + 1, s.stop - s.start)"
    piece = f"concat(substring(t, {before} + 1, s.start - r.base - {before}), {replacement('s.label', original, mode)})"
    run = f"named_struct('p', slice({spans}, b * {RUN} + 1, {RUN}), 'base', coalesce(get({spans}, b * {RUN} - 1).stop, 0))"
    text = f"get(transform(array({run}), r -> get(transform(array(substring({value}, r.base + 1, element_at(r.p, -1).stop - r.base)), t -> array_join(transform(r.p, (s, i) -> {piece}), '')), 0)), 0)"
    runs = f"transform(sequence(0, (size({spans}) - 1) div {RUN}), b -> {text})"
    return f"if(size({spans}) = 0, {value}, concat(array_join({runs}, ''), substring({value}, element_at({spans}, -1).stop + 1)))"


def redact_values(scanned: DataFrame, threshold: float = THRESHOLDS["high"], mode: str = "redact") -> DataFrame:
    """Values with `findings` arrays: adds `output` and `n_replaced`, all inside the row."""
    kept = f"filter(findings, f -> f.confidence >= {threshold}D)"
    rows = scanned.withColumn("_spans", F.expr(collapse(kept, mode)))
    return rows.withColumn("output", F.expr(spliced("value", "_spans", mode))).withColumn("n_replaced", F.expr("size(_spans)")).drop("_spans")


def redacted_text(text: str, findings: str, threshold: float = THRESHOLDS["high"], mode: str = "redact") -> str:
    """SQL text: a text without those of its findings (SQL text too) that reach the threshold; null stays null."""
    spans = collapse(f"filter({findings}, f -> f.confidence >= {threshold}D)", mode)
    return f"if({text} is null, null, get(transform(array({spans}), _spans -> {spliced(text, '_spans', mode)}), 0))"


def redact_findings(values: DataFrame, findings: DataFrame, keys: list[str], mode: str = "redact") -> DataFrame:
    """Values (keys, value) with the selected findings (keys, spans) replaced: findings are grouped by location, then spliced."""
    spans = findings.groupBy(*keys).agg(F.expr("array_sort(collect_list(named_struct('start', start, 'stop', stop, 'label', label, 'confidence', confidence, 'reasoning', reasoning)))").alias("_spans"))
    rows = values.join(spans, keys, "left").withColumn("_spans", F.expr(collapse(f"coalesce(_spans, cast(array() as array<{SPAN}>))", mode)))
    return rows.withColumn("output", F.expr(spliced("value", "_spans", mode))).withColumn("n_replaced", F.expr("size(_spans)")).drop("_spans")


def collapsed(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap collapse over finding rows, as gaps and islands: a finding opens an island where it starts at or after all ends before it."""
    order = Window.partitionBy(*keys).orderBy("start", "stop", F.desc("confidence"), "label")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = findings.filter("stop > start").withColumn("_new", F.when(F.col("start") >= F.coalesce(F.max("stop").over(before), F.lit(-1)), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(order))
    best = F.struct(F.col("confidence"), -F.col("_rn"))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("confidence").alias("confidence"), F.max_by("label", best).alias("label"), F.count("*").alias("n_merged")).drop("_island")


def best_of_ranges(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of findings on the same span the most confident, ties by the smaller label."""
    order = Window.partitionBy(*keys, "start", "stop").orderBy(F.desc("confidence"), "label")
    return findings.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def without_nested(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that no other of their label contains; spans are distinct."""
    order = Window.partitionBy(*keys, "label").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return findings.withColumn("_end", F.max("stop").over(order)).filter("_end is null or _end < stop").drop("_end")


def finalised(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Text findings: the best of each span, none nested in one of its label."""
    return without_nested(best_of_ranges(findings, keys), keys)


def numbered(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Findings with finding_id f-0001, f-0002, ... in a document's order, and the mark as replacement."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings.withColumn("finding_id", F.concat(F.lit("f-"), F.when(rank < 10_000, F.lpad(rank.cast("string"), 4, "0")).otherwise(rank.cast("string")))).withColumn("replacement", F.lit("[REDACTED]"))


def selected(findings: DataFrame, threshold: float | str = "high") -> DataFrame:
    return findings.filter(F.col("confidence") >= F.lit(THRESHOLDS.get(threshold, threshold)))


def of_selection(findings: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose ids are chosen."""
    return findings.join(selection.select(*keys).distinct(), keys, "left_semi")


def searched(findings: DataFrame, text: str) -> DataFrame:
    """Findings whose label, original, path or reasoning holds a text, in any case."""
    columns = [F.col("label"), F.col("original"), *([F.col("preview_path")] if "preview_path" in findings.columns else []), F.concat_ws(" ", "reasoning")]
    return findings.filter(F.lit(not text) | F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def restored_selection(new: DataFrame, old: DataFrame, key: list[str], loose_key: list[str]) -> DataFrame:
    """New findings that take over an old selection, as bags: first by the exact key, what is left by the key without offsets."""

    def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*columns).orderBy("finding_id")))

    exact = counted(new, key).join(counted(old.select(*key, "finding_id"), key).withColumnRenamed("finding_id", "_old"), [*key, "_nth"], "left")
    rest_new, taken = exact.filter("_old is null").drop("_old", "_nth"), exact.filter("_old is not null")
    rest_old = old.join(taken.select(F.col("_old").alias("finding_id")), "finding_id", "left_anti") if "finding_id" in old.columns else old
    loose = counted(rest_new, loose_key).join(counted(rest_old.select(*loose_key, "finding_id"), loose_key).drop("finding_id"), [*loose_key, "_nth"], "left_semi").drop("_nth")
    return taken.drop("_old", "_nth").unionByName(loose.select(*taken.drop("_old", "_nth").columns))


def summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """total, high (0.8 and more) and medium of each document."""
    return findings.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.8).alias("medium"))


def summary_by_category(findings: DataFrame) -> DataFrame:
    """Counts by category, and over all under "all"."""
    rolled = findings.rollup("category").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.8).alias("high"))
    return rolled.withColumn("category", F.coalesce("category", F.lit("all")))


def selection_trust(findings: DataFrame, selection: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Recommended, chosen, left, added and removed findings: what a reviewer's selection differs in from the threshold's."""
    chosen = selection.select(*keys).distinct().withColumn("_on", F.lit(True))
    rows = findings.join(chosen, keys, "left").withColumn("_on", F.coalesce("_on", F.lit(False))).withColumn("_auto", F.col("confidence") >= threshold)
    return rows.agg(
        F.count_if("_auto").alias("recommended"), F.count_if("_on").alias("chosen"), F.count_if(~F.col("_on")).alias("left"), F.count_if(F.col("_on") & ~F.col("_auto")).alias("added"), F.count_if(~F.col("_on") & F.col("_auto")).alias("removed")
    )


def coverage(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """Which labelled samples (sample_id, label, category) are found, by category and over all."""
    hits = findings.select(F.col("doc_id").alias("sample_id"), "label").distinct().withColumn("_hit", F.lit(1))
    rows = samples.join(hits, ["sample_id", "label"], "left").rollup("category").agg(F.count("*").alias("total"), F.count("_hit").alias("hit"))
    return rows.withColumn("category", F.coalesce("category", F.lit("all"))).withColumn("rate", F.round(F.col("hit") * 100 / F.col("total")).cast("int"))


def muted_areas(narrow: DataFrame, broad: DataFrame) -> DataFrame:
    """Categories that a broad scan finds something in and a narrow one doesn't."""
    return broad.groupBy("category").count().join(narrow.select("category").distinct(), "category", "left_anti").withColumnRenamed("count", "n")


def residual(findings: DataFrame, threshold: float) -> DataFrame:
    """By document and category: findings that a threshold leaves in the text."""
    return findings.groupBy("doc_id", "category").agg(F.count_if(F.col("confidence") >= threshold).alias("selected"), F.count_if(F.col("confidence") < threshold).alias("left"))


