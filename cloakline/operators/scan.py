"""Scans of values: all detectors on each value, then seeds of a document's values on all of them."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import Context, evidence
from ..plans.options import Options
from ..plans.storage import stored
from . import identity, seeds, structured

#: Columns of a value's context; a scan adds those that a table lacks as nulls.
CONTEXT = {"key_hint": "string", "preview_path": "string", "path": "array<string>", "kind": "string", "profile_hints": "array<string>"}
#: Columns that place a value in its document.
PLACE = ("table_index", "row_index", "column_index", "sheet_index", "segment_index", "page_number")
HERE = Context("key_hint", "preview_path", "path", "kind", "profile_hints")
FINDINGS = "label string, category string, confidence double, start int, stop int, original string, reasoning array<string>"


def with_context(values: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in CONTEXT.items() if c not in values.columns}
    return values.withColumns(missing) if missing else values


def sorted_distinct(findings: str) -> str:
    """In order of start, longest first, then of detection; of equal label, span and rounded confidence the first."""
    numbered = f"transform({findings}, (f, i) -> named_struct('start', f.start, 'back', f.back, 'label', f.label, 'milli', f.milli, 'seq', i, 'stop', f.stop, 'confidence', f.confidence, 'original', f.original, 'category', f.category, 'reasoning', f.reasoning))"
    same = "a[i - 1].start = f.start and a[i - 1].stop = f.stop and a[i - 1].label = f.label and a[i - 1].milli = f.milli"
    distinct = f"flatten(transform(array(array_sort({numbered})), a -> filter(a, (f, i) -> i = 0 or not ({same}))))"
    return f"array_sort({distinct}, (l, r) -> case when l.start <> r.start then l.start - r.start when l.back <> r.back then l.back - r.back else l.seq - r.seq end)"


def with_findings(values: DataFrame, options: Options = Options(), outside_seeds: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Adds `findings`, an array, to values (a `value` string and context columns). outside_seeds: SQL text of outside seeds; only: names of structured detectors to run alone."""
    outside = outside_seeds or identity.NO_SEEDS
    segments = HERE.segments()
    rows = with_context(values).withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit(""))).withColumn("_segments", F.expr(segments))
    rows = rows.withColumns({f"_ev_{label}": F.expr(evidence("_segments", "profile_hints", label)) for label in structured.EVIDENCE})
    rows = rows.withColumn("_ibans", F.expr(structured.ibans("value") if options.on("IBAN") else "cast(array() as array<struct<start:int,stop:int,original:string,ok:boolean>>)"))
    rows = rows.withColumn("_card_context", F.expr(structured.card_context(HERE)))
    found = [e for name, e in structured.detectors("value", options).items() if only is None or name in only]
    if only is not None:
        options = replace(options, detect_names=False, categories=frozenset())
    if options.on("PERSON"):
        found.append(identity.labelled("value", HERE))
    if options.detect_names:
        found.append(identity.field_hint("value", options))
        if options.on("PERSON") or options.on("PLACE"):
            found.append(identity.contact_lines("value"))
            if options.on("PERSON"):
                found.append(identity.name_lines("value", outside))
    rows = rows.withColumn("_found", F.expr("concat(" + ", ".join(found) + ")"))
    if options.detect_names and (options.on("PERSON") or options.on("PLACE")):
        local = identity.seeds_of("_found")
        rows = rows.withColumn("_seeds", F.expr(f"array_distinct(concat({local}, {outside}))"))
        rows = rows.withColumn("_found", F.expr(f"concat(_found, {identity.spread('value', '_found', '_seeds')})")).drop("_seeds")
    return rows.withColumn("findings", F.expr(sorted_distinct("_found"))).drop("_segments", "_ibans", "_card_context", "_found", *(f"_ev_{label}" for label in structured.EVIDENCE))


def findings_of(text: str, options: Options = Options()) -> str:
    """SQL text: the findings array of a text that is a value of its own, as one expression, for SQL functions."""
    none = "cast(null as string)"
    here = Context(none, none, "cast(null as array<string>)", "'text'", "cast(null as array<string>)")
    found = list(structured.detectors("_value", options).values())
    if options.on("PERSON"):
        found.append(identity.labelled("_value", here))
    names = options.detect_names and (options.on("PERSON") or options.on("PLACE"))
    if names:
        found.append(identity.contact_lines("_value"))
        if options.on("PERSON"):
            found.append(identity.name_lines("_value", identity.NO_SEEDS))
    # A text has no field: no label has evidence, and no hint.
    body = re.sub(r"\b_ev_[A-Z_]+\b", "0D", f"concat({', '.join(found)})")
    body = re.sub(r"\bkey_hint\b", none, body).replace("_card_context", "false")
    done = sorted_distinct(f"concat(_found, {identity.spread('_value', '_found', '_seeds')})" if names else "_found")
    let = lambda name, value, inner: f"get(transform(array({value}), {name} -> {inner}), 0)"
    done = let("_seeds", identity.seeds_of("_found"), done) if names else done
    ibans = structured.ibans("_value") if options.on("IBAN") else "cast(array() as array<struct<start:int,stop:int,original:string,ok:boolean>>)"
    ibans = re.sub(r"\b_ev_[A-Z_]+\b", "0D", ibans)
    return let("_value", f"coalesce({text}, '')", let("_ibans", ibans, let("_found", body, done)))


def exploded(scanned: DataFrame) -> DataFrame:
    """A row for each finding, with the value's other columns and n, the finding's place in its value."""
    kept = [c for c in scanned.columns if c not in ("findings", "value")]
    # The outer form: for the inner one the optimizer repeats the whole array expression in a filter below.
    return scanned.select(*kept, F.posexplode_outer("findings").alias("n", "f")).filter("n is not null").select(*kept, "n", "f.label", "f.category", "f.confidence", "f.milli", "f.start", "f.stop", "f.original", "f.reasoning")


def scan_values(values: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of values that are documents of their own."""
    return exploded(with_findings(values, options))


def scan_collection(values: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of documents of many values (doc_id, value_seq, value): a first pass, then one with the seeds of each whole document.

    Both passes' findings count, each label, span and rounded confidence of a value once.
    """
    from .profiles import with_profiles

    # The first pass's findings are read by the seeds and by the result. A row's number stands for it in what comes back to it.
    first = with_findings(with_context(with_profiles(with_context(values))), options)
    if not options.detect_names or not (options.on("PERSON") or options.on("PLACE")):
        return exploded(first)
    first = stored(first.withColumn("_row", F.monotonically_increasing_id()))
    own = first.select("doc_id", "value_seq", F.posexplode_outer(F.expr(identity.seeds_of("findings"))).alias("at", "seed")).filter("at is not null")
    known = stored(own.groupBy("doc_id", "seed.label", F.col("seed.tokens").alias("words")).agg(F.min(F.struct("value_seq", "at")).alias("rank")))
    # Seeds change lines of names and the spread alone: what the other detectors found is taken from the first pass, in their order.
    others = "filter(findings, f -> not exists(f.reasoning, r -> r in ('standalone_name_line', 'identity_seed_match')))"
    rows = first.withColumn("_found", F.expr(f"array_sort({others}, (l, r) -> l.seq - r.seq)"))
    if options.on("PERSON"):
        # A line of names asks for its own names only, so a row never holds the names of its document.
        asked = first.select("_row", "doc_id", F.explode(F.expr(identity.pairs_asked("value"))).alias("pair"))
        names = known.filter("label = 'PERSON' and size(words) = 2").select("doc_id", F.array_join("words", " ").alias("pair"), "words")
        met = _by_document(asked, names, "pair").groupBy("_row").agg(F.collect_set(F.struct(F.lit("PERSON").alias("label"), F.col("words").alias("tokens"))).alias("_known"))
        rows = rows.join(met, "_row", "left").withColumn("_found", F.expr(f"concat(_found, {identity.name_lines('value', f'coalesce(_known, {identity.NO_SEEDS})')})")).drop("_known")
    # A value's own seeds come first; runs that none of them fits go to the seeds of the document.
    seeded = known.select(F.col("doc_id").alias("_seed_doc")).distinct().withColumn("_seeded", F.lit(True))
    rows = rows.join(seeded, F.col("doc_id").eqNullSafe(F.col("_seed_doc")), "left").drop("_seed_doc").withColumn("_seeds", F.expr(identity.seeds_of("_found")))
    tried = identity.labelled_candidates("value", "_seeds")
    rows = stored(rows.withColumn("_tried", F.expr(f"if(_seeded or size(_seeds) > 0, {tried}, cast(array() as {identity.TRIED}))")).drop("_seeds"))
    left = rows.filter("_seeded").select("_row", "doc_id", F.explode(F.expr("filter(_tried, m -> m.label is null and size(m.tokens) > 0)")).alias("m"))
    hit = seeds.matched(["doc_id"], left.select("_row", "doc_id", "m", F.col("m.tokens").alias("words")), known)
    come = hit.groupBy("_row").agg(F.collect_list(F.struct("m.start", "m.stop", "m.original", "label")).alias("_come"))
    rows = rows.join(come, "_row", "left").withColumn("_come", F.coalesce("_come", F.expr("cast(array() as array<struct<start:int,stop:int,original:string,label:string>>)")))
    made = f"concat(_found, {identity.seed_findings('_tried', '_found')}, {identity.seed_findings('array_sort(_come)', '_found')})"
    rows = rows.withColumn("_second", F.expr(sorted_distinct(made))).drop("_found", "_tried", "_come", "_row", "_seeded")
    merged = "if(size(_second) > 0, flatten(array(findings, filter(_second, s -> not exists(findings, f -> f.start = s.start and f.stop = s.stop and f.label = s.label and f.milli = s.milli)))), findings)"
    return exploded(rows.withColumn("findings", F.expr(merged)).drop("_second"))


def _by_document(rows: DataFrame, other: DataFrame, also: str) -> DataFrame:
    """Rows beside another table's rows of their document (a null one is one) and of the same `also`."""
    other = other.withColumnRenamed("doc_id", "_seed_doc").withColumnRenamed(also, "_seed_also")
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_seed_doc")) & (F.col(also) == F.col("_seed_also"))).drop("_seed_doc", "_seed_also")
