"""The seed index: confident names of a document meet their variants by keys, not each candidate with each seed.

Words are within one edit of each other just if they share a key: the word itself or what is left of it without one character (words of fewer
than four characters have themselves as a key alone). A document's seeds form a trie by count of words and words; a candidate walks it
word by word, each step a join on (document, count, seeds' words so far, key), and what a key brings together is compared. So names that share
a first or last word cost nothing, and a document's candidates take time linear in them; words behind the third are compared
directly. Everything is rows: no document's seeds are in one array, and a hot document's rows are split by their words.

Nulls: a null document has its own seeds; rows that repeat a value give their findings as often. No seeds: no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import sql
from ..functions.text import matches, tokens
from ..plans.storage import stored

#: Words that joins compare one by one.
STEPS = 3


def keys(word: str) -> str:
    """A word and, from four characters on, what is left of it without each of its characters."""
    return f"if(length({word}) < 4, array({word}), array_distinct(concat(array({word}), transform(sequence(1, length({word})), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1))))))"


def near(left: str, right: str) -> str:
    """Equal, or both of four characters at least and within one edit."""
    return f"({left} = {right} or length({left}) >= 4 and length({right}) >= 4 and abs(length({left}) - length({right})) <= 1 and levenshtein({left}, {right}, 1) >= 0)"


def candidates(values: DataFrame, value: str = "value") -> DataFrame:
    """Runs of one to three words of a value, with their normal words; the other columns stay."""
    rows = values.select(*(c for c in values.columns if c != value), F.posexplode_outer(F.expr(matches(value, sql("CANDIDATE")))).alias("place", "m")).filter("place is not null")
    return rows.withColumn("words", F.expr(tokens("m.original"))).filter("size(words) > 0")


def matched(doc: list[str], found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Candidates (columns of `doc`, words, ...) with `label`, that of the first seed (`doc`, label, words, rank) that fits; others go.

    Sequences of words are joined once for each document, however often they occur in it."""
    at = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in doc] + [F.col(c).isNull().alias(f"_{c}_null") for c in doc]
    names = [f"_{c}" for c in doc] + [f"_{c}_null" for c in doc]
    key = [*names, "n"]
    own = seeds.select(*at, F.size("words").alias("n"), F.col("words").alias("seed"), "label", "rank").groupBy(*key, "seed").agg(F.min(F.struct("rank", "label")).alias("first"))
    own = stored(own)
    asked = stored(found.select(*at, F.size("words").alias("n"), "words").distinct())
    pairs = None
    for step in range(STEPS):
        word = lambda c, k=step: F.expr(f"get({c}, {k})")
        reach = f"n > {step}"
        nodes = own.filter(reach).select(*key, *(F.expr(f"get(seed, {k})").alias(f"s{k}") for k in range(step + 1))).distinct()
        nodes = nodes.withColumn("key", F.explode(F.expr(keys(f"s{step}"))))
        walk = asked.filter(reach).select(*key, *(word("words", k).alias(f"c{k}") for k in range(step + 1))).distinct()
        if pairs is not None:
            walk = walk.join(pairs, [*key, *(f"c{k}" for k in range(step))])
        walk = walk.withColumn("key", F.explode(F.expr(keys(f"c{step}"))))
        on = [*key, *(f"s{k}" for k in range(step)), "key"]
        met = walk.join(nodes, on).filter(near(f"c{step}", f"s{step}"))
        whole = met.select(*key, *(f"c{k}" for k in range(step + 1)), *(f"s{k}" for k in range(step + 1))).distinct()
        pairs = whole
        last = F.col("n") == step + 1 if step + 1 < STEPS else F.col("n") >= STEPS
        # The sequences that end here: their seeds, by the seeds' words so far.
        ends = pairs.filter(last)
        ends = ends.join(asked.filter(last).select(*key, "words", *(word("words", k).alias(f"c{k}") for k in range(step + 1))), [*key, *(f"c{k}" for k in range(step + 1))])
        ends = ends.join(own.filter(last).select(*key, "seed", "first", *(F.expr(f"get(seed, {k})").alias(f"s{k}") for k in range(step + 1))), [*key, *(f"s{k}" for k in range(step + 1))])
        if step + 1 == STEPS:
            ends = ends.filter(f"n = {STEPS} or forall(zip_with(words, seed, (p, q) -> {near('p', 'q')}), e -> e)")
        fits = ends.groupBy(*names, "words").agg(F.min("first").alias("first"))
        all_fits = fits if step == 0 else all_fits.unionByName(fits)
    taken = all_fits.select(*names, "words", F.col("first.label").alias("label"))
    marked = found.select("*", *at)
    return marked.join(taken, [*names, "words"]).drop(*names)


def spread(values: DataFrame, doc: list[str], value: list[str], findings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Findings that seeds make of values (columns of `doc` and `value`, and `value`): label, start, stop, original. What a finding (`doc`, `value`,
    label, start, stop) of that label covers already is left out."""
    # Documents without seeds, which are most, are left before their words are made rows.
    seeded = seeds.select(*(F.col(c).alias(f"s_{c}") for c in doc)).distinct()
    there: Column = F.lit(True)
    for c in doc:
        there = there & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    values = stored(values.join(seeded, there, "left_semi"))
    found = candidates(values).select(*doc, *value, F.col("m.start").alias("start"), F.col("m.stop").alias("stop"), F.col("m.original").alias("original"), "words")
    hit = matched(doc, found, seeds)
    known = findings.select(*(F.col(c).alias(f"f_{c}") for c in (*doc, *value, "label", "start", "stop")))
    same: Column = F.lit(True)
    for c in (*doc, *value):
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    for c in ("label", "start", "stop"):
        same = same & (F.col(c) == F.col(f"f_{c}"))
    return hit.join(known, same, "left_anti").select(*doc, *value, "label", "start", "stop", "original")
