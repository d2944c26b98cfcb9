import json
import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import cloakline
from cloakline import samples
from cloakline.functions import patterns, text
from cloakline.functions.evidence import shape_labels
from cloakline.functions.patterns import java, quoted, sql
from cloakline.operators import intervals, redaction, scan, seeds, words
from cloakline.operators.scan import with_findings
from cloakline.plans.options import PRESETS, Options
from cloakline.sources import parsers
from cloakline.streaming import redact_stream, scan_document_stream, scan_stream

#: Worked out by hand from the published hash and generator constants.
PSEUDONYMS = [
    ("EMAIL", "ivo.b@post.example", "user+1hugsfw7ph@example.test"), ("PERSON", "Ivo Brandt", "Person_1kyts5kf"), ("PLACE", "Bergen", "Place_157gun"),
    ("ORG", "Ekdahl Verk AB", "Org_6bbwai1"), ("IPV4", "203.0.113.77", "198.51.100.179"), ("IPV6", "2001:db8:0:7::9", "2001:db8::7d29"),
    ("CREDIT_CARD", "4000 0000 0000 0002", "4111 1111 7703 2675"), ("SSN", "078-05-1120", "redact-1idltj01sin5kb1p"),
]


def test_pseudonyms(spark):
    rows = spark.createDataFrame([p[:2] for p in PSEUDONYMS], "label string, original string").withColumn("p", F.expr(text.pseudonym("label", "original")))
    assert {(r.label, r.p) for r in rows.collect()} == {(p[0], p[2]) for p in PSEUDONYMS}


def fnv(s: str) -> int:
    h, raw = 2166136261, s.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def test_hash_is_over_utf16_units(spark):
    values = ["", "a", "é", "漢字", "x📧y", "𝒜"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.expr(text.fnv1a("v")).alias("h"))
    assert {r.v: r.h for r in rows.collect()} == {v: fnv(v) for v in values}


@pytest.mark.parametrize(
    ("value", "pattern", "want"),
    [("éa@b.com x", r"\b[A-Za-z]+@b\.com\b", ["a@b.com"]), ("xa@b.comé", r"\b[A-Za-z]+@b\.com\b", ["xa@b.com"]), ("a@b.com_", r"\b[A-Za-z]+@b\.com\b", []), ("abc\n", r"^abc$", []), ("José", r"^[\p{Latin}\p{M}]+$", ["José"]), ("a\xa0b", r"a\sb", ["a\xa0b"])],
)
def test_pattern_dialect(spark, value, pattern, want):
    got = spark.createDataFrame([(value,)], "v string").select(F.expr(text.matches("v", quoted(java(pattern)))).alias("m")).first().m
    assert [x.original for x in got] == want and all(value[x.start : x.stop] == x.original for x in got)


def test_offsets_are_code_points(spark):
    rows = spark.createDataFrame([("📧 a@b.co, é c@d.org",)], "v string").select("v", F.expr(text.matches("v", sql("EMAIL"))).alias("m")).first()
    assert [rows.v[x.start : x.stop] for x in rows.m] == ["a@b.co", "c@d.org"]


def merged(findings):
    """Overlap collapse, one finding after the other."""
    out = []
    for f in sorted((f for f in findings if f[1] > f[0]), key=lambda f: (f[0], f[1], -f[3])):
        if not out or f[0] >= out[-1][1]:
            out.append(list(f))
        else:
            last = out[-1]
            if f[3] > last[3]:
                last[2] = f[2]
            last[1], last[3] = max(last[1], f[1]), max(last[3], f[3])
    return [tuple(x) for x in out]


def test_collapse_in_rows_and_by_windows(spark):
    rng = random.Random(1)
    docs = []
    for d in range(150):
        spans = []
        for k in range(rng.randrange(8)):
            a = rng.randrange(30)
            spans.append((a, a + rng.randrange(8), f"L{k}", rng.choice((0.5, 0.6, 0.7, 0.8, 0.9)) + k / 1000))
        docs.append((d, spans))
    rows = [(d, a, b, label, c, [label]) for d, spans in docs for a, b, label, c in spans]
    df = spark.createDataFrame(rows, "doc_id long, start int, stop int, label string, confidence double, reasoning array<string>")
    got = {}
    for r in redaction.collapsed(df, ["doc_id"]).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.label, r.confidence))
    inside = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "label", "confidence", "reasoning")).alias("f")).select("doc_id", F.expr(redaction.collapse("f", "pseudo")).alias("c"))
    rowwise = {r.doc_id: [(x.start, x.stop, x.label, x.confidence) for x in r.c] for r in inside.collect()}
    for d, spans in docs:
        want = merged(spans)
        assert sorted(got.get(d, [])) == want and rowwise.get(d, []) == want
        assert all(a[1] <= b[0] for a, b in zip(want, want[1:]))


def test_nested_by_windows(spark):
    rng = random.Random(2)
    spans = {(d, label, a, a + rng.randrange(1, 9)) for d in range(60) for label in "AB" for a in (rng.randrange(12) for _ in range(4))}
    df = spark.createDataFrame([(*s, 0.5) for s in spans], "doc_id long, label string, start int, stop int, confidence double")
    want = {s for s in spans if not any(o != s and o[:2] == s[:2] and o[2] <= s[2] and o[3] >= s[3] for o in spans)}
    assert {(r.doc_id, r.label, r.start, r.stop) for r in redaction.without_nested(df, ["doc_id"]).collect()} == want


def values(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, value string").withColumn("kind", F.lit("text"))


def test_redaction_leaves_nothing_selected_and_is_idempotent(spark):
    df = values(spark, [(r[0], r[3]) for r in samples.VALUES])
    once = redaction.redact_values(scan.with_findings(df, PRESETS["balanced"]), 0.55).select("doc_id", "findings", "output").cache()
    for r in once.collect():
        strong = [f.original for f in r.findings if f.confidence >= 0.55 and len(f.original) > 5]
        assert not any(o in r.output for o in strong), r
    again = redaction.redact_values(scan.with_findings(once.select("doc_id", F.col("output").alias("value"), F.lit("text").alias("kind")), PRESETS["balanced"]), 0.9)
    assert again.filter("output like '%[[REDACTED]]%'").count() == 0


def test_every_sample_is_found(spark):
    report = {r.category: (r.hit, r.total) for r in cloakline.queries()["coverage_report"](spark, "").collect()}
    assert report["all"] == (len(samples.VALUES), len(samples.VALUES))


def test_categories_and_presets(spark):
    df = values(spark, [(r[0], r[3]) for r in samples.VALUES])
    secrets = {r.category for r in scan.scan_values(df, PRESETS["secrets_only"]).collect()}
    assert secrets == {"secrets", "network"}
    assert "network" not in {r.category for r in scan.scan_values(df, PRESETS["structured_pii"]).collect()}
    assert Options(categories=frozenset()).on("REDACTED") and not Options(categories=frozenset()).on("EMAIL")


def test_empty_and_null_values(spark):
    df = values(spark, [(1, None), (2, ""), (3, " \n ")])
    assert scan.scan_values(df).count() == 0
    assert [r.output for r in redaction.redact_values(scan.with_findings(df)).orderBy("doc_id").collect()] == ["", "", " \n "]


def test_seeds_spread_over_a_document_only(spark):
    rows = [(1, 0, "Mia Berg", "full_name"), (1, 1, "m1a berg called", "remark"), (2, 0, "m1a berg called", "remark")]
    df = spark.createDataFrame(rows, "doc_id long, value_seq long, value string, key_hint string").withColumn("kind", F.lit("json"))
    got = {(r.doc_id, r.value_seq, r.original) for r in scan.scan_collection(df).collect() if r.confidence == 0.68}
    assert got == set() or {g[0] for g in got} == {1}
    lists = [(1, 0, "Mia Berg", "full_name"), (1, 1, "seen: m1a berg", "remark")]
    df = spark.createDataFrame(lists, "doc_id long, value_seq long, value string, key_hint string").withColumn("kind", F.lit("json"))
    assert "m1a berg" in {r.original for r in scan.scan_collection(df).collect()}


def test_profiles_are_of_the_whole_column(spark, tmp_path):
    """Keys beyond 100,000 and negative ones are the same table's: one row for each column and label, as the SQL has it."""
    keys = [-1, 0, 1, 99_999, 100_000, 250_000, 1_000_000, 12_345_678, 10_000_000_000]
    rows = [(k, f"Customer#{n}" if n % 3 else None, ("BUILDING", "MACHINERY", " ", "")[n % 4]) for n, k in enumerate(keys)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in cloakline.queries()["profile_columns"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(cloakline.oracles()["profile_columns"]).fetchall())
    assert len({r[:2] for r in got}) == len(got)


def test_selection_is_taken_over_as_bags(spark):
    old = spark.createDataFrame([("f-1", "A", "x", 0), ("f-2", "A", "x", 5)], "finding_id string, label string, original string, start int")
    new = spark.createDataFrame([("f-1", "A", "x", 5), ("f-2", "A", "x", 9), ("f-3", "A", "x", 12), ("f-4", "B", "x", 0)], "finding_id string, label string, original string, start int")
    got = redaction.restored_selection(new, old, ["label", "original", "start"], ["label", "original"])
    assert sorted(r.finding_id for r in got.collect()) == ["f-1", "f-2"]


def test_rows_of_a_page(spark):
    items = spark.createDataFrame([(1, 1, 0, "b", 50.0, 10.0, 58.0, 20.0), (1, 1, 1, "a", 10.0, 12.5, 18.0, 22.5), (1, 1, 2, "c", 10.0, 13.5, 18.0, 23.5), (1, 1, 3, " ", 10.0, 10.0, 11.0, 20.0)], "doc_id int, page int, item_no int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.line_no, r.word_no, r.text) for r in words.page_rows(items).orderBy("line_no", "word_no").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(r[0], r[3]) for r in samples.VALUES]
    values(spark, rows).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, value string, kind string").json(f"{tmp_path}/in")
    options = PRESETS["secrets_only"]
    for name, made in (("found", scan_stream(stream, options).select("doc_id", "label", "start", "stop")), ("masked", redact_stream(stream, options, 0.55).select("doc_id", "output"))):
        q = made.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = values(spark, rows)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, scan.scan_values(batch, options).select("doc_id", "label", "start", "stop").collect()))
    want = redaction.redact_values(scan.with_findings(batch, options), 0.55).select("doc_id", "output")
    assert sorted(map(tuple, spark.table("masked").collect())) == sorted(map(tuple, want.collect()))


def test_search_and_numbers(spark):
    df = spark.createDataFrame([(1, "EMAIL", "Ann@x.org", 0, 9, 0.9, ["pattern"]), (1, "BIC", "ABCDUS33", 20, 28, 0.7, ["bic"])], "doc_id long, label string, original string, start int, stop int, confidence double, reasoning array<string>")
    assert [r.label for r in redaction.searched(df, "ANN").collect()] == ["EMAIL"] and redaction.searched(df, "").count() == 2
    assert [r.finding_id for r in redaction.numbered(df, ["doc_id"], ["start"]).orderBy("start").collect()] == ["f-0001", "f-0002"]
    assert redaction.summary(df, ["doc_id"]).first().asDict() == {"doc_id": 1, "total": 2, "high": 1, "medium": 1}


def test_entry(spark):
    entry = __import__("__spark_entry__")
    rows = entry.entry(spark).collect()
    assert rows and all(r.n_findings > 0 and "[REDACTED]" in r.redacted_text for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert json.dumps(sorted(entry.queries()))


def pieces(rng, parts, n, most):
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_patterns_for_java_match_the_shared_ones(spark, monkeypatch):
    """Addresses, tokens and labelled names by patterns that meet a run once, against the plain patterns."""
    rng = random.Random(1)
    plain = lambda name: patterns.quoted(patterns.PATTERNS[name].replace(r"\b", patterns.BOUNDARY))
    monkeypatch.setattr(text, "LONG_RUN", patterns.LONG_RUN.replace("{500}", "{2}"))
    mails = pieces(rng, ["a", "b1", "com", "xy", "@", "@x.", "@bc", "..", ".", "-", "_", "+", " ", ".com", ".org", "\x01", "é"], 4000, 12)
    tokens = pieces(rng, ["eyJ", "-", "_", "a", ".", ".", ".b", "eyJx", " ", "x"], 4000, 14)
    labels = pieces(rng, ["Name", ": ", "- ", "-", "-Ann", "Lee", " ", "  ", "\n", "a", "b-", "c'", "5", ".", "é", "=", "Client:", "\x01", "x"], 4000, 14)
    cases = [(mails, text.emails("v", "EMAIL"), plain("EMAIL")), (mails, text.emails("v", "EMAIL_LOOSE"), plain("EMAIL_LOOSE")), (tokens, text.jwts("v"), plain("JWT")), (labels, text.labelled("v"), patterns.sql("LABELLED"))]
    for values, fast, pattern in cases:
        rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.to_json(F.expr(fast)).alias("a"), F.to_json(F.expr(text.matches("v", pattern))).alias("b"))
        assert rows.filter("b <> '[]'").count() > 20 and rows.filter("a <> b").collect() == []
    rows = spark.createDataFrame([(v,) for v in mails], "v string").select("v", F.expr("v rlike " + patterns.sql("EMAIL_VALUE")).alias("m")).collect()
    whole = re.compile(patterns.PATTERNS["EMAIL_VALUE"].replace("$", r"\Z"), re.A)
    assert [r.m for r in rows] == [bool(whole.match(r.v)) for r in rows]


def test_long_values_end_in_time(spark):
    """300 KB of labels, line ends, digits, words, hyphens, token starts and brackets: each pattern's time is linear in them, and no stack ends."""
    n = 300_000
    values = ["x@" + "a." * (n // 2) + "com", "\n" * n + "x", "1" * n, "12 " * (n // 3), "word " * (n // 5), "a-" * (n // 2) + ":", "eyJ-" * (n // 4), "[" * (n // 2) + "]" * (n // 2), " " * n + "x", "a@" * (n // 2)]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id int, value string").repartition(4)
    found = {r.doc_id: r.n for r in with_findings(rows).select("doc_id", F.size("findings").alias("n")).collect()}
    assert found[0] == 1 and time.time() - began < 150
    began = time.time()
    assert [parsers.sniff(v) for v in values] and parsers.sniff("--|--" + " " * n + "x\n") == [] and time.time() - began < 20


def test_seed_index_is_the_nested_comparison(spark):
    """Words one edit apart, in any word of names of one to four words, documents apart, null documents; and 10,000 names in one text."""
    rng = random.Random(4)
    names = ["ann lee", "anne leed", "karl berg", "carl berg", "karl bergs", "maria del rio", "maria dal rio", "x", "xy", "abcd", "abce", "a-b-c-d", "anna-lena von berg", "anna lena van berg"]
    rows = [(d, rng.choice(names)) for d in (1, 2, None) for _ in range(12)]
    own = [(d, rng.choice(["PERSON", "PLACE"]), rng.choice(names), k) for d in (1, 2, None) for k in range(5)]
    values = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc int, value string, seq int")
    held = spark.createDataFrame(own, "doc int, label string, name string, rank int").withColumn("words", F.expr(text.tokens("name")))
    none = spark.createDataFrame([], "doc int, seq int, label string, start int, stop int")
    got = sorted((r.seq, r.label, r.original) for r in seeds.spread(values, ["doc"], ["seq"], none, held).collect())
    found = seeds.candidates(values).select("doc", "seq", F.col("m.original").alias("original"), "words").alias("c")
    pairs = found.join(held.alias("s"), F.expr(f"c.doc <=> s.doc and {text.same_tokens('c.words', 's.words')}"))
    want = pairs.groupBy("c.seq", "c.original").agg(F.min(F.struct("s.rank", "s.label")).alias("first")).select("seq", "first.label", "original")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 10
    many = [f"Ann {''.join(rng.choice('bcdfgaeiou') for _ in range(8))}" for _ in range(10_000)]
    one = spark.createDataFrame([(1, ", ".join(many), 0)], "doc int, value string, seq int")
    held = spark.createDataFrame([(1, "PERSON", n, k) for k, n in enumerate(many)], "doc int, label string, name string, rank int").withColumn("words", F.expr(text.tokens("name")))
    began = time.time()
    assert seeds.spread(one, ["doc"], ["seq"], none, held).count() == 10_000 and time.time() - began < 90


def test_interval_join_is_the_range_join(spark):
    """Spans of all lengths, empty and null ones, one hot document; and a plan without a cartesian or nested-loop join."""
    rng = random.Random(6)

    def spans(n):
        return [(rng.choice([1, 1, 1, 2, None]), k, s, s + rng.choice([0, 1, 5, 70, 300, 5000, 40_000])) for k in range(n) for s in [rng.randint(0, 50_000)]] + [(1, n, None, 5), (1, n + 1, 5, None)]

    left, right = (spark.createDataFrame(spans(n), "doc int, k int, start int, stop int") for n in (150, 200))
    pairs = intervals.overlapping(left, right, ["doc"])
    got = sorted((r.k, r.r_k) for r in pairs.collect())
    want = sorted((r.k, r.r_k) for r in left.alias("a").join(right.alias("b"), F.expr("a.doc = b.doc and a.start < b.stop and b.start < a.stop")).select("a.k", F.col("b.k").alias("r_k")).collect())
    assert got == want and len(got) > 1000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_conversations_as_a_stream_of_turns(spark, tmp_path):
    """Turns in single files, out of order and late within the watermark: each document's findings are the batch's, in one piece, and the state is emptied."""
    turns = [(d, k, f"2024-01-01 10:{10 * d + k:02d}:00", v) for d, vs in enumerate((["Contact: Ann Lee", "Anne Lee called", "mail ann@lee.example"], ["so: Karl Berg, came", "Customer: Karl Berg"], ["nothing here"])) for k, v in enumerate(vs)]
    turns.append((9, 0, "2024-01-01 23:00:00", "closes the others"))
    turns.append((10, 0, "2024-01-02 23:00:00", "and that one"))
    order = [1, 0, 4, 2, 3, 5, 6, 7]  # the second turn before the first, two documents mixed
    for n, i in enumerate(order):
        path = tmp_path / "in" / f"{n}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(dict(zip(("doc_id", "value_seq", "time", "value"), turns[i]))) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("doc_id long, value_seq long, time timestamp, value string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out, batches = [], []

    def sink(found, epoch):
        rows = [(r.doc_id, r.value_seq, r.label, r.start, r.stop) for r in found.collect()]
        out.extend(rows)
        batches.append({r[0] for r in rows})

    query = scan_document_stream(stream, sink, gap="30 minutes", lateness="10 minutes").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(240)
    batch = spark.createDataFrame([(d, k, v, "text") for d, k, _, v in turns if d < 10], "doc_id long, value_seq long, value string, kind string")
    want = sorted((r.doc_id, r.value_seq, r.label, r.start, r.stop) for r in scan.scan_collection(batch).collect())
    assert sorted(out) == want and {(0, 1, "PERSON"), (1, 0, "PERSON")} <= {r[:3] for r in out}
    assert sum(0 in b for b in batches) == 1
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress if p["stateOperators"]) >= 3


def test_labels_are_sought_near_their_ends_only(spark):
    """Same spans as the plain pattern on random texts; prose with few labels takes about as long as reading it a few times."""
    rnd = random.Random(3)
    bits = ["a", "Ann", "Lee", "-", "-", "'", ".", ":", "=", " ", " ", " ", "\t", "\n", ",", "é", "x", "Name", "customer", "_", "/", "9", "’", "漢", "Marie-Anne", "😀", "\r\n", " " * 45, "abcdefghij" * 5, "Ann-\nLee Smith"]
    rows = [("".join(rnd.choice(bits) for _ in range(rnd.randint(1, rnd.choice([12, 60, 300])))),) for _ in range(3000)]
    plain = text.matches("value", patterns.quoted(patterns.java("LABELLED")))
    found = spark.createDataFrame(rows, "value string").selectExpr(f"{plain} as want", f"{text.labelled('value')} as got")
    assert found.filter("size(want) > 0").count() > 300
    assert found.filter("not want <=> got").count() == 0
    prose = spark.range(1).selectExpr("concat(repeat('The quick brown fox jumps over the lazy dog near the river bank and a well-known, hill. ', 40000), 'Customer: Ann Lee') as value")
    prose.selectExpr(text.labelled("value")).collect()
    began = time.monotonic()
    assert [m.original for m in prose.selectExpr(text.labelled("value")).first()[0]][-1].endswith("Customer: Ann Lee")
    assert time.monotonic() - began < 6  # 3.5 million characters; 80 tries a place took 15 s and more


def test_shapes_of_long_values_take_no_copies(spark):
    long = spark.range(1).selectExpr("concat('DE', repeat(' a. b', 1000000)) as value")
    short = spark.createDataFrame([("de893704 0044 0532 0130 00",), ("D E.136-695 976",), ("ndeıfiſ1",), ("  deutdeff 　",), ("ab" * 8,)], "value string")
    found = [r[0] for r in short.selectExpr(shape_labels("value")).collect()]
    assert "IBAN" in found[0] and "VAT_ID" in found[1] and "BIC" in found[3] and "VAT_ID" not in found[4]
    long.selectExpr(shape_labels("value")).collect()
    began = time.monotonic()
    assert long.selectExpr(shape_labels("value")).first()[0] == []
    assert time.monotonic() - began < 1.5


def test_gates_let_every_match_through(spark):
    """Each detector finds what its plain pattern finds on random texts."""
    rnd = random.Random(9)
    bits = ["1", "23", "456", "7890", "-", ".", " ", "(", ")", "+", "A", "BC", "DEUTDEFF", "de", "P<", "<", "x", "_", "\n", "AB12 3456 7890 1234 5678", "sixteenCharacter", "é", " ", "  ", "ff:", "0a-"]
    rows = [("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "value string")
    for name in patterns.LEADS:
        plain = patterns.PATTERNS[name].replace(r"\b", patterns.BOUNDARY).replace(r"\s", f"[{patterns.SPACE}]").replace(f"[[{patterns.SPACE}]", f"[{patterns.SPACE}")
        assert df.filter(f"not {text.matches('value', quoted(plain))} <=> {text.matches('value', sql(name))}").count() == 0, name
    gates = {"PHONE": rf"[0-9]{{3}}[{patterns.SPACE}.-]?[0-9]{{3}}", "CREDIT_CARD": "(?:[0-9][ -]*+){13}", "IBAN": "[0-9]{2}(?<=[A-Za-z]{2}[0-9]{2})", "MAC_ADDRESS": "[:-][0-9A-Fa-f]{2}[:-]", "SECRET": r"[\w-]{24}"}
    for name, gate in gates.items():
        assert df.filter(f"value rlike {sql(name)} and not value rlike {quoted(gate)}").count() == 0, name
        assert df.filter(f"value rlike {sql(name)}").count() > 0 or name == "MAC_ADDRESS", name


@pytest.mark.parametrize("name", ["selection_trust", "selection_restore"])
def test_texts_are_scanned_once_for_a_selection(spark, name):
    rows = cloakline.queries()[name](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in rows._jdf.queryExecution().toString()
