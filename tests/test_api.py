from pyspark.sql import functions as F

from cloakline import api


def test_redact_text_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "mail ann@lee.example", "k"), (2, None, "x"), (3, "", "y")], "id int, body string, kind string")
    got = {r.id: r for r in api.redact_text(df, "body").collect()}
    assert got[1].body == "mail [REDACTED]" and got[2].body is None and got[3].body == "" and got[1].kind == "k"
    assert api.redact_text(df, "body", mode="pseudo").filter("id = 1").first().body.endswith("@example.test")


def test_display_and_html(spark):
    df = spark.createDataFrame([("EMAIL", "a@b.co", 0.91, ["x"]), ("BIC", "Q", 0.7, ["x"])], "label string, original string, confidence double, reasoning array<string>")
    assert {(r.label, r.badge, r.percent) for r in api.findings_for_display(df).collect()} == {("EMAIL", "HIGH", 91), ("BIC", "MEDIUM", 70)}
    assert spark.createDataFrame([("<a & b>",)], "t string").select(api.escape_html("t").alias("t")).first().t == "&lt;a &amp; b&gt;"


def test_replacements_by_location(spark):
    values = spark.createDataFrame([(1, 0, "ab cd"), (1, 1, "ef")], "doc_id long, value_seq long, value string")
    found = spark.createDataFrame([(1, 0, 0, 2, "X", 0.9, ["r"]), (1, 0, 1, 4, "Y", 0.8, ["r"])], "doc_id long, value_seq long, start int, stop int, label string, confidence double, reasoning array<string>")
    got = {r.value_seq: (r.output, r.n_replaced) for r in api.apply_replacements(values, found, ["doc_id", "value_seq"]).collect()}
    assert got == {0: ("[REDACTED]d", 1), 1: ("ef", 0)}


def test_preview(spark):
    rows = spark.createDataFrame([(1, s, r, c, f"{s}{r}{c}") for s in range(3) for r in range(8) for c in range(2)], "doc_id int, sheet_index int, row_index int, column_index int, value string")
    got = api.sheet_preview(rows)
    assert got.count() == 10 and got.agg(F.max("nth")).first()[0] == 5


def test_sql_names(spark):
    api.register(spark)
    spark.createDataFrame([(1, "a.csv", "name,mail\nAnn,ann@lee.example\n"), (2, "b.json", '{"k": {"v": "x"}}'), (3, "c.csv", None)], "id int, name string, text string").createOrReplaceTempView("own_files")
    got = [tuple(r) for r in spark.sql("SELECT id, v.reading, v.value, v.path FROM own_files, LATERAL document_values(name, text) v WHERE v.unit = 'cell' AND v.preferred ORDER BY id, v.value_seq").collect()]
    assert [r[:3] for r in got] == [(1, "csv", "Ann"), (1, "csv", "ann@lee.example"), (2, "json", "x")] and got[2][3] == ["k", "v"]
    assert spark.sql("SELECT reason FROM office_values('x.xlsx', X'00')").first().reason.startswith("BadZipFile")
    one = spark.createDataFrame([("EMAIL", "ann@lee.example")], "label string, original string")
    for name, mode in (("redacted", "redact"), ("pseudonym", "pseudo")):
        assert one.selectExpr(f"{name}(label, original) as x").first().x == one.select(api.replacement_for("label", "original", mode).alias("x")).first().x


def test_redact_text_in_sql(spark):
    """The SQL function gives what the DataFrame form gives, nulls, empty texts and names included."""
    api.register(spark)
    texts = ["mail ann@lee.example or call +44 20 7946 0958", None, "", "Contact: Ann Lee\nAnn Lee wrote to Anne Lee", "key sk-abcdefgh12345678", "4111 1111 1111 1111, DE44 5001 0517 5407 3249 31"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    df.createOrReplaceTempView("own_texts")
    got = {r.id: r.body for r in spark.sql("SELECT id, redact_text(body) AS body FROM own_texts").collect()}
    assert got == {r.id: r.body for r in api.redact_text(df, "body").collect()} and got[1] is None and "[REDACTED]" in got[0]
