"""Whole documents: parsing, scan, choice of reading, redaction in place. fixtures/documents.json holds our own documents, and what must stand and must be gone in their redacted form."""

import io
import json
import os
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakline.plans import documents as plan
from cloakline.plans.options import PRESETS, THRESHOLDS
from cloakline.sources import parsers

CASES = json.load(open(os.path.join(os.path.dirname(__file__), "fixtures", "documents.json"), encoding="utf-8"))


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(k, c.get("file"), c["document"]) for k, c in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    found = plan.scan_documents(docs).cache()
    limits = spark.createDataFrame([(k, THRESHOLDS[c["least"]]) for k, c in enumerate(CASES)], "doc_id long, least double")
    chosen = found.join(limits, "doc_id").filter("confidence >= least")
    output = {r.doc_id: r.output for r in plan.redact_documents(docs, chosen).collect()}
    totals = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    return output, totals


@pytest.mark.parametrize("k", range(len(CASES)), ids=lambda k: CASES[k]["name"])
def test_case(scanned, k):
    output, totals = scanned
    case = CASES[k]
    assert [x for x in case.get("stays", []) if x not in output[k]] == [] == [x for x in case.get("goes", []) if x in output[k]], output[k]
    assert case.get("found", 0) <= totals.get(k, 0) <= case.get("most", 10**9)


def test_csv_shapes():
    assert parsers.table('a,b\n"x ""q"" y",2\r\n\n3\n', ",") == (["a", "b"], [['x "q" y', "2"], ["3", ""]])
    assert parsers.records('a"b,c"d,e\r1', ",") == [["ab,cd", "e"], ["1"]]
    assert parsers.records("", ",") == [[""]] and parsers.table("", ",") == ([], [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n\r ;\t', max_size=6), min_size=2, max_size=4), min_size=1, max_size=5), st.sampled_from([",", "\t"]), st.sampled_from(["\n", "\r\n"]))
def test_delimited_round_trip(rows, separator, ending):
    width = len(rows[0])
    rows = [(r + [""] * width)[:width] for r in rows]
    text = parsers.delimited_text(rows[0], rows[1:], separator, ending, True)
    assert parsers.table(text, separator) == (rows[0], rows[1:])


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


def strings_in(value, path=()):
    if isinstance(value, str):
        yield list(path), value
    for k, v in enumerate(value) if isinstance(value, list) else value.items() if isinstance(value, dict) else ():
        yield from strings_in(v, (*path, str(k)))


@settings(max_examples=300, deadline=None)
@given(JSON, st.sampled_from([None, 2]), st.booleans())
def test_json_strings_have_their_places(value, indent, ascii_only):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    got = list(parsers.json_values(text))
    assert [(v["path"], v["value"]) for v in got] == list(strings_in(value))
    assert all(json.loads(text[v["span_start"] : v["span_stop"]]) == v["value"] for v in got)


@pytest.mark.parametrize("text", ["", "{", '{"a" 1}', "[1,]", '{"a":1,}', "[1 2]", '"a" x', "{]", "tru", '{"a"}', "[", '["a'])
def test_what_is_not_json_is_refused(text):
    with pytest.raises(ValueError):
        list(parsers.json_values(text))


def test_yaml_values_and_places():
    text = "mail: a@b.c # hi\r\nlist:\n  - one\n  - 'two # no'\nb: |\n  body\n  x: y\nk: \"v\"\n# c: d\n- key: v\n"
    got = list(parsers.yaml_values(text))
    assert [(v["value"], v["key_hint"]) for v in got] == [("a@b.c", "mail"), ("one", ""), ("two # no", ""), ("v", "k"), ("key: v", "")]
    assert all(text[v["span_start"] : v["span_stop"]] == v["value"] for v in got)


def test_yaml_quotes_and_comments():
    text = "a: it's # no comment\nb: x \\\" # comment\nc: \"x \\\" # y\" # comment\nd:#comment\ne: p#q\n  : |\n    # body\n\n   z: body\nf: >-\n  g: body\n"
    got = list(parsers.yaml_values(text))
    assert [(v["value"], v["key_hint"]) for v in got] == [("it's # no comment", "a"), ('x \\"', "b"), ('x \\" # y', "c"), ("p#q", "e")]
    assert [v["segment_index"] for v in got] == [0, 1, 2, 3]


def test_deep_nesting_and_lone_surrogates(spark):
    deep = "[" * 100_000 + '"x"' + "]" * 100_000
    with pytest.raises(ValueError):
        list(parsers.json_values(deep))
    assert len(list(parsers.json_values("[" * 900 + '"x"' + "]" * 900))) == 1
    docs = spark.createDataFrame([(1, None, deep), (2, "s.json", '{"a\\ud800": "x\\udc00 ann@lee.example", "b": "\\ud83d\\ude00"}'), (3, None, '{"a":' * 50_000)], "doc_id long, name string, text string")
    got = {(r.doc_id, r.key_hint): r.value for r in plan.document_values(docs).filter("unit = 'cell'").collect()}
    assert got == {(2, "a\ufffd"): "x\ufffd ann@lee.example", (2, "b"): "\U0001f600"}
    found = plan.scan_documents(docs, PRESETS["balanced"]).filter("label = 'EMAIL'")
    assert found.count() == 1 and '"b": "\\ud83d\\ude00"' in plan.redact_documents(docs, found).filter("doc_id = 2").first().output


def test_markdown_cells_and_places():
    text = "x\n\n| Name | Notes |\n|:--|--:|\n| `Ann Lee` | **b** \\| c |\n| Bo | |\n\n```\n| a | b |\n| -- | -- |\n| c | d |\n```\n"
    tables = list(parsers.markdown_tables(text))
    assert [[c for c, _ in r] for r in tables[0]] == [["Name", "Notes"], ["Ann Lee", "**b** \\| c"], ["Bo", ""]] and len(tables) == 1
    assert all(text[a : a + len(c)] == c for r in tables[0] for c, a in r)


def test_what_pasted_text_is():
    kind = lambda t, name=None: parsers.format_of(name, t)[:2]
    assert kind('{"a": 1}') == ("json", []) and kind("{a") == ("text", [])
    assert kind("a: b\nc: d\ne: f") == ("yaml", []) and kind("a: b\nc: d") == ("text", ["yaml"])
    assert kind("Name,Email\nA,b@c.d\n") == ("text", ["csv"]) and kind("n,m,o\n1,2,3\n4,5,6") == ("csv", [])
    assert kind("# T\na: b\nc: d\ne: f") == ("text", []) and kind("x", "a.TSV") == ("tsv", [])
    assert parsers.format_of("a.xls", "")[0] == parsers.format_of("a.pdf", "")[0] == "rejected"


def test_refused_documents_have_no_findings(spark):
    docs = spark.createDataFrame([(1, "a.xls", "ann@lee.example"), (2, "b.json", "{"), (3, None, None)], "doc_id long, name string, text string")
    reasons = {r.doc_id: r.reason for r in plan.document_values(docs).collect()}
    assert reasons[1] and reasons[2] and reasons[3] is None
    assert plan.scan_documents(docs).count() == 0


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="People" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>email</t></si><si><t>notes</t></si><si><r><t>ann@</t></r><r><t>lee.example</t></r></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="inlineStr"><is><t>plain</t></is></c></row><row r="4"><c r="B4"><v>12.5</v></c></row></sheetData></worksheet>',
        )
    return out.getvalue()


def word_file() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>mail </w:t></w:r><w:r><w:t>bo@lee.example</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_binary_documents(spark):
    docs = spark.createDataFrame([(1, "a.xlsx", bytearray(book())), (2, "b.docx", bytearray(word_file())), (3, "c.docx", bytearray(b"broken")), (4, "d.pdf", bytearray(b"%PDF-1.4"))], "doc_id long, name string, content binary")
    found = plan.scan_documents(docs, PRESETS["balanced"])
    assert {(r.doc_id, r.label, r.original) for r in found.collect() if r.label == "EMAIL"} == {(1, "EMAIL", "ann@lee.example"), (2, "EMAIL", "bo@lee.example")}
    got = {r.doc_id: r for r in plan.redact_documents(docs, found.filter("label = 'EMAIL'")).collect()}
    assert got[2].output == "mail [REDACTED]\n\nend" and got[2].name == "b-redacted.txt"
    assert [c for _, c in parsers.workbook(bytes(got[1].data))[0][2]] == [{0: "email", 1: "notes"}, {0: "[REDACTED]", 1: "plain"}, {1: "12.5"}]
    assert got[3].output is None and got[4].output is None
