"""Word boxes of pages and recognised images: rows, n-grams, findings with boxes, page heuristics.

A words table has doc_id, page, line_no, word_no, text, x0, y0, x1, y1; a pages table doc_id, page, width, height, name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SPACE, quoted
from ..functions.text import trim
from ..plans.options import Options
from .scan import exploded, with_findings

BOX = ("x0", "y0", "x1", "y1")
LINE = ("doc_id", "page", "line_no")


def ocr_words(tsv: DataFrame, least_confidence: float = 22) -> DataFrame:
    """Words of recognition output (doc_id, tsv text): level 5, at least 12 columns, confident enough."""
    rows = tsv.select("doc_id", F.explode(F.split("tsv", r"\r?\n")).alias("_row")).select("doc_id", F.split("_row", "\t").alias("c")).filter(F.size("c") >= 12)
    # Columns: level, page, block, paragraph, line, word, left, top, width, height, confidence, text.
    number = lambda k: F.expr(f"try_cast(c[{k}] as double)")
    rows = rows.filter(F.expr("try_cast(c[0] as double) = 5")).withColumn("text", F.expr(trim("c[11]"))).filter((F.col("text") != "") & (number(10) >= least_confidence))
    rows = rows.select("doc_id", number(1).cast("int").alias("page"), *(number(k).cast("int").alias(n) for k, n in ((2, "block"), (3, "par"), (4, "line"), (5, "word_no"))), number(10).alias("conf"), "text", number(6).alias("x0"), number(7).alias("y0"), (number(6) + number(8)).alias("x1"), (number(7) + number(9)).alias("y1"))
    line = F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("block", "par", "line"))
    return rows.withColumn("line_no", line).drop("block", "par", "line")


def rescaled(words: DataFrame, x: float, y: float) -> DataFrame:
    """Boxes divided by the scale at which an image was recognised."""
    return words.withColumns({c: F.col(c) / (x if c in ("x0", "x1") else y) for c in BOX})


def page_rows(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Items of pages (doc_id, page, item_no, text, box) as words in rows.

    An item joins the first row, in order of the rows' first items, whose height is within the tolerance. A page's rows
    are found in one array of that page.
    """
    shown = items.filter(F.expr(trim("text")) != "")
    pages = shown.groupBy("doc_id", "page").agg(F.expr("array_sort(collect_list(struct(item_no, text, x0, y0, x1, y1)))").alias("items"))
    rows = f"aggregate(items, cast(array() as array<double>), (a, i) -> if(exists(a, y -> abs(y - i.y0) < {tolerance}D), a, concat(a, array(cast(i.y0 as double)))))"
    placed = pages.withColumn("rows", F.expr(rows)).select("doc_id", "page", "rows", F.explode("items").alias("i"))
    placed = placed.withColumn("_y", F.expr(f"get(filter(rows, y -> abs(y - i.y0) < {tolerance}D), 0)")).withColumn("_at", F.expr("array_position(rows, _y)"))
    line = F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("_y", "_at"))
    word = F.row_number().over(Window.partitionBy("doc_id", "page", "_y", "_at").orderBy("i.x0", "i.item_no"))
    return placed.select("doc_id", "page", line.alias("line_no"), word.alias("word_no"), "i.text", *(f"i.{c}" for c in BOX))


def lines(words: DataFrame) -> DataFrame:
    """Lines with their text, union box and words in order."""
    rows = words.groupBy(*LINE).agg(F.expr("array_sort(collect_list(struct(word_no, text, x0, y0, x1, y1)))").alias("words"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    text = f"regexp_replace(array_join(transform(words, w -> w.text), ' '), {quoted(f'[{SPACE}]+')}, ' ')"
    return rows.withColumn("text", F.expr(trim(text))).filter("text <> ''")


def page_text(line_rows: DataFrame) -> DataFrame:
    """A page's lines as one text."""
    return line_rows.groupBy("doc_id", "page").agg(F.expr("array_join(transform(array_sort(collect_list(struct(line_no, text))), l -> l.text), '\\n')").alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Pages under headings, a blank line between them."""
    block = F.expr(trim("concat('[Page ', page, ']\\n', text)"))
    return pages.withColumn("_b", block).groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(page, _b))), p -> p._b), '\\n\\n')").alias("text"))


def ngrams(line_rows: DataFrame, most: int) -> DataFrame:
    """Every run of at most `most` words of a line: first, n, value and each word's span in it with its box."""
    runs = f"flatten(transform(sequence(1, size(words)), i -> transform(sequence(1, least({most}, size(words) - i + 1)), n -> named_struct('first', i, 'n', n, 'run', slice(words, i, n)))))"
    rows = line_rows.select(*LINE, F.explode(F.expr(runs)).alias("g")).select(*LINE, "g.first", "g.n", F.col("g.run").alias("run"))
    spots = """aggregate(run, named_struct('at', 0, 'out', cast(array() as array<struct<from:int,to:int,x0:double,y0:double,x1:double,y1:double>>)),
      (a, w) -> named_struct('at', a.at + length(w.text) + 1, 'out', concat(a.out, array(named_struct('from', a.at, 'to', a.at + length(w.text),
        'x0', cast(w.x0 as double), 'y0', cast(w.y0 as double), 'x1', cast(w.x1 as double), 'y1', cast(w.y1 as double))))), a -> a.out)"""
    return rows.withColumn("value", F.expr("array_join(transform(run, w -> w.text), ' ')")).withColumn("spots", F.expr(spots)).drop("run")


def union_box(spots: str) -> str:
    """Smallest box around boxes."""
    ends = {"x0": "array_min", "y0": "array_min", "x1": "array_max", "y1": "array_max"}
    return "named_struct(" + ", ".join(f"'{c}', {f}(transform({spots}, b -> b.{c}))" for c, f in ends.items()) + ")"


def padded(box: str, by_x: str, by_y: str, width: str = "width", height: str = "height") -> str:
    """A box grown on all sides and cut at the page's edges."""
    cut = lambda v, most: f"least(greatest({v}, 0D), cast({most} as double))"
    return f"named_struct('x0', {cut(f'{box}.x0 - {by_x}', width)}, 'y0', {cut(f'{box}.y0 - {by_y}', height)}, 'x1', {cut(f'{box}.x1 + {by_x}', width)}, 'y1', {cut(f'{box}.y1 + {by_y}', height)})"


def best_boxes(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of findings that agree in keys and box the most confident."""
    order = Window.partitionBy(*keys, "box.x0", "box.y0", "box.x1", "box.y1").orderBy(F.desc("confidence"), "first", "n", "start")
    return findings.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def scan_words(words: DataFrame, pages: DataFrame, options: Options = Options(), kind: str = "pdf") -> DataFrame:
    """Findings of words: each run of a line is scanned, and a finding's span is mapped to the box of the words it meets.

    kind "pdf": runs of 12 words, boxes 2 wider; "image": runs of 10, boxes as they are.
    """
    most, pad = (12, "2D") if kind == "pdf" else (10, None)
    path = F.concat(F.lit("Page "), "page") if kind == "pdf" else F.concat(F.lit("ocr.line_"), "line_no")
    runs = ngrams(lines(words), most).withColumn("kind", F.lit(kind)).withColumn("preview_path", path)
    found = exploded(with_findings(runs.withColumnRenamed("n", "_words"), options)).withColumnRenamed("_words", "_w").withColumn("_met", F.expr("filter(spots, p -> not (stop <= p.from or start >= p.to))")).filter("size(_met) > 0")
    found = found.withColumn("box", F.expr(union_box("_met"))).join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    if pad:
        found = found.withColumn("box", F.expr(padded("box", pad, pad)))
    found = found.withColumn("reasoning", F.concat("reasoning", F.array(F.lit(f"{'pdf' if kind == 'pdf' else 'ocr'}_bbox_map"))))
    keys = ["doc_id", "page", "label", "original"] + (["line_no"] if kind != "pdf" else [])
    return best_boxes(found, keys).select(*LINE, "label", "category", "confidence", "start", "stop", "original", "reasoning", "preview_path", "box")


def _made(rows: DataFrame, label: str, category: str, confidence: float, reason: str, original: str = "text") -> DataFrame:
    return rows.select(*LINE, F.lit(label).alias("label"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(0).alias("start"), F.expr(f"length({original})").alias("stop"), F.expr(original).alias("original"), F.array(F.lit(reason)).alias("reasoning"), F.col("preview_path"), F.col("box"))


def form_heuristics(line_rows: DataFrame, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Name fields, document field rows (image mode document_safe), signature blocks of up to four lines, sign-off names.

    Fixed values: the trigger words, margins and confidences.
    """
    own = "named_struct('x0', cast(x0 as double), 'y0', cast(y0 as double), 'x1', cast(x1 as double), 'y1', cast(y1 as double))"
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    rows = line_rows.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).withColumn("own", F.expr(own)).withColumn("preview_path", F.concat(F.lit("Page "), "page")).withColumn("lower", F.lower("text"))
    word = lambda ws: quoted(f"(?<![A-Za-z0-9_])(?:{ws})(?![A-Za-z0-9_])")
    out = [_made(rows.filter(F.expr("lower rlike " + quoted(r"(?<![A-Za-z0-9_])(?:name|customer name|account holder|applicant name)[" + SPACE + "]*:"))).withColumn("box", F.expr(padded("own", "6D", "6D"))), "PERSON_FIELD", "identity", 0.96, "pdf_form_field_name")]
    if options.image_mode == "document_safe":
        fields = "address|phone|mobile|account|a/c|branch|cif|iban|swift|routing|sort code|beneficiary|holder|customer|date|dated"
        out.append(_made(rows.filter(F.expr("lower rlike " + word(fields))).withColumn("box", F.expr(padded("own", "6D", "6D"))), "DOCUMENT_FIELD_ROW", "pii", 0.95, "pdf_document_field_row"))
    ahead = rows
    for k in (1, 2, 3):
        ahead = ahead.withColumn(f"_n{k}", F.lead(F.struct("text", "lower", "own"), k).over(order))
    stop = "lower rlike " + quoted(r"(?<![A-Za-z0-9_])(?:dated|date)[" + SPACE + "]*:")
    ahead = ahead.filter(F.expr("lower rlike " + word("yours faithfully|yours sincerely|signature|signed by|authorized signatory|account holder signature")))
    ahead = ahead.withColumn("_next", F.expr("filter(array(_n1, _n2, _n3), l -> l is not null)")).withColumn("_end", F.expr(f"array_position(transform(_next, l -> l.{stop}), true)"))
    ahead = ahead.withColumn("_next", F.expr("if(_end > 0, slice(_next, 1, cast(_end - 1 as int)), _next)"))
    block = ahead.withColumn("_u", F.expr(union_box("concat(array(own), transform(_next, l -> l.own))")))
    block = block.withColumn("_sig", F.expr("named_struct('x0', greatest(0D, least(own.x0, width * 0.12D)), 'y0', own.y0, 'x1', least(cast(width as double), greatest(_u.x1, width * 0.78D)), 'y1', least(cast(height as double), _u.y1 + height * 0.03D))"))
    out.append(_made(block.withColumn("box", F.expr(padded("_sig", "6D", "6D"))), "SIGNATURE_BLOCK", "identity", 0.98, "pdf_signature_block", "array_join(concat(array(text), transform(_next, l -> l.text)), ' ')"))
    person = ahead.withColumn("_p", F.expr(f"get(filter(_next, l -> l.text rlike {quoted('^[A-Z][A-Za-z.' + chr(39) + ' -]{3,}' + chr(92) + 'z')}), 0)")).filter("_p is not null")
    out.append(_made(person.withColumn("text", F.col("_p.text")).withColumn("box", F.expr(padded("_p.own", "4D", "4D"))), "PERSON", "identity", 0.93, "pdf_signoff_name"))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return best_boxes(found.withColumn("first", F.col("line_no")).withColumn("n", F.lit(0)), ["doc_id", "page", "label"]).drop("first", "n")


def passport_zones(line_rows: DataFrame, pages: DataFrame, options: Options = Options(), aggressive: bool = False) -> DataFrame:
    """Machine-readable lines in the lowest 36 % of passport-like images, and passport numbers on their right side; when aggressive, all text of the page's body.

    Fixed values: the trigger words, shares of the page, margins and confidences.
    """
    own = "named_struct('x0', cast(x0 as double), 'y0', cast(y0 as double), 'x1', cast(x1 as double), 'y1', cast(y1 as double))"
    of_doc = Window.partitionBy("doc_id", "page")
    rows = line_rows.join(pages.select("doc_id", "page", "width", "height", "name"), ["doc_id", "page"]).withColumn("own", F.expr(own)).withColumn("preview_path", F.concat(F.lit("ocr.line_"), "line_no"))
    rows = rows.withColumn("_like", F.max(F.upper("text").rlike("PASSPORT|PASSEPORT|REISEPASS|TRAVEL DOCUMENT|P<|MRZ") | F.upper(F.coalesce("name", F.lit(""))).rlike("PASSPORT|ID|TRAVEL")).over(of_doc))
    rows = rows.withColumn("_c", F.expr(f"regexp_replace(upper(text), {quoted(f'[{SPACE}]')}, '')"))
    signs, alnum = "length(regexp_replace(_c, '[^<|]', ''))", "length(regexp_replace(_c, '[^A-Z0-9]', ''))"
    mrz = f"(startswith(_c, 'P<') or {signs} >= 2 and {alnum} >= 12 or {alnum} >= 22 and _c rlike '[A-Z]' and _c rlike '[0-9]')"
    number = "upper(text) rlike '(?:^|[^A-Z0-9])[A-Z][0-9]{5,8}(?:[^A-Z0-9]|$)'"
    zone = rows.filter(F.expr(f"_like and (y0 >= height * 0.64D and {mrz} or {number} and x0 >= width * 0.45D)")).withColumn("box", F.expr(padded("own", "12D", "12D")))
    out = _made(zone, "PASSPORT_ZONE", "pii", 0.97, "passport_document_zone")
    if aggressive:
        body = rows.filter("length(regexp_replace(text, '[^A-Za-z0-9]', '')) >= 2 and y0 >= height * 0.15D and y1 <= height * 0.96D").withColumn("box", F.expr(padded("own", "8D", "8D")))
        out = out.unionByName(_made(body, "DOCUMENT_TEXT", "identity", 0.94, "aggressive_document_text"))
    return out


def faces(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings of faces that another tool found (doc_id, page, face_no, box columns), 18 % wider, 8 at least."""
    own = "named_struct('x0', cast(x0 as double), 'y0', cast(y0 as double), 'x1', cast(x1 as double), 'y1', cast(y1 as double))"
    rows = found.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).withColumn("own", F.expr(own))
    rows = rows.withColumn("box", F.expr(padded("own", "greatest(8D, (own.x1 - own.x0) * 0.18D)", "greatest(8D, (own.y1 - own.y0) * 0.18D)"))).withColumn("preview_path", F.concat(F.lit("image.face_"), "face_no")).withColumn("line_no", F.lit(0))
    return _made(rows, "FACE", "identity", 0.98, "face_detector", "'Detected face'").withColumn("stop", F.lit(0))


def portraits(line_rows: DataFrame, pages: DataFrame, faces_found: DataFrame) -> DataFrame:
    """A likely portrait at the left of pages with text at the right and no face."""
    joined = line_rows.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    right = joined.filter("x0 >= width * 0.34D and y0 >= height * 0.18D and y1 <= height * 0.78D").select("doc_id", "page", "width", "height").distinct()
    rows = right.join(faces_found.select("doc_id", "page"), ["doc_id", "page"], "left_anti").withColumn("line_no", F.lit(0)).withColumn("preview_path", F.lit("image.face_fallback"))
    rows = rows.withColumn("box", F.expr("named_struct('x0', width * 0.06D, 'y0', height * 0.24D, 'x1', width * 0.31D, 'y1', height * 0.64D)"))
    return _made(rows, "FACE", "identity", 0.86, "document_portrait_fallback", "'Likely portrait region'").withColumn("stop", F.lit(0))


def manual_boxes(boxes: DataFrame, least: float = 12.0) -> DataFrame:
    """Boxes that a reviewer drew, of a least size, as findings."""
    own = "named_struct('x0', cast(x0 as double), 'y0', cast(y0 as double), 'x1', cast(x1 as double), 'y1', cast(y1 as double))"
    rows = boxes.filter(f"x1 - x0 >= {least} and y1 - y0 >= {least}").withColumn("box", F.expr(own)).withColumn("line_no", F.lit(0)).withColumn("preview_path", F.lit("manual"))
    return _made(rows, "MANUAL_AREA", "identity", 1.0, "manual_box", "'Manual area'").withColumn("stop", F.lit(0))


def image_padding(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes to paint: faces 12 % wider (8 at least), passport zones and document text 10, others 4."""
    rows = findings.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    by = lambda a, b: f"case when label = 'FACE' then greatest(8D, (box.{b} - box.{a}) * 0.12D) when label like 'PASSPORT%' or label = 'DOCUMENT_TEXT' then 10D else 4D end"
    return rows.withColumn("box", F.expr(padded("box", f"({by('x0', 'x1')})", f"({by('y0', 'y1')})"))).drop("width", "height")


def redaction_boxes(findings: DataFrame, least: float = 8.0) -> DataFrame:
    """doc_id, page and box of what is to be blackened, of a least size."""
    return findings.select("doc_id", "page", "label", "box.x0", "box.y0", F.expr(f"greatest(box.x1, box.x0 + {least}D)").alias("x1"), F.expr(f"greatest(box.y1, box.y0 + {least}D)").alias("y1"))
