"""What queries over our own samples must give, row by row, as DuckDB SQL: recorded once and read over against the rules."""

from __future__ import annotations

from .samples import values_clause

KINDS = {"int": "INTEGER", "long": "BIGINT", "text": "VARCHAR", "real": "DOUBLE", "flag": "BOOLEAN"}

#: Query: columns with their kinds, and rows.
ROWS: dict[str, tuple[str, tuple]] = {
    "hinted_values": (
        "doc_id long, label text, start int, stop int, original text, conf_milli int",
        (
            (11, 'STREET_ADDRESS', 0, 10, 'Via Roma 3', 880),
            (12, 'ORG', 0, 12, 'PL1234567890', 680),
            (12, 'US_TAX_ID', 0, 12, 'PL1234567890', 840),
            (12, 'VAT_ID', 0, 12, 'PL1234567890', 960),
            (13, 'DRIVERS_LICENSE', 0, 9, 'CA1234567', 820),
            (13, 'DRIVERS_LICENSE', 0, 9, 'CA1234567', 840),
            (13, 'PASSPORT', 0, 9, 'CA1234567', 760),
            (14, 'PERSON', 0, 8, 'mia berg', 630),
            (14, 'PERSON', 0, 8, 'mia berg', 880),
            (15, 'PLACE', 0, 4, 'oslo', 820),
            (16, 'ORG', 0, 16, 'Nordic Tools Ltd', 800),
            (16, 'PERSON', 0, 16, 'Nordic Tools Ltd', 820),
            (17, 'PERSON', 0, 8, 'mia berg', 630),
            (18, 'SSN', 0, 11, '078-05-1120', 950),
            (2, 'EMAIL', 2, 17, 'ann@lee.example', 990),
            (3, 'IBAN', 0, 27, 'GB82 WEST 1234 5698 7654 33', 880),
            (4, 'DRIVERS_LICENSE', 0, 8, 'L8989023', 840),
            (4, 'ORG', 0, 8, 'L8989023', 680),
            (4, 'PASSPORT', 0, 8, 'L8989023', 860),
            (4, 'PASSPORT', 0, 8, 'L8989023', 880),
            (4, 'US_TAX_ID', 0, 8, 'L8989023', 840),
            (5, 'BIC', 0, 8, 'ABCDUS33', 940),
            (6, 'PHONE', 0, 12, '+47 22 33 44', 840),
            (8, 'CREDIT_CARD', 0, 19, '1234 5678 9012 3456', 580),
            (8, 'PHONE', 0, 14, '1234 5678 9012', 850),
        ),
    ),
    "pipe_rows": (
        "doc_id long, value text, span_start int, span_stop int",
        (
            (1, 'Ann Lee', 9, 16),
            (4, 'Bo Ray Lind', 17, 28),
            (4, 'Mia Berg', 6, 14),
        ),
    ),
    "xlsx_cells": (
        "doc_id long, sheet_index int, row_index int, column_index int, key_hint text, value text",
        (
            (1, 0, 0, 0, 'name', 'Ann Lee'),
            (1, 0, 0, 1, 'email', 'ann@lee.example'),
            (1, 0, 0, 2, 'start', '2024-01-01T00:00:00.000Z'),
            (1, 0, 0, 3, 'column_4', '=B2&"!"'),
            (1, 0, 0, 4, 'true', ''),
            (1, 0, 1, 0, 'name', 'Mia Berg'),
            (1, 0, 1, 1, 'email', 'mia@berg.example'),
            (1, 0, 1, 2, 'start', '2024-02-01T12:00:00.000Z'),
            (1, 0, 1, 3, 'column_4', '=B3&"!"'),
            (1, 0, 1, 4, 'true', ''),
        ),
    ),
    "docx_text": (
        "doc_id long, reading text, value text",
        (
            (2, 'docx', 'Write to bo@lee.example\tsoon\n\none\ntwo'),
            (3, 'rejected', None),
        ),
    ),
    "redact_books": (
        "doc_id long, place text, value text",
        (
            (1, '0 0', 'Ann Lee'),
            (1, '0 1', '[REDACTED]'),
            (1, '0 2', '2024-01-01T00:00:00.000Z'),
            (1, '0 3', '=B2&"!"'),
            (1, '1 0', 'Mia Berg'),
            (1, '1 1', '[REDACTED]'),
            (1, '1 2', '2024-02-01T12:00:00.000Z'),
            (1, '1 3', '=B3&"!"'),
            (2, 'note-redacted.txt', 'Write to [REDACTED]\tsoon\n\none\ntwo'),
        ),
    ),
    "sheet_preview": (
        "doc_id long, sheet_index int, row_index int, cells text, nth int",
        (
            (1, 0, 0, 'Ann Lee|ann@lee.example|2024-01-01T00:00:00.000Z|=B2&"!"|', 1),
        ),
    ),
    "document_cells": (
        "doc_id long, reading text, preferred flag, value text, key_hint text, preview_path text, span_start int",
        (
            (1, 'csv', True, '12 Rue des Lilas', 'home, address', 'row 1.home, address', None),
            (1, 'csv', True, '3 Via Roma', 'home, address', 'row 2.home, address', None),
            (1, 'csv', True, 'Ann Lee', 'name', 'row 1.name', None),
            (1, 'csv', True, 'Mia Berg', 'name', 'row 2.name', None),
            (1, 'csv', True, 'ann@lee.example', 'mail', 'row 1.mail', None),
            (1, 'csv', True, 'mia@berg.example', 'mail', 'row 2.mail', None),
            (2, 'yaml', True, 'ann@lee.example', 'mail', 'yaml.mail', 6),
            (2, 'yaml', True, 'sk-ABCdef0123456789', 'api_key', 'yaml.api_key', 38),
            (3, 'json', True, 'ann lee', 'full_name', 'user.full_name', 23),
            (3, 'json', True, 'ann lee', 'note', 'user.note', 42),
            (4, 'text', True, 'Ann Lee', 'Name', 'row 1.Name', 30),
            (4, 'text', True, 'ann@lee.example', 'Mail', 'row 1.Mail', 40),
            (5, 'csv', False, 'Ann Lee', 'Name', 'row 1.Name', None),
            (5, 'csv', False, 'ann@lee.example', 'Email', 'row 1.Email', None),
        ),
    ),
    "ocr_words": (
        "doc_id int, page int, line_no int, word_no int, text text, x0 real, y0 real, x1 real, y1 real",
        (
            (1, 1, 1, 1, 'Ann', 10.0, 5.0, 40.0, 9.5),
            (1, 1, 2, 1, 'ann@lee.example', 10.0, 12.5, 110.0, 17.5),
            (1, 1, 3, 1, 'ok', 10.0, 22.5, 30.0, 27.0),
            (2, 1, 1, 2, 'cell', 5.0, 0.0, 10.0, 2.5),
        ),
    ),
    "page_rows": (
        "doc_id int, page int, line_no int, word_no int, text text",
        (
            (1, 1, 1, 1, 'left'),
            (1, 1, 1, 2, 'right'),
            (1, 1, 2, 1, 'below'),
            (1, 2, 1, 1, 'second page'),
        ),
    ),
    "page_texts": (
        "doc_id int, text text",
        (
            (1, '[Page 1]\nAnn Lee\nmail ann@lee.example now\nSignature\nMia Berg\nDate:'),
            (2, '[Page 1]\nPASSPORT\nL8989023\nP<UTOERIKSSON<<ANNA'),
        ),
    ),
    "manual_boxes": (
        "doc_id int, page int, line_no int, label text, original text, conf_milli int, x0 real, y0 real, x1 real, y1 real",
        (
            (1, 1, 0, 'MANUAL_AREA', 'Manual area', 1000, 10.0, 10.0, 30.0, 22.0),
            (2, 1, 0, 'MANUAL_AREA', 'Manual area', 1000, 0.0, 0.0, 12.0, 12.0),
        ),
    ),
    "face_boxes": (
        "doc_id int, page int, line_no int, label text, original text, conf_milli int, x0 real, y0 real, x1 real, y1 real",
        (
            (2, 1, 0, 'FACE', 'Detected face', 980, 11.0, 29.200000000000003, 79.0, 110.8),
            (2, 1, 0, 'FACE', 'Detected face', 980, 272.0, 182.0, 300.0, 200.0),
        ),
    ),
    "redaction_boxes": (
        "doc_id int, page int, label text, x0 real, y0 real, x1 real, y1 real",
        (
            (1, 1, 'EMAIL', 48.0, 28.0, 172.0, 42.0),
            (2, 1, 'PASSPORT', 8.0, 168.0, 164.0, 182.0),
        ),
    ),
    "detect_field_hints": (
        "doc_id long, label text, start int, stop int, original text, conf_milli int",
        (
            (-17, 'DRIVERS_LICENSE', 0, 9, 'CA1234567', 820),
            (-17, 'DRIVERS_LICENSE', 0, 9, 'CA1234567', 840),
            (-17, 'PASSPORT', 0, 9, 'CA1234567', 760),
            (-22, 'PLACE', 0, 4, 'Oslo', 820),
            (-23, 'ORG', 0, 16, 'Nordic Tools Ltd', 800),
            (-23, 'PERSON', 0, 16, 'Nordic Tools Ltd', 820),
            (-26, 'EMAIL', 1, 8, 'a@b.com', 990),
            (-26, 'EMAIL', 13, 21, 'xa@b.com', 990),
        ),
    ),
    "scan_document_formats": (
        "doc_id long, finding_id text, reading text, label text, start int, stop int, original text, conf_milli int",
        (
            (1, 'f-0001', 'csv', 'PERSON', 0, 7, 'Ann Lee', 900),
            (1, 'f-0002', 'csv', 'PERSON', 0, 7, 'Ann Lee', 820),
            (1, 'f-0003', 'csv', 'EMAIL', 0, 15, 'ann@lee.example', 990),
            (1, 'f-0004', 'csv', 'ORG', 0, 16, '12 Rue des Lilas', 820),
            (1, 'f-0005', 'csv', 'STREET_ADDRESS', 0, 16, '12 Rue des Lilas', 900),
            (1, 'f-0006', 'csv', 'PERSON', 0, 8, 'Mia Berg', 900),
            (1, 'f-0007', 'csv', 'PERSON', 0, 8, 'Mia Berg', 820),
            (1, 'f-0008', 'csv', 'EMAIL', 0, 16, 'mia@berg.example', 990),
            (1, 'f-0009', 'csv', 'ORG', 0, 10, '3 Via Roma', 820),
            (1, 'f-0010', 'csv', 'STREET_ADDRESS', 0, 10, '3 Via Roma', 900),
            (2, 'f-0001', 'yaml', 'EMAIL', 0, 15, 'ann@lee.example', 990),
            (2, 'f-0002', 'yaml', 'API_KEY', 0, 19, 'sk-ABCdef0123456789', 960),
            (3, 'f-0001', 'json', 'PERSON', 0, 7, 'ann lee', 900),
            (3, 'f-0002', 'json', 'PERSON', 0, 7, 'ann lee', 630),
            (3, 'f-0003', 'json', 'PERSON', 0, 7, 'ann lee', 630),
            (4, 'f-0001', 'text', 'PERSON', 65, 73, 'Mia Berg', 730),
            (4, 'f-0002', 'text', 'PERSON', 30, 37, 'Ann Lee', 900),
            (4, 'f-0003', 'text', 'EMAIL', 40, 55, 'ann@lee.example', 990),
            (5, 'f-0001', 'text', 'PERSON', 11, 18, 'Ann Lee', 780),
            (5, 'f-0002', 'text', 'EMAIL', 19, 34, 'ann@lee.example', 910),
            (6, 'f-0001', 'text', 'EMAIL', 25, 40, 'ann@lee.example', 910),
            (6, 'f-0002', 'text', 'PHONE', 44, 54, '4712345678', 850),
            (6, 'f-0003', 'text', 'PERSON', 9, 16, 'Ann Lee', 800),
        ),
    ),
    "redact_document_formats": (
        "doc_id long, name text, output text, n_replaced long",
        (
            (1, 'people.csv', 'name,mail,"home, address"\n[REDACTED],[REDACTED],[REDACTED]\n[REDACTED],[REDACTED],[REDACTED]\n', 6),
            (2, 'config.yaml', 'mail: [REDACTED] # main\napi_key: [REDACTED]\nbody: |\n  kept@as.is\n', 2),
            (3, 'data.json', '{"user": {"full_name": "[REDACTED]", "note": "[REDACTED]"}, "n": 3}\n', 2),
            (4, 'notes.md', '| Name | Mail |\n| -- | -- |\n| [REDACTED] | [REDACTED] |\n\nName: [REDACTED]\n', 3),
            (5, 'redacted.txt', 'Name,Email\n[REDACTED],[REDACTED]\n', 2),
            (6, 'rows.txt', '| lead | [REDACTED] | CTO | [REDACTED] | +[REDACTED] | - |\n', 3),
            (7, 'book.xls', 'x', 0),
            (8, 'broken.json', '{"a": ', 0),
            (9, 'redacted.txt', '- one\n- two\n', 0),
        ),
    ),
    "scan_word_boxes": (
        "doc_id int, page int, line_no int, label text, original text, conf_milli int, x0 real, y0 real, x1 real, y1 real",
        (
            (1, 1, 1, 'PERSON', 'Ann Lee', 820, 8.0, 8.0, 66.0, 23.0),
            (1, 1, 2, 'EMAIL', 'ann@lee.example', 910, 48.0, 28.0, 172.0, 42.0),
            (1, 1, 4, 'PERSON', 'Mia Berg', 820, 8.0, 78.0, 74.0, 92.0),
            (2, 1, 2, 'PASSPORT', 'L8989023', 860, 158.0, 58.0, 226.0, 72.0),
            (2, 1, 3, 'PASSPORT', 'P<UTOERIKSSON<<ANNA', 900, 8.0, 168.0, 164.0, 182.0),
        ),
    ),
    "form_heuristics": (
        "doc_id int, page int, line_no int, label text, original text, conf_milli int, x0 real, y0 real, x1 real, y1 real",
        (
            (1, 1, 3, 'PERSON', 'Mia Berg', 930, 6.0, 76.0, 76.0, 94.0),
            (1, 1, 3, 'SIGNATURE_BLOCK', 'Signature Mia Berg', 980, 4.0, 54.0, 240.0, 102.0),
            (1, 1, 5, 'DOCUMENT_FIELD_ROW', 'Date:', 950, 4.0, 94.0, 56.0, 116.0),
        ),
    ),
    "image_heuristics": (
        "doc_id int, page int, line_no int, label text, original text, conf_milli int, x0 real, y0 real, x1 real, y1 real",
        (
            (1, 1, 3, 'DOCUMENT_TEXT', 'Signature', 940, 0.0, 42.0, 100.0, 88.0),
            (1, 1, 4, 'DOCUMENT_TEXT', 'Mia Berg', 940, 0.0, 62.0, 90.0, 108.0),
            (1, 1, 5, 'DOCUMENT_TEXT', 'Date:', 940, 0.0, 82.0, 68.0, 128.0),
            (2, 1, 0, 'FACE', 'Likely portrait region', 860, 9.0, 38.4, 102.0, 137.6),
            (2, 1, 2, 'DOCUMENT_TEXT', 'L8989023', 940, 142.0, 42.0, 242.0, 88.0),
            (2, 1, 2, 'PASSPORT_ZONE', 'L8989023', 970, 138.0, 38.0, 246.0, 92.0),
            (2, 1, 3, 'DOCUMENT_TEXT', 'P<UTOERIKSSON<<ANNA', 940, 0.0, 152.0, 180.0, 198.0),
            (2, 1, 3, 'PASSPORT_ZONE', 'P<UTOERIKSSON<<ANNA', 970, 0.0, 148.0, 184.0, 200.0),
        ),
    ),
    "coverage_report": (
        "category text, total long, hit long, rate int",
        (
            ('all', 27, 27, 100),
            ('financial', 5, 5, 100),
            ('identity', 6, 6, 100),
            ('network', 4, 4, 100),
            ('pii', 8, 8, 100),
            ('secrets', 4, 4, 100),
        ),
    ),
    "sniff_samples": (
        "doc_id long, reading text, preferred flag, n_values long",
        (
            (1, 'csv', True, 6),
            (2, 'yaml', True, 2),
            (3, 'json', True, 2),
            (4, 'text', True, 3),
            (5, 'csv', False, 2),
            (5, 'text', True, 1),
            (6, 'text', True, 2),
            (7, 'rejected', True, 1),
            (8, 'rejected', True, 1),
            (9, 'text', True, 1),
        ),
    ),
    "seed_samples": (
        "doc_id long, value_seq long, label text, start int, stop int, original text, conf_milli int",
        (
            (1, 0, 'PERSON', 0, 8, 'Mia Berg', 820),
            (1, 0, 'PERSON', 0, 8, 'Mia Berg', 880),
            (1, 1, 'PERSON', 6, 14, 'm1a berg', 680),
            (1, 2, 'PLACE', 0, 4, 'Oslo', 820),
        ),
    ),
}


def as_sql(columns: str, rows: tuple) -> str:
    """A query that returns the rows."""
    parts = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f"CAST({name} AS {KINDS[kind]}) AS {name}" for name, kind in parts)
    return f"SELECT {casts} FROM {values_clause(rows)} AS t({', '.join(name for name, _ in parts)})"


EXPECTED = {name: as_sql(columns, rows) for name, (columns, rows) in ROWS.items()}
