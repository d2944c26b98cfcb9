"""Detectors of structured identifiers, as one array expression for each.

A finding is a struct whose first fields sort it: start, back (minus stop), label, milli (confidence in thousandths) and
seq (its detector's place). Detection is a narrow map: nothing is shuffled.
"""

from __future__ import annotations

from ..functions.evidence import Context, address_confidence, address_shape
from ..functions.patterns import CATEGORY_OF, SPACE, TOKEN_AFTER, TOKEN_BEFORE, URL_TOKEN, quoted, sql
from ..functions.text import emails, is_date, iban_ok, jwts, lines, luhn_ok, matches, trim
from ..plans.options import Options

FINDING = "struct<start:int,back:int,label:string,milli:int,seq:int,stop:int,confidence:double,original:string,category:string,reasoning:array<string>>"
NONE = f"cast(array() as array<{FINDING}>)"


def finding(label: str, seq: int, confidence: str, reasoning: str, x: str = "m", start: str | None = None, stop: str | None = None, original: str | None = None) -> str:
    """A finding from a span."""
    start, stop, original = start or f"{x}.start", stop or f"{x}.stop", original or f"{x}.original"
    return (
        f"named_struct('start', cast({start} as int), 'back', cast(-({stop}) as int), 'label', '{label}', 'milli', cast(round({confidence} * 1000) as int), 'seq', {seq}, "
        f"'stop', cast({stop} as int), 'confidence', cast({confidence} as double), 'original', {original}, 'category', '{CATEGORY_OF.get(label, 'other')}', 'reasoning', array({reasoning}))"
    )


def each(spans: str, made: str, keep: str | None = None) -> str:
    """Findings of spans m that pass."""
    return f"transform({f'filter({spans}, m -> {keep})' if keep else spans}, m -> {made})"


def when(gate: str | None, findings: str) -> str:
    return f"if({gate}, {findings}, {NONE})" if gate else findings


#: Labels whose detectors ask for evidence.
EVIDENCE = ("EMAIL", "PHONE", "US_TAX_ID", "PASSPORT", "DRIVERS_LICENSE", "VIN", "MAC_ADDRESS", "IBAN", "VAT_ID", "POTENTIAL_SECRET", "STREET_ADDRESS", "BIC", "PERSON", "PLACE", "ORG")


def with_evidence(confidence: float | str, label: str, ceiling: float = 0.99) -> str:
    """Base plus the label's score, up to a ceiling. Scores are the columns _ev_<label>."""
    return f"least({ceiling}D, {confidence}{'D' if isinstance(confidence, float) else ''} + _ev_{label})"


def matched(label: str) -> str:
    return f"_ev_{label} > 0"


def ibans(v: str) -> str:
    """Spans shaped like an IBAN whose check holds, or in a field that hints at one."""
    return when(f"{v} rlike '[0-9]{{2}}(?<=[A-Za-z]{{2}}[0-9]{{2}})'", f"filter(transform({matches(v, sql('IBAN'))}, m -> named_struct('start', m.start, 'stop', m.stop, 'original', m.original, 'ok', {iban_ok('m.original')})), m -> m.ok or {matched('IBAN')})").replace(NONE, "cast(array() as array<struct<start:int,stop:int,original:string,ok:boolean>>)")


NO_IBAN_AROUND = "not exists(_ibans, b -> m.start >= b.start and m.stop <= b.stop)"
DIGITS = "length(regexp_replace(m.original, '[^0-9]', ''))"


def url_tokens(v: str) -> str:
    """The first long token of each URL with an API path."""
    before = quoted(f"^(.*?(?:^|{TOKEN_BEFORE})){URL_TOKEN}(?=\\z|{TOKEN_AFTER})")
    token = quoted(f"^(?:.*?(?:^|{TOKEN_BEFORE}))({URL_TOKEN})(?=\\z|{TOKEN_AFTER})")
    spans = f"""transform(filter({matches(v, sql('URL'))}, m -> m.original rlike {sql('API_PATH')}),
      m -> named_struct('start', m.start + length(regexp_extract(m.original, {before}, 1)), 'original', regexp_extract(m.original, {token}, 1)))"""
    return f"filter(transform({spans}, m -> named_struct('start', m.start, 'stop', m.start + length(m.original), 'original', m.original)), m -> m.original <> '')"


def address_spans(v: str) -> str:
    """A span for each line that holds an address: what follows its first colon, or else the whole line."""
    part = lambda x: trim(x)
    tries = f"filter(if(instr(l.original, ':') > 0, array({part('substring(l.original, instr(l.original, chr(58)) + 1)')}, {part('l.original')}), array({part('l.original')})), p -> {address_shape('p')})"
    found = f"transform(filter({lines(v)}, l -> l.original rlike '[0-9]'), l -> named_struct('l', l, 'p', {tries}))"
    return f"""transform(filter({found}, x -> size(x.p) > 0), x -> named_struct(
      'start', x.l.start + instr(x.l.original, x.p[0]) - 1, 'stop', x.l.start + instr(x.l.original, x.p[0]) - 1 + length(x.p[0]), 'original', x.p[0]))"""


def field_hint(v: str, options: Options) -> str:
    """The whole value of a hinted field; the first shape that fits decides."""
    t = trim(v)
    tries = [
        ("EMAIL", matched("EMAIL") + f" and t rlike {sql('EMAIL_VALUE')}", "0.99", "email"),
        ("PHONE", matched("PHONE") + f" and t rlike {sql('PHONE_VALUE')}", "0.84", "phone"),
        ("US_TAX_ID", matched("US_TAX_ID") + f" and t rlike {sql('TAX_VALUE')}", "0.84", "tax_id"),
        ("PASSPORT", matched("PASSPORT") + f" and t rlike {sql('PASSPORT_VALUE')}", "0.86", "passport"),
        ("DRIVERS_LICENSE", matched("DRIVERS_LICENSE") + f" and t rlike {sql('LICENSE_VALUE')}", "0.82", "drivers_license"),
        ("VIN", matched("VIN") + f" and t rlike {sql('VIN_VALUE')}", "0.9", "vin"),
        ("MAC_ADDRESS", matched("MAC_ADDRESS") + f" and t rlike {sql('MAC_VALUE')}", "0.92", "mac"),
        ("STREET_ADDRESS", address_shape("t"), address_confidence("t", "_ev_STREET_ADDRESS"), "address_shape"),
    ]
    whole = lambda label, conf, why: f"array({finding(label, 25, conf, quoted_text('field_hint:' + why), start='0', stop=f'length({v})', original=v)})"
    cases = " ".join(f"when {test} then {whole(label, conf, why)}" for label, test, conf, why in tries if options.on(label))
    return f"if(coalesce(key_hint, '') = '', {NONE}, flatten(transform(array({t}), t -> case when t = '' then {NONE} {cases} else {NONE} end)))"


def quoted_text(x: str) -> str:
    return f"'{x}'"


def detectors(v: str, options: Options) -> dict[str, str]:
    """Array expressions by name, in order. They read columns _ev_<label>, _ibans, _card_context and key_hint."""
    pattern = "'pattern_match'"
    plain = lambda label, seq, conf, gate=None: when(gate, each(matches(v, sql(label)), finding(label, seq, conf, pattern)))
    base = 0.91 if options.strict_email else 0.82
    strict, loose = (each(emails(v, p), finding("EMAIL", 1, with_evidence(base, "EMAIL"), pattern)) for p in ("EMAIL", "EMAIL_LOOSE"))
    letters = "length(regexp_replace(m.original, '[^A-Z]', ''))"
    out = {
        "EMAIL": when(f"instr({v}, '@') > 0", f"if({matched('EMAIL')}, {loose}, {strict})" if options.strict_email else loose),
        "API_KEY": plain("API_KEY", 2, "0.96", f"instr({v}, 'sk-') > 0"),
        "AWS_ACCESS_KEY": plain("AWS_ACCESS_KEY", 3, "0.95", f"instr({v}, 'AKIA') > 0"),
        "JWT": when(f"instr({v}, 'eyJ') > 0", each(jwts(v), finding("JWT", 4, "0.92", pattern))),
        "UUID": plain("UUID", 5, "0.87", f"{v} rlike '-[1-5][0-9a-fA-F]{{3}}-'"),
        "IPV4_CIDR": plain("IPV4_CIDR", 6, "0.94", f"{v} rlike '[.][0-9]{{1,3}}/[0-9]'"),
        "IPV4": plain("IPV4", 7, "0.82", f"{v} rlike '[0-9][.][0-9]{{1,3}}[.][0-9]'"),
        "IPV6": plain("IPV6", 8, "0.82", f"{v} rlike '[0-9a-fA-F]:[0-9a-fA-F]{{1,4}}:[0-9a-fA-F]'"),
        "SSN": plain("SSN", 9, "0.95", f"{v} rlike '[0-9]-[0-9]{{2}}-[0-9]'"),
        "US_TAX_ID": plain("US_TAX_ID", 10, "0.9", f"{v} rlike '[0-9]{{2}}-[0-9]{{4}}'"),
        "IBAN": each("_ibans", finding("IBAN", 11, f"if(m.ok, {with_evidence(0.96, 'IBAN')}, {with_evidence(0.72, 'IBAN')})", "if(m.ok, 'iban_checksum', 'iban_shape+context')")),
        "VAT_ID": when(f"{v} rlike '[0-9]{{3}}'", each(matches(v, sql("VAT_ID")), finding("VAT_ID", 12, with_evidence(0.86, "VAT_ID", 0.96), "'vat_id_shape'"))),
        "MAC_ADDRESS": plain("MAC_ADDRESS", 13, "0.92", f"{v} rlike '[:-][0-9A-Fa-f]{{2}}[:-]'"),
        "URL_SECRET": when(f"instr({v}, '://') > 0", each(url_tokens(v), finding("POTENTIAL_SECRET", 14, "0.88", "'api_url_token'"))),
        "POTENTIAL_SECRET": when(f"{v} rlike {quoted('[' + chr(92) + 'w-]{24}')}", each(matches(v, sql("SECRET")), finding("POTENTIAL_SECRET", 15, with_evidence(0.66, "POTENTIAL_SECRET", 0.9), pattern))),
        "STREET_ADDRESS": when(f"{v} rlike '[0-9]'", each(address_spans(v), finding("STREET_ADDRESS", 16, address_confidence("m.original", "_ev_STREET_ADDRESS"), "'address_shape'"))),
        "PHONE": when(
            f"{v} rlike {quoted(f'[0-9]{{3}}[{SPACE}.-]?[0-9]{{3}}')}",
            each(
                matches(v, sql("PHONE")),
                finding("PHONE", 17, f"if({DIGITS} >= 10, {with_evidence(0.85, 'PHONE')}, {with_evidence(0.72, 'PHONE')})", f"if({matched('PHONE')}, 'phone_pattern+context', 'phone_pattern')"),
                f"{DIGITS} between 7 and 15 and not {is_date('m.original')} and {NO_IBAN_AROUND}",
            ),
        ),
        "VIN": when(f"{v} rlike '[A-Z0-9]{{17}}'", each(matches(v, sql("VIN")), finding("VIN", 18, "0.9", "'vin_pattern'"))),
        "PASSPORT": when(
            f"{v} rlike '[0-9]' and {v} rlike '[A-Z0-9]{{6}}'",
            each(
                matches(v, sql("PASSPORT")),
                finding("PASSPORT", 19, f"if({matched('PASSPORT')}, 0.88D, 0.76D)", f"if({matched('PASSPORT')}, 'field_hint:passport', 'passport_pattern')"),
                f"{matched('PASSPORT')} and {DIGITS} >= 4 or {letters} >= 1 and {DIGITS} >= 5",
            ),
        ),
        "PASSPORT_NUMBER": when(f"{v} rlike '[A-Z][0-9]{{6}}'", each(matches(v, sql("PASSPORT_NUMBER")), finding("PASSPORT", 20, "0.86", "'mrz_passport_pattern'"))),
        "MRZ_LINE": when(f"{v} rlike '[A-Z0-9<]{{12}}'", each(matches(v, sql("MRZ_LINE")), finding("PASSPORT", 21, "0.9", "'mrz_line_pattern'"))),
        "DRIVERS_LICENSE": when(matched("DRIVERS_LICENSE"), each(matches(v, sql("DRIVERS_LICENSE")), finding("DRIVERS_LICENSE", 22, "0.84", "'field_hint:drivers_license'"))),
        "CREDIT_CARD": when(
            f"{v} rlike '(?:[0-9][ -]*+){{13}}'",
            each(
                matches(v, sql("CREDIT_CARD")),
                finding("CREDIT_CARD", 23, f"case when {luhn_ok('m.original')} then 0.9D when _card_context then least(0.8D, 0.58D + 0.14D) else 0.58D end", f"case when {luhn_ok('m.original')} then 'luhn_pass' when _card_context then 'luhn_soft_match+context' else 'luhn_soft_match' end"),
                NO_IBAN_AROUND,
            ),
        ),
        "BIC": when(
            f"{v} rlike '[A-Z]{{6}}'",
            each(matches(v, sql("BIC")), finding("BIC", 24, with_evidence(0.78, "BIC", 0.94), f"if({matched('BIC')}, 'bic_shape+context', 'bic_shape')"), f"({matched('BIC')} or m.original rlike {sql('BIC_COUNTRY')})"),
        ),
    }
    named = {"URL_SECRET": "POTENTIAL_SECRET", "PASSPORT_NUMBER": "PASSPORT", "MRZ_LINE": "PASSPORT"}
    kept = {name: e for name, e in out.items() if options.on(named.get(name, name))}
    kept["FIELD_HINT"] = field_hint(v, options)
    return kept


def card_context(context: Context) -> str:
    """The field's path ends in a word for cards."""
    return f"{context.text()} rlike {quoted('(?i)(?:^|[_' + chr(92) + '-. ])(?:card|credit card|debit card|payment|cc|pan)' + chr(92) + 'z')}"


__all__ = ["EVIDENCE", "FINDING", "NONE", "SPACE", "card_context", "detectors", "each", "field_hint", "finding", "ibans", "matched", "when", "with_evidence"]
