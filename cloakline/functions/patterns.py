"""Regular expressions and word lists of the detectors.

Patterns are written once in a dialect both engines share; java() turns the ASCII word boundary into look-arounds (in
Java it is Unicode-aware) and names the Latin script as Java does.
"""

from __future__ import annotations

# The shapes that findings must have for results to agree.
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
VAT_SHAPES = (
    r"ATU\d{8}", r"BE0?\d{9}", r"DE\d{9}", r"DK\d{8}", r"ES[A-Z0-9]\d{7}[A-Z0-9]", r"FI\d{8}", r"FR[A-Z0-9]{2}\d{9}",
    r"GB(?:\d{9}|\d{12}|GD\d{3}|HA\d{3})", r"IE\d[A-Z0-9]\d{5}[A-Z]", r"IT\d{11}", r"NL\d{9}B\d{2}", r"NO\d{9}MVA", r"PL\d{10}", r"PT\d{9}", r"SE\d{12}",
)
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,63}\b",
    "EMAIL_LOOSE": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}\b",
    "API_KEY": r"\bsk-[A-Za-z0-9]{8,}\b",
    "AWS_ACCESS_KEY": r"\bAKIA[0-9A-Z]{16}\b",
    "JWT": r"\beyJ[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+\b",
    "UUID": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
    "IPV4_CIDR": rf"\b(?:{OCTET}\.){{3}}{OCTET}/(?:[0-9]|[12][0-9]|3[0-2])\b",
    "IPV4": rf"\b(?:{OCTET}\.){{3}}{OCTET}\b",
    "IPV6": r"(?i)\b(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "US_TAX_ID": r"\b9\d{2}-?(?:7\d|8[0-8]|9[0-2])-\d{4}\b",
    "IBAN": r"(?i)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b",
    "VAT_ID": rf"(?i)\b(?:{'|'.join(VAT_SHAPES)})\b",
    "MAC_ADDRESS": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "URL": r"https?://[^\s`|<>)]+",
    "SECRET": r"\b[A-Za-z0-9_\-]{24,}\b",
    "PHONE": r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)\d{3,4}[\s.-]?\d{3,4}\b",
    "VIN": r"\b[A-HJ-NPR-Z0-9]{17}\b",
    "PASSPORT": r"\b[A-Z0-9]{6,9}\b",
    "PASSPORT_NUMBER": r"\b[A-Z][0-9]{6,8}\b",
    "MRZ_LINE": r"\bP<[A-Z<]{10,}|\b[A-Z0-9<]{20,}\b",
    "DRIVERS_LICENSE": r"\b[A-Z]{1,2}\d{6,8}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "BIC": r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "BIC_COUNTRY": r"\b[A-Z]{4}(?:FI|SE|NO|DE|FR|GB|ES)[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "DATE": r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})\b",
    "API_PATH": r"(?i)/(?:api|events|hooks|webhook|v\d+)/",
    "POSTAL_CODE": r"(?i)\b(?:[A-Z]{1,2}[-\s]?)?\d{3,6}(?:[-\s]\d{2,4})?\b",
    "NOT_ADDRESS": r"(?i)\b(?:iban|bic|swift|vat|version|build|invoice|order|project|issue|ticket|room|page|section|chapter|row|column)\b",
    "ADDRESS_TOKEN": r"[\p{Latin}\p{M}0-9.'\x{2019}/-]+",
    "HOUSE_NUMBER": r"^\d{1,6}[A-Za-z]?(?:[-/]\d+[A-Za-z]?)?$",
    "STREET_WORD": r"^\p{Latin}[\p{Latin}\p{M}.'\x{2019}-]{1,}$",
    # Whole values.
    "EMAIL_VALUE": r"^[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,63}$",
    "PHONE_VALUE": r"^[+\d(][\d\s().-]{6,}$",
    "CARD_VALUE": r"^(?:\d[ -]*?){13,19}$",
    "IBAN_VALUE": r"^[A-Z]{2}\d{2}[A-Z0-9](?: ?[A-Z0-9]){10,30}$",
    "BIC_VALUE": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$",
    "VAT_VALUE": rf"^(?:{'|'.join(VAT_SHAPES)})$",
    "IPV4_VALUE": rf"^(?:{OCTET}\.){{3}}{OCTET}$",
    "IPV4_CIDR_VALUE": rf"^(?:{OCTET}\.){{3}}{OCTET}/(?:[0-9]|[12][0-9]|3[0-2])$",
    "IPV6_VALUE": r"(?i)^(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}$",
    "MAC_VALUE": r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$",
    "VIN_VALUE": r"^[A-HJ-NPR-Z0-9]{17}$",
    "SECRET_VALUE": r"^[A-Za-z0-9_\-]{24,}$",
    "PASSPORT_VALUE": r"^[A-Z0-9-]{6,12}$",
    "LICENSE_VALUE": r"^[A-Z0-9-]{6,16}$",
    "TAX_VALUE": r"^[A-Z0-9-]{8,15}$",
    "PERSON_VALUE": r"^[\p{Latin}\p{M}][\p{Latin}\p{M} ,.'\x{2019}-]{1,60}$",
    "ORG_VALUE": r"^[\p{Latin}\p{M}0-9][\p{Latin}\p{M}0-9 &.,'\x{2019}-]{2,80}$",
    # Names and places.
    "LABELLED": r"(?iu)\b[\p{Latin}\p{M}][\p{Latin}\p{M}0-9 _./'-]{1,40}\s*[:=-]\s*([\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]+(?:[ \t]+[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]+){1,3})",
    "NAME": r"^[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]{1,}(?:\s+[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]{1,}){1,2}$",
    "PLACE_NAME": r"^[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]{1,}(?:\s+[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]{1,}){0,2}$",
    "LONG_NAME": r"^[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]+(?:\s+[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}-]+){1,3}$",
    "PROPER_TOKEN": r"^\p{Lu}[\p{Ll}\p{M}.'\x{2019}-]+$",
    "CANDIDATE": r"\b[\p{Latin}\p{M}0-9@$][\p{Latin}\p{M}0-9@$.'\x{2019}-]{1,}(?:\s+[\p{Latin}\p{M}0-9@$][\p{Latin}\p{M}0-9@$.'\x{2019}-]{1,}){0,2}\b",
    "NOT_A_NAME": r"(?i)^(?:project manager|manager|owner|service owner|customer primary|customer secondary|incident response|runbook|rollback|support team|security team|engineering team)$",
    "PIPE_ROLE": r"(?i)^(?:CTO|IT|CEO|CFO|COO|Project Manager|Manager|Owner|Service Owner|Customer primary|Customer secondary)$",
    "DELIMITER_ROW": r"^\s*\|?\s*:?-{2,}:?",
}
# The token in an API URL, with what may stand before and after it.
URL_TOKEN, TOKEN_BEFORE, TOKEN_AFTER = r"[A-Za-z0-9_-]{32,}", r"[/?#&=:-]", r"[/?#&.=:-]"

# Words of field names by label.
ALIASES = {
    "EMAIL": ("email", "e mail", "mail"),
    "PHONE": ("phone", "telephone", "tel", "mobile", "cell", "fax", "contact number"),
    "SSN": ("ssn", "social security"),
    "US_TAX_ID": ("tax id", "tin", "itin", "ein", "vat"),
    "VAT_ID": ("vat", "vat id", "tax id", "mva", "tva", "cif", "nif", "nie", "ust idnr"),
    "IBAN": ("iban", "account", "bank account"),
    "BIC": ("bic", "swift", "swift code"),
    "PASSPORT": ("passport", "passport number"),
    "DRIVERS_LICENSE": ("driver license", "drivers license", "licence", "license number"),
    "VIN": ("vin", "vehicle identification", "vehicle id"),
    "MAC_ADDRESS": ("mac", "mac address"),
    "CREDIT_CARD": ("card", "credit card", "debit card", "payment", "cc", "pan"),
    "PERSON": ("name", "full name", "first name", "last name", "contact", "author", "person", "customer", "client", "employee", "user", "owner", "recipient"),
    "PLACE": ("city", "town", "location", "country", "region", "place"),
    "ORG": ("company", "organisation", "organization", "employer", "business", "tenant", "org"),
    "STREET_ADDRESS": ("address", "addr", "street", "route"),
    "POTENTIAL_SECRET": ("secret", "token", "key", "credential", "password", "api key"),
}
# Field words that hint at any label, and those that rule names, places and organisations out.
GENERIC_TOKENS = ("id", "identifier", "number", "num", "no", "nr", "code", "value")
BLOCKED_TOKENS = (
    "alert", "capability", "change", "channel", "component", "definition", "description", "environment", "escalate", "field", "frequency", "impact", "method",
    "mitigation", "note", "notes", "purpose", "retention", "risk", "role", "severity", "status", "system", "title", "trigger", "type", "use", "version",
)
# Words of lines that are no names.
NON_NAME_TOKENS = (
    "and", "or", "the", "for", "with", "from", "into", "onto", "over", "under", "project", "manager", "service", "owner", "customer", "primary", "secondary",
    "incident", "response", "rollback", "support", "security", "engineering", "team", "test", "sample", "internal", "external", "local", "browser",
)
# Country names that contact lines may end in.
COUNTRIES = tuple(
    "afghanistan,albania,algeria,andorra,angola,argentina,armenia,australia,austria,azerbaijan,bahamas,bahrain,bangladesh,belarus,belgium,belize,bolivia,bosnia and herzegovina,botswana,brazil,bulgaria,cambodia,cameroon,canada,chile,china,colombia,costa rica,croatia,cyprus,czech republic,denmark,dominican republic,ecuador,egypt,el salvador,estonia,ethiopia,finland,france,georgia,germany,ghana,greece,guatemala,honduras,hong kong,hungary,iceland,india,indonesia,iran,iraq,ireland,israel,italy,jamaica,japan,jordan,kazakhstan,kenya,kuwait,latvia,lebanon,lithuania,luxembourg,malaysia,mexico,moldova,mongolia,morocco,netherlands,new zealand,nigeria,norway,pakistan,panama,peru,philippines,poland,portugal,qatar,romania,russia,saudi arabia,serbia,singapore,slovakia,slovenia,south africa,south korea,spain,sri lanka,sweden,switzerland,taiwan,thailand,tunisia,turkey,ukraine,united arab emirates,united kingdom,uk,united states,usa,uruguay,venezuela,vietnam".split(",")
)
# Headers of Markdown columns that describe rather than name.
DESCRIPTOR_HEADERS = (
    "alert", "alert family", "capability", "channel", "component", "date", "definition", "dr field", "environment", "escalate after", "escalate when", "field",
    "frequency", "impact", "method", "minimum role", "mitigation", "ongoing updates", "ops scope", "owner", "primary component", "purpose", "required ops action",
    "retention", "risk", "role", "severity", "system", "trigger", "type", "use", "version", "workflow",
)
# The category of each label; others are "other".
CATEGORIES = {
    "secrets": ("API_KEY", "AWS_ACCESS_KEY", "JWT", "POTENTIAL_SECRET"),
    "network": ("IPV4", "IPV4_CIDR", "IPV6", "MAC_ADDRESS"),
    "financial": ("BIC", "CREDIT_CARD", "IBAN", "US_TAX_ID", "VAT_ID"),
    "identity": ("PERSON", "PLACE", "ORG", "STREET_ADDRESS", "FACE", "DOCUMENT_TEXT"),
    "pii": ("PHONE", "EMAIL", "SSN", "PASSPORT", "PASSPORT_ZONE", "DRIVERS_LICENSE", "VIN", "UUID"),
}
CATEGORY_OF = {label: category for category, labels in CATEGORIES.items() for label in labels}
#: Labels of which one value of a shape is enough to mark its column.
PRECISE_SHAPES = ("EMAIL", "PHONE", "CREDIT_CARD", "IPV4", "IPV4_CIDR", "IPV6", "MAC_ADDRESS", "VIN", "STREET_ADDRESS")

#: In Java \w is one test; [A-Za-z0-9_] asks its ranges one after the other.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: White space as a Unicode-aware engine has it: JavaScript's \s and trim().
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: What may stand before an address's @; code 1 is a dot that another dot follows (text.emails).
LOCAL, LOCAL_SIGN = r"[A-Za-z0-9._%+\-\x{1}]", r"[.%+\-\x{1}]"
#: Patterns with the same matches for an engine that backtracks: Java's stack grows with each turn of a repeated group, and a start that
#: fails is tried again at each later place of its run. A run is met once here, from its start or where the match before it ended.
_RUN_TO_AT = rf"(?:(?<!{LOCAL}){LOCAL_SIGN}*+[A-Za-z0-9_]{LOCAL}*+|\G(?<=[A-Za-z0-9_]){LOCAL}++)@"
JAVA = {
    "EMAIL": _RUN_TO_AT + r"[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,63}\b",
    "EMAIL_LOOSE": _RUN_TO_AT + r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}\b",
    "JWT": r"(?<![0-9A-Za-z_-])(?>[0-9A-Za-z_-]*?\beyJ)[0-9A-Za-z_-]++\.[0-9A-Za-z_-]++\.[0-9A-Za-z_-]+\b",
    "EMAIL_VALUE": r"^[A-Za-z0-9._%+\-]++@(?![^@]*\.\.)[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,63}$",
}

#: What of a token's run stands before the token; its first one is the only one that can match.
JWT_LEAD = r"^[0-9A-Za-z_-]*?(?=\beyJ)"
#: A hyphen inside a run of name characters that no second word follows: no label ends there (text.labelled).
_RUN = r"[\p{Latin}\p{M}.'\x{2019}-]"
LONG_RUN = rf"{_RUN}{{500}}"
DEAD_HYPHEN = rf"(?:\G(?<={_RUN})|(?<!{_RUN})(?={_RUN}++(?![ \t]+[\p{{Latin}}\p{{M}}]{_RUN})))([\p{{Latin}}\p{{M}}.'\x{{2019}}]*+)-(?={_RUN})"
LABELLED_MARKED = PATTERNS["LABELLED"].replace("_./'-]", r"_./'\x{1}-]").replace(r"\x{2019}-]+){1,3}", r"\x{2019}\x{1}-]+){1,3}")
#: The end of a label, white space and a name: each match of a label and a name ends in one, or a hyphen in one's name ends its label; then up to
#: four words behind it belong to the match. A label's characters reach back LABEL_REACH at most (with the one in front of it), behind white space.
LABEL_END = "[:=-](?iu)" + LABELLED_MARKED.partition("[:=-]")[2].replace("(", "(?:", 1)
_WORD = r"[\p{Latin}\p{M}][\p{Latin}\p{M}.'\x{2019}\x{1}-]+"
WORDS_AFTER = rf"(?iu)^\s*+(?:{_WORD}(?:[ \t]+{_WORD}){{0,3}})?"
LABEL_REACH = 42
#: What stands for text that no label starts in (text.labelled): it is part of no label and of no name.
FILLER = ","
LABELLED_MARKED = LABELLED_MARKED.replace("(?iu)", f"(?iu)(?!{FILLER})", 1)
#: White space as characters of an SQL literal.
SPACE_CHARS = "".join(f"\\u{c:04X}" for c in (9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


#: What a match begins with, tried before its word boundary: a boundary takes four looks around at each place of a text, nearly all of them in vain.
LEADS = {
    "IPV4_CIDR": r"\d", "IPV4": r"\d", "IPV6": r"[A-F0-9]{1,4}:", "SSN": r"\d", "US_TAX_ID": "9", "UUID": r"[0-9a-f]{8}-", "IBAN": r"[A-Z]{2}\d", "VAT_ID": r"[A-Z]{2}[A-Z0-9]{0,2}\d", "MAC_ADDRESS": r"[0-9A-Fa-f]{2}[:-]",
    "SECRET": r"[\w-]{24}", "PHONE": r"[+(\d]", "VIN": r"[A-HJ-NPR-Z0-9]{17}", "PASSPORT": r"[A-Z0-9]{6}", "PASSPORT_NUMBER": r"[A-Z]\d", "MRZ_LINE": r"[A-Z0-9<]{12}", "DRIVERS_LICENSE": "[A-Z]", "CREDIT_CARD": r"\d", "BIC": "[A-Z]{6}", "DATE": r"\d",
}


def led(name: str) -> str:
    """A pattern with its lead."""
    p = JAVA.get(name, PATTERNS.get(name, name))
    if name not in LEADS:
        return p
    flags = "(?i)" if p.startswith("(?i)") else ""
    rest = p.removeprefix(flags)
    return f"{flags}(?={LEADS[name]}){f'(?:{rest})' if '|' in rest else rest}"


def java(name: str) -> str:
    """A pattern for Java: ASCII word boundaries, absolute ends, Unicode white space."""
    p = led(name).replace(r"\b", BOUNDARY).replace(r"\p{Latin}", r"\p{IsLatin}")
    p = p.replace(r"[^\s", f"[^{SPACE}").replace(r"[\d\s", rf"[\d{SPACE}").replace(r"[\s", f"[{SPACE}").replace(r"[-\s", f"[-{SPACE}").replace(r"\s", f"[{SPACE}]")
    return p[:-1] + r"\z" if p.endswith("$") else p


def quoted(pattern: str) -> str:
    """A raw SQL literal."""
    return f'r"{pattern}"'


def sql(name: str) -> str:
    """A pattern as a raw SQL literal."""
    return quoted(java(name))


def re2(name: str) -> str:
    """A pattern for RE2, as an SQL literal."""
    return "'" + PATTERNS.get(name, name).replace("'", "''") + "'"
