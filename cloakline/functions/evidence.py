"""What a field's name and its column's values say about a value, as Spark SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

from .patterns import ALIASES, BLOCKED_TOKENS, GENERIC_TOKENS, SPACE, quoted, sql
from .text import is_date, normal, tokens, trim


def strings(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


@dataclass(frozen=True)
class Context:
    """SQL texts of a value's context; a null field says nothing."""

    key_hint: str = "cast(null as string)"
    preview_path: str = "cast(null as string)"
    path: str = "cast(null as array<string>)"
    kind: str = "'text'"
    profile_hints: str = "cast(null as array<string>)"

    def parts(self) -> str:
        return f"filter(concat(array({self.key_hint}, {self.preview_path}), coalesce({self.path}, cast(array() as array<string>)), array({self.kind})), s -> s is not null and s <> '')"

    def segments(self) -> str:
        split = "regexp_replace(s, '([a-z])([A-Z])', '$1 $2')"
        return f"filter(transform({self.parts()}, s -> {normal(split)}), s -> s <> '')"

    def text(self) -> str:
        return f"array_join({self.parts()}, ' ')"


def any_token(segments: str, words) -> str:
    return f"exists({segments}, s -> arrays_overlap(split(s, ' '), {strings(words)}))"


def alias_matched(segments: str, label: str) -> str:
    """An alias stands in the joined segments, or all words of one are words of one segment."""
    joined = f"array_join({segments}, ' ')"
    tests = [f"contains({joined}, '{a}')" for a in ALIASES[label]]
    tests += [f"exists({segments}, s -> forall({strings(a.split())}, t -> array_contains(split(s, ' '), t)))" for a in ALIASES[label] if " " in a]
    return "(" + " or ".join(tests) + ")"


def evidence(segments: str, hints: str, label: str) -> str:
    """Score of a label: 0.18 for its column's values, 0.16 for the field's name, 0.04 for a generic name, at most 0.24."""
    hint = f"if(array_contains(coalesce({hints}, cast(array() as array<string>)), '{label}'), 0.18D, 0D)"
    score = f"least({hint} + if({alias_matched(segments, label)}, 0.16D, 0D) + if({any_token(segments, GENERIC_TOKENS)}, 0.04D, 0D), 0.24D)"
    if label in ("PERSON", "PLACE", "ORG"):
        return f"if({any_token(segments, BLOCKED_TOKENS)}, 0D, {score})"
    return score


def address_shape(value: str) -> str:
    """A trimmed value that reads as a street address: words and a house number near each other."""
    words = f"regexp_extract_all(v, {sql('ADDRESS_TOKEN')}, 0)"
    near = f"""exists(transform(t, (x, i) -> named_struct('x', x, 'i', i)), n -> n.x rlike {sql('HOUSE_NUMBER')}
      and exists(transform(t, (x, i) -> named_struct('x', x, 'i', i)), w -> w.x rlike {sql('STREET_WORD')} and abs(w.i - n.i) <= 5))"""
    test = f"""length(v) between 5 and 160 and v rlike '[0-9]' and v rlike {quoted(chr(92) + 'p{IsLatin}')}
      and not v rlike {sql('NOT_ADDRESS')} and not {is_date('v')} and not v rlike {sql('EMAIL_VALUE')} and not v rlike {sql('PHONE_VALUE')}
      and not v rlike {sql('IPV4_VALUE')} and not v rlike {sql('IPV4_CIDR_VALUE')}
      and exists(array({words}), t -> size(t) between 2 and 10 and size(filter(t, x -> x rlike '[0-9]')) <= 2 and {near})"""
    return f"exists(array({value}), v -> {test})"


def address_confidence(value: str, score: str) -> str:
    """Of a value with the shape of an address."""
    return f"least(0.9D, 0.72D + if({value} rlike {sql('POSTAL_CODE')}, 0.06D, 0D) + {score})"


def shape_labels(value: str) -> str:
    """Labels whose shape a whole value has, in a set order; none for a blank one."""
    is_ = lambda name: f"v rlike {sql(name)}"
    digits = "length(regexp_replace(v, '[^0-9]', ''))"
    tests = [
        ("EMAIL", is_("EMAIL_VALUE")),
        ("PHONE", f"{is_('PHONE_VALUE')} and not {is_date('v')} and {digits} between 7 and 15"),
        ("CREDIT_CARD", is_("CARD_VALUE")),
        # The gates spare long texts a copy without white space; upper case never shortens.
        ("IBAN", f"upper(left(v, 4)) rlike '^[A-Z]{{2}}[0-9]{{2}}' and upper(regexp_replace(v, {quoted(f'[{SPACE}]+')}, ' ')) rlike {sql('IBAN_VALUE')}"),
        ("BIC", f"length(v) <= 11 and upper(v) rlike {sql('BIC_VALUE')}"),
        ("VAT_ID", f"not v rlike {quoted(f'^(?:[{SPACE}.-]*+[^{SPACE}.-]){{15}}')} and upper(regexp_replace(v, {quoted(f'[{SPACE}.-]')}, '')) rlike {sql('VAT_VALUE')}"),
        ("IPV4_CIDR", is_("IPV4_CIDR_VALUE")),
        ("IPV4", is_("IPV4_VALUE")),
        ("IPV6", is_("IPV6_VALUE")),
        ("MAC_ADDRESS", is_("MAC_VALUE")),
        ("VIN", is_("VIN_VALUE")),
        ("PASSPORT", f"{is_('PASSPORT_VALUE')} and v rlike '[A-Z]' and v rlike '[0-9]'"),
        ("DRIVERS_LICENSE", is_("LICENSE_VALUE")),
        ("US_TAX_ID", is_("TAX_VALUE")),
        ("POTENTIAL_SECRET", is_("SECRET_VALUE")),
        ("STREET_ADDRESS", address_shape("v")),
        ("PERSON", f"{is_('PERSON_VALUE')} and v rlike {quoted(f'[{SPACE}]')} and not {is_date('v')}"),
        ("PLACE", f"{is_('PERSON_VALUE')} and not {is_date('v')}"),
        ("ORG", f"{is_('ORG_VALUE')} and v rlike {quoted(chr(92) + 'p{IsLatin}')} and not {is_date('v')}"),
    ]
    found = ", ".join(f"if({test}, '{label}', null)" for label, test in tests)
    return f"flatten(transform(array({trim(value)}), v -> if(v = '', cast(array() as array<string>), filter(array({found}), l -> l is not null))))"


__all__ = ["Context", "address_confidence", "address_shape", "alias_matched", "any_token", "evidence", "shape_labels", "strings", "tokens"]
