"""Scalar functions as Spark SQL expressions over strings. Each takes and returns SQL text, so they nest in lambdas."""

from __future__ import annotations

import unicodedata

from .patterns import DEAD_HYPHEN, FILLER, JWT_LEAD, LABEL_END, LABEL_REACH, LABELLED_MARKED, LOCAL_SIGN, LONG_RUN, SPACE, SPACE_CHARS, WORDS_AFTER, quoted, sql

SPANS = "array<struct<start:int,stop:int,original:string>>"


#: Matches whose offsets are summed in one piece.
RUN = 256


def matches(value: str, pattern: str) -> str:
    """All matches of a pattern (an SQL literal) with code-point offsets: array of (start, stop, original).

    What lies between the matches, and the matches, alternate; one pass over both gives the offsets. Appending to an array
    copies it, so matches are taken in runs: a text of a million matches copies each a few hundred times, not a million.
    """
    both = f"zip_with(regexp_extract_all({value}, {pattern}, 0), split({value}, {pattern}, -1), (m, g) -> named_struct('m', m, 'g', g))"
    step = """if(x.m is null, c, named_struct('at', c.at + length(x.g) + length(x.m),
      'out', concat(c.out, array(named_struct('start', c.at + length(x.g), 'stop', c.at + length(x.g) + length(x.m), 'original', x.m)))))"""
    run = f"aggregate(slice(z, b * {RUN} + 1, {RUN}), named_struct('at', a.at, 'out', cast(array() as {SPANS})), (c, x) -> {step})"
    return f"""get(transform(array({both}), z -> flatten(aggregate(sequence(0, (size(z) - 1) div {RUN}), named_struct('at', 0, 'out', cast(array() as array<{SPANS}>)),
      (a, b) -> get(transform(array({run}), k -> named_struct('at', k.at, 'out', concat(a.out, array(k.out)))), 0), a -> a.out))), 0)"""


def emails(value: str, pattern: str) -> str:
    """Spans of addresses, in time linear in the text. The pattern has no repeated group for labels: in the strict form, a dot that another dot
    follows is code 1 before matching, so that no domain holds an empty label; a match that isn't where the one before it ended has the signs at its
    run's start with it, which aren't the address's."""
    strict = pattern == "EMAIL"
    code1, code2 = "chr(1)", "chr(2)"
    marked = f"translate({value}, {code1}, {code2})"
    marked = f"if(instr({value}, '..') > 0, regexp_replace({marked}, {quoted(chr(92) + '.(?=' + chr(92) + '.)')}, {code1}), {marked})" if strict else marked
    signs = f"length(regexp_extract(m.original, {quoted('^' + LOCAL_SIGN + '*')}, 0))"
    led = f"if(i > 0 and get(ms, i - 1).stop = m.start, 0, {signs})"
    found = f"transform(ms, (m, i) -> get(transform(array({led}), k -> named_struct('start', m.start + k, 'stop', m.stop, 'original', translate(substring(m.original, k + 1), {code1}, '.'))), 0))"
    return f"get(transform(array({matches('v', sql(pattern))}), ms -> {found}), 0)".join(("get(transform(array(" + marked + "), v -> ", "), 0)"))


def jwts(value: str) -> str:
    """Spans of signed tokens; the pattern starts where the token's run does."""
    lead = f"length(regexp_extract(m.original, {sql(JWT_LEAD)}, 0))"
    return f"transform({matches(value, sql('JWT'))}, m -> get(transform(array({lead}), k -> named_struct('start', m.start + k, 'stop', m.stop, 'original', substring(m.original, k + 1))), 0))"


def labelled(value: str) -> str:
    """Spans of a label and a name. Where a run of name characters is long, hyphens in it that no name can follow are code 1 while matching: else
    each place of the run would be tried before each of its hyphens.

    The pattern tries some 80 characters at each place where a label might start, so text that no label's end follows within its reach is blank for it:
    ends of labels, which are few, are found first, and what lies farther between them is filled up to its length."""
    code1, code2 = "chr(1)", "chr(2)"
    marked = f"if({value} rlike '[^ ]{{500}}' and {value} rlike {sql(LONG_RUN)}, regexp_replace(translate({value}, {code1}, {code2}), {sql(DEAD_HYPHEN)}, concat('$1', {code1})), translate({value}, {code1}, {code2}))"
    head = f"length(regexp_extract(g, {sql(WORDS_AFTER)}, 0))"
    tail = f"{LABEL_REACH} + length(g) - length(trim(trailing '{SPACE_CHARS}' from g))"
    filled = f"get(transform(array(struct({head} as h, {tail} as t)), k -> if(k.h + k.t < length(g), concat(left(g, k.h), repeat('{FILLER}', length(g) - k.h - k.t), right(g, k.t)), g)), 0)"
    near = f"if(size(ends) = 0, '', array_join(zip_with(split(u, {sql(LABEL_END)}, -1), ends, (g, e) -> concat({filled}, coalesce(e, ''))), ''))"
    near = f"get(transform(array({marked}), u -> get(transform(array(regexp_extract_all(u, {sql(LABEL_END)}, 0)), ends -> {near}), 0)), 0)"
    return f"transform({matches('v', sql(LABELLED_MARKED))}, m -> named_struct('start', m.start, 'stop', m.stop, 'original', translate(m.original, {code1}, '-')))".join(("get(transform(array(" + near + "), v -> ", "), 0)"))


def trim(value: str) -> str:
    """Without white space (Unicode's too) at the ends."""
    return f"trim(both '{SPACE_CHARS}' from {value})"


def lines(value: str) -> str:
    """Lines that aren't empty, without carriage returns at their ends, with true offsets."""
    return f"transform({matches(value, quoted('[^' + chr(92) + 'n]+'))}, x -> named_struct('start', x.start, 'stop', x.stop, 'original', if(endswith(x.original, chr(13)), left(x.original, length(x.original) - 1), x.original)))"


def spaces(value: str) -> str:
    """Tokens between white space."""
    return f"split({value}, {quoted(f'[{SPACE}]+')}, -1)"


def luhn_ok(value: str) -> str:
    return f"luhn_check(regexp_replace({value}, '[^0-9]', ''))"


def iban_ok(value: str) -> str:
    """Mod-97 check: letters count as two digits, the first four characters go last."""
    compact = f"upper(regexp_replace({value}, {quoted(f'[{SPACE}]')}, ''))"
    digits = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    return f"""({compact} rlike {quoted('^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}' + chr(92) + 'z')} and aggregate(
      split({digits}, ''), 0,
      (r, c) -> if(c rlike '[A-Z]', (r * 100 + ascii(c) - 55) % 97, (r * 10 + ascii(c) - 48) % 97)) = 1)"""


def accents() -> tuple[str, str]:
    """Characters that decompose to one ASCII letter or digit and marks, and those letters and digits."""
    found = []
    for c in map(chr, range(128, 0x10000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            found.append((c, bare))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


ACCENTED, BARE = accents()
#: Digits and signs that stand for letters: fixed values.
LEET_FROM, LEET_TO = "01345678@$", "oieasgtbas"


def normal(value: str) -> str:
    """Lower-case ASCII words: marks stripped, look-alike digits and signs as letters, all else one space."""
    bare = f"lower(translate(regexp_replace({value}, {quoted('[' + chr(92) + 'x{300}-' + chr(92) + 'x{36F}]')}, ''), '{ACCENTED}', '{BARE}'))"
    return f"trim(regexp_replace(translate({bare}, '{LEET_FROM}', '{LEET_TO}'), '[^a-z0-9]+', ' '))"


def tokens(value: str) -> str:
    """Words of the normal form; none for an empty one."""
    return f"filter(split({normal(value)}, ' '), t -> t <> '')"


def same_tokens(left: str, right: str) -> str:
    """As many tokens, each equal or, from four letters on, within one edit. The first tokens are compared alone before arrays are walked."""
    near = "p = q or length(p) >= 4 and length(q) >= 4 and abs(length(p) - length(q)) <= 1 and levenshtein(p, q, 1) >= 0"
    first = near.replace("(p)", "(_p)").replace("(q)", "(_q)").replace("p = q", "_p = _q").replace("(p, q, 1)", "(_p, _q, 1)").replace("_p", f"get({left}, 0)").replace("_q", f"get({right}, 0)")
    return f"(size({left}) > 0 and size({left}) = size({right}) and ({first}) and (size({left}) = 1 or forall(zip_with({left}, {right}, (p, q) -> {near}), e -> e)))"


def units(value: str) -> str:
    """UTF-16 code units."""
    return f"flatten(transform(split({value}, ''), c -> if(ascii(c) > 65535, array(cast(55296 + ((ascii(c) - 65536) div 1024) as bigint), cast(56320 + ((ascii(c) - 65536) % 1024) as bigint)), array(cast(ascii(c) as bigint)))))"


def fnv1a(value: str) -> str:
    """32-bit FNV-1a over UTF-16 code units."""
    return f"aggregate(if({value} = '', cast(array() as array<bigint>), {units(value)}), 2166136261L, (h, c) -> ((h ^ c) * 16777619L) & 4294967295L)"


def token36(seed: str, length: int) -> str:
    """Letters and digits from a linear congruential generator, in base 36."""
    return f"""substring(aggregate(sequence(1, {length}), named_struct('at', cast({seed} as bigint) & 4294967295L, 'out', ''),
      (a, i) -> named_struct('at', (a.at * 1664525L + 1013904223L) & 4294967295L, 'out',
        concat(a.out, lower(conv(cast((a.at * 1664525L + 1013904223L) & 4294967295L as string), 10, 36)))),
      a -> a.out), 1, {length})"""


def pseudonym(label: str, original: str) -> str:
    """A stand-in that depends on label and original alone. Its formats by label."""
    seed = "seed"
    digits = lambda x: f"substring(cast({x} % 10000 + 1000 as string), 1, 4)"
    by_label = f"""case {label}
      when 'EMAIL' then concat('user+', {token36(seed, 10)}, '@example.test')
      when 'IPV4' then concat('198.51.100.', {seed} % 253 + 1)
      when 'IPV4_CIDR' then concat('198.51.100.0/', least(32, greatest(8, if(coalesce(try_cast(get(split({original}, '/'), 1) as int), 0) = 0, 24, try_cast(get(split({original}, '/'), 1) as int)))))
      when 'IPV6' then concat('2001:db8::', lower(hex({seed} % 65535)))
      when 'UUID' then concat_ws('-', {token36(seed, 8)}, {token36(seed + ' + 1', 4)}, {token36(seed + ' + 2', 4)}, {token36(seed + ' + 3', 4)}, {token36(seed + ' + 4', 12)})
      when 'PERSON' then concat('Person_', {token36(seed, 8)})
      when 'PLACE' then concat('Place_', {token36(seed, 6)})
      when 'ORG' then concat('Org_', {token36(seed, 7)})
      when 'CREDIT_CARD' then concat('4111 1111 ', {digits(seed)}, ' ', {digits(f'shiftrightunsigned({seed}, 2)')})
      else concat('redact-', {token36(seed, 16)}) end"""
    return f"transform(array({fnv1a(f'concat({label}, {chr(39)}:{chr(39)}, {original})')}), seed -> {by_label})[0]"


def replacement(label: str, original: str, mode: str) -> str:
    """What takes a finding's place: a mark, or in any other mode than "redact" a stand-in."""
    return "'[REDACTED]'" if mode == "redact" else pseudonym(label, original)


def line_ending(value: str) -> str:
    return f"case when instr({value}, '\\r\\n') > 0 then '\\r\\n' when instr({value}, '\\r') > 0 then '\\r' else '\\n' end"


def header(value: str) -> str:
    """Trimmed, lower case, white space as one space."""
    return f"regexp_replace(lower({trim(value)}), {quoted(f'[{SPACE}]+')}, ' ')"


def is_date(value: str) -> str:
    return f"({value} rlike {sql('DATE')})"
