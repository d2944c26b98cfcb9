"""Detectors of names, places and organisations, and the spread of confident ones to their variants."""

from __future__ import annotations

from ..functions.evidence import Context, evidence, strings
from ..functions.patterns import COUNTRIES, NON_NAME_TOKENS, SPACE, quoted, sql
from ..functions.text import labelled as labelled_spans
from ..functions.text import lines, matches, same_tokens, spaces, tokens, trim
from ..plans.options import Options
from .structured import NONE, each, finding, matched, when

SEEDS = "array<struct<label:string,tokens:array<string>>>"
TRIED = "array<struct<start:int,stop:int,original:string,tokens:array<string>,label:string>>"
NO_SEEDS = f"cast(array() as {SEEDS})"
END = chr(92) + "z"


def labelled(v: str, context: Context) -> str:
    """A name after a label such as "Customer:", if the label hints at a person."""
    hint = Context("x.hint", context.preview_path, context.path, context.kind, context.profile_hints)
    cut = f"transform({labelled_spans(v)}, m -> named_struct('m', m, 'name', regexp_extract(m.original, {sql('LABELLED')}, 1)))"
    label = f"substring(x.m.original, 1, instr(x.m.original, x.name) - 1)"
    hinted = f"transform(filter({cut}, x -> x.name <> ''), x -> named_struct('start', x.m.start + instr(x.m.original, x.name) - 1, 'stop', x.m.start + instr(x.m.original, x.name) - 1 + length(x.name), 'original', x.name, 'hint', {trim(f'regexp_replace({label}, {quoted(f'[:=-][{SPACE}]*' + END)}, {chr(39) * 2})')}))"
    kept = f"filter({hinted}, x -> {evidence(hint.segments(), hint.profile_hints, 'PERSON')} > 0)"
    return each(kept, finding("PERSON", 31, "0.73", "'labelled_identity_pattern'"))


def field_hint(v: str, options: Options) -> str:
    """The whole value of a field that hints at a person, or else a place, or else an organisation."""
    tries = [("PERSON", "PERSON_VALUE", 0.9, 0.72, "name"), ("PLACE", "PERSON_VALUE", 0.84, 0.66, "place"), ("ORG", "ORG_VALUE", 0.84, 0.64, "org")]
    latin = quoted(chr(92) + "p{IsLatin}|" + chr(92) + "p{M}|[0-9]")
    cases = " ".join(
        f"when {matched(label)} and t rlike {sql(shape)} and t rlike {latin} then array({finding(label, 32, f'least({cap}D, {base}D + _ev_{label})', chr(39) + 'field_hint:' + why + chr(39), start='0', stop=f'length({v})', original=v)})"
        for label, shape, cap, base, why in tries
        if options.on(label)
    )
    return f"if(coalesce(key_hint, '') = '', {NONE}, flatten(transform(array({trim(v)}), t -> case when t = '' then {NONE} {cases} else {NONE} end)))"


def contact_lines(v: str) -> str:
    """Names before, and a country with its city after, the email of a comma-separated line."""
    cut = f"transform(filter({lines(v)}, l -> instr(l.original, ',') > 0 and instr(l.original, '@') > 0), l -> named_struct('l', l, 'parts', filter(transform(split(l.original, ','), p -> {trim('p')}), p -> p <> '')))"
    mail = f"transform(filter({cut}, x -> size(x.parts) between 2 and 6), x -> named_struct('l', x.l, 'parts', x.parts, 'mail', array_position(transform(x.parts, p -> p rlike {sql('EMAIL_LOOSE')}), true)))"
    country = f"""transform(filter({mail}, x -> x.mail > 0), x -> named_struct('l', x.l, 'parts', x.parts, 'mail', x.mail,
      'country', array_position(transform(x.parts, (p, i) -> i + 1 > x.mail and array_contains({strings(COUNTRIES)}, lower(p))), true)))"""
    place = f"""transform({country}, x -> named_struct('l', x.l, 'mail', x.mail, 'n', size(x.parts), 'country', x.country,
      'city', if(x.country > x.mail + 1 and element_at(x.parts, cast(greatest(x.country - 1, 1) as int)) rlike {sql('PLACE_NAME')}, x.country - 1, 0L),
      'at', aggregate(x.parts, named_struct('from', 1, 'out', cast(array() as array<struct<p:string,at:int>>)),
        (a, p) -> named_struct('from', if(locate(lower(p), lower(x.l.original), a.from) > 0, locate(lower(p), lower(x.l.original), a.from) + length(p), a.from),
          'out', concat(a.out, array(named_struct('p', p, 'at', locate(lower(p), lower(x.l.original), a.from))))), a -> a.out)))"""
    kinds = f"""case when q.at = 0 then '' when q.i < x.mail and q.p rlike {sql('NAME')} then 'PERSON'
      when q.i > x.mail and (q.i = x.country or q.i = x.city) and q.p rlike {sql('PLACE_NAME')} then 'PLACE' else '' end"""
    spans = f"""flatten(transform({place}, x -> transform(transform(x.at, (q, i) -> named_struct('p', q.p, 'at', q.at, 'i', i + 1)),
      q -> named_struct('start', x.l.start + q.at - 1, 'stop', x.l.start + q.at - 1 + length(q.p), 'original', q.p, 'kind', {kinds}, 'n', x.n))))"""
    person = finding("PERSON", 33, "if(m.n = 2, 0.78D, 0.74D)", "'contact_line_name'")
    where = finding("PLACE", 33, "0.72D", "'contact_line_place'")
    return when(f"instr({v}, ',') > 0 and instr({v}, '@') > 0", f"transform(filter({spans}, m -> m.kind <> ''), m -> if(m.kind = 'PERSON', {person}, {where}))")


def name_like_lines(v: str) -> str:
    """Lines whose words may be names: start, t, raw (words), alone (the line is one name)."""
    trimmed = f"transform({lines(v)}, l -> named_struct('l', l, 't', {trim('l.original')}))"
    gate = f"x.t <> '' and not x.t rlike '[,@0-9]' and not x.t rlike {sql('NOT_A_NAME')} and not array_contains({strings(COUNTRIES)}, lower(x.t)) and not arrays_overlap({spaces('lower(x.t)')}, {strings(NON_NAME_TOKENS)})"
    return f"transform(filter({trimmed}, x -> {gate}), x -> named_struct('start', x.l.start + instr(x.l.original, x.t) - 1, 't', x.t, 'raw', {spaces('x.t')}, 'alone', x.t rlike {sql('NAME')}))"


#: Lines of two to ten names of two words each, and those names.
OF_NAMES = "size(x.raw) between 4 and 20 and size(x.raw) % 2 = 0"
PAIRS = "transform(sequence(0, size(x.raw) - 1, 2), i -> lower(concat_ws(' ', slice(x.raw, i + 1, 2))))"


def pairs_asked(v: str) -> str:
    """Names of two words in lines of names: what such a line wants to know from elsewhere."""
    return f"array_distinct(flatten(transform(filter({name_like_lines(v)}, x -> not x.alone and {OF_NAMES}), x -> {PAIRS})))"


def name_lines(v: str, seeds: str) -> str:
    """Lines that are a name, and lines of names next to each other of which each is known from elsewhere or repeated."""
    kept = name_like_lines(v)
    known = f"""array_union(transform(filter({seeds}, s -> s.label = 'PERSON' and size(s.tokens) = 2), s -> array_join(s.tokens, ' ')),
      transform(filter(c, x -> x.alone and size(x.raw) = 2), x -> lower(concat_ws(' ', x.raw))))"""
    adjacent = f"{OF_NAMES} and exists(array({PAIRS}), ps -> forall(ps, p -> array_contains(k, p) or size(filter(ps, o -> o = p)) > 1))"
    words = matches("x.t", quoted(f"[^{SPACE}]+"))
    spans = f"""flatten(transform(c, x -> case
      when x.alone then array(named_struct('start', x.start, 'stop', x.start + length(x.t), 'original', x.t))
      when {adjacent} then flatten(transform(array({words}), w -> transform(sequence(0, size(w) - 1, 2), i -> named_struct(
        'start', x.start + w[i].start, 'stop', x.start + w[i + 1].stop, 'original', substring(x.t, w[i].start + 1, w[i + 1].stop - w[i].start)))))
      else cast(array() as array<struct<start:int,stop:int,original:string>>) end))"""
    proper = f"forall({spaces('m.original')}, w -> w rlike {sql('PROPER_TOKEN')})"
    made = each("n", finding("PERSON", 34, f"greatest(if(size(n) >= 2, 0.84D, 0.63D), if({proper}, 0.82D, 0.63D))", "'standalone_name_line'"))
    return f"flatten(transform(array({kept}), c -> flatten(transform(array({known}), k -> flatten(transform(array({spans}), n -> {made}))))))"


def seeds_of(findings: str) -> str:
    """Confident names, places and organisations: distinct by label and normal words, the first ones first."""
    wanted = f"filter({findings}, f -> f.label in ('PERSON', 'PLACE', 'ORG') and f.confidence >= 0.72D)"
    return f"array_distinct(filter(transform({wanted}, f -> named_struct('label', f.label, 'tokens', {tokens('f.original')})), s -> size(s.tokens) > 0))"


def labelled_candidates(v: str, seeds: str) -> str:
    """Runs of one to three words, with the label of the first seed that they equal, or nearly, or null."""
    spans = f"transform({matches(v, sql('CANDIDATE'))}, m -> named_struct('m', m, 'tokens', {tokens('m.original')}))"
    return f"transform({spans}, x -> named_struct('start', x.m.start, 'stop', x.m.stop, 'original', x.m.original, 'tokens', x.tokens, 'label', get(filter({seeds}, s -> {same_tokens('s.tokens', 'x.tokens')}), 0).label))"


def seed_findings(candidates: str, findings: str) -> str:
    """Findings of labelled candidates that none of that label covers already."""
    kept = f"filter({candidates}, m -> m.label is not null and not exists({findings}, f -> f.label = m.label and f.start = m.start and f.stop = m.stop))"
    made = finding("PERSON", 35, "0.68", "'identity_seed_match'").replace("'label', 'PERSON'", "'label', m.label")
    return f"transform({kept}, m -> {made})"


def spread(v: str, findings: str, seeds: str) -> str:
    """Runs of one to three words that equal a seed, or nearly: the first seed that fits decides; what that label covers already is left."""
    return f"if(size({seeds}) = 0, {NONE}, {seed_findings(labelled_candidates(v, seeds), findings)})"
