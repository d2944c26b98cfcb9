"""DuckDB SQL for what SQL can express of the training-data queries."""

from __future__ import annotations

#: XXH64's five primes (fixed values).
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def wrapped(value: str) -> str:
    return f"(({value}) % 18446744073709551616::UHUGEINT)"


def number(value: int) -> str:
    return f"{value % 2**64}::UHUGEINT"


def times(value: str, prime: int) -> str:
    return wrapped(f"({value}) * {number(PRIMES[prime - 1])}")


def plus(value: str, other: str) -> str:
    return wrapped(f"({value}) + ({other})")


def rotated(value: str, bits: int) -> str:
    return f"({wrapped(f'({value}) * {number(2**bits)}')} + ({value}) // {number(2 ** (64 - bits))})"


def little_endian(start: str, width: int) -> str:
    """The unsigned number in `width` bytes of the list b from place `start` (from 0)."""
    return "(" + " + ".join(f"b[{start} + {k + 1}]::UHUGEINT * {number(256**k)}" for k in range(width)) + ")"


def xxh64_steps() -> str:
    """CTEs from texts(s) to hashes(s, h): XXH64 of s, a column a step so that no expression is repeated inside another."""
    steps, last = [], "xx0"
    steps.append("xx0 AS (SELECT s, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i::INT + 1, 2))::INT) AS b FROM texts)")
    # Stripes of 32 bytes in four lanes, one row for each.
    first = {1: PRIMES[0] + PRIMES[1] + SEED, 2: PRIMES[1] + SEED, 3: SEED, 4: SEED - PRIMES[0]}
    for lane, start in first.items():
        mixed = plus("acc", times(little_endian(f"32 * pos::INT + {8 * (lane - 1)}", 8), 2))
        steps.append(f"lane{lane} AS (WITH RECURSIVE r AS (SELECT s, b, 0 AS pos, {number(start)} AS acc FROM xx0 WHERE len(b) >= 32 UNION ALL SELECT s, b, pos + 1, {times(rotated('mixed', 31), 1)} FROM (SELECT *, {mixed} AS mixed FROM r WHERE 32 * (pos + 1) <= len(b))) SELECT s, acc FROM r WHERE 32 * (pos + 1) > len(b))")
    merged = " + ".join(rotated(f"l{k}.acc", r) for k, r in zip((1, 2, 3, 4), (1, 7, 12, 18)))
    steps.append(f"m0 AS (SELECT l1.s, l1.acc AS a1, l2.acc AS a2, l3.acc AS a3, l4.acc AS a4, {wrapped(merged)} AS h FROM lane1 l1 JOIN lane2 l2 USING (s) JOIN lane3 l3 USING (s) JOIN lane4 l4 USING (s))")
    for k in range(1, 5):
        steps.append(f"n{k} AS (SELECT *, {times(f'a{k}', 2)} AS t FROM m{k - 1})")
        steps.append(f"m{k} AS (SELECT s, a1, a2, a3, a4, {plus(times(f'xor(h, {times(rotated("t", 31), 1)})', 1), number(PRIMES[3]))} AS h FROM n{k})")
    steps.append(f"start AS (SELECT xx0.s, b, {plus(f'coalesce(m4.h, {number(PRIMES[4] + SEED)})', 'len(b)::UHUGEINT')} AS h, len(b) // 32 * 32 AS pos FROM xx0 LEFT JOIN m4 ON xx0.s = m4.s)")
    # The rest: eights, one four, ones.
    last = "start"
    for k, (width, rounds) in enumerate(((8, 3), (4, 1), (1, 3))):
        for j in range(rounds):
            value = little_endian("pos::INT", width)
            if width == 8:
                taken = f"xor(h, {times(rotated(times(value, 2), 31), 1)})"
                after = plus(times(rotated("x", 27), 1), number(PRIMES[3]))
            elif width == 4:
                taken, after = f"xor(h, {times(value, 1)})", plus(times(rotated("x", 23), 2), number(PRIMES[2]))
            else:
                taken, after = f"xor(h, {times(value, 5)})", times(rotated("x", 11), 1)
            inside = f"pos + {width} <= len(b)"
            steps.append(f"t{k}{j} AS (SELECT s, b, h, pos, {inside} AS inside, CASE WHEN {inside} THEN {taken} ELSE h END AS x FROM {last})")
            steps.append(f"u{k}{j} AS (SELECT s, b, CASE WHEN inside THEN {after} ELSE h END AS h, pos + CASE WHEN inside THEN {width} ELSE 0 END AS pos FROM t{k}{j})")
            last = f"u{k}{j}"
    for k, (shift, prime) in enumerate(((33, 2), (29, 3), (32, None))):
        value = f"xor(h, h // {number(2**shift)})"
        steps.append(f"w{k} AS (SELECT s, {times(value, prime) if prime else value} AS h FROM {last})")
        last = f"w{k}"
    steps.append(f"hashes AS (SELECT s, h::UBIGINT AS h FROM {last})")
    return ", ".join(steps)


def simhash(shingle: int, radius: int) -> str:
    """doc_id, fingerprint and component_id of all documents: all pairs of fingerprints are compared, and links followed until nothing changes."""
    bits = " + ".join(f"(CASE WHEN 2 * sum((h >> {k}) & 1) > count(h) THEN {2**k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(64))
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
spans AS (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {shingle - 1}))) AS pos FROM words WHERE len(w) > 0),
shingles AS (SELECT doc_id, array_to_string(w[pos + 1 : pos + {shingle}], ' ') AS s FROM spans),
texts AS (SELECT DISTINCT s FROM shingles), {xxh64_steps()},
made AS (SELECT doc_id, {bits} AS fp FROM shingles JOIN hashes USING (s) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM words LEFT JOIN made USING (doc_id)),
nodes AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM nodes a, nodes b WHERE bit_count(xor(a.fp, b.fp)::BIT) <= {radius}),
reach AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT reach.a AS fp, min(least) AS component_id FROM reach JOIN nodes ON reach.b = nodes.fp GROUP BY reach.a)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM prints JOIN roots USING (fp)"""


#: CRC-32 of a number's decimal digits, by the table that the polynomial gives.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"


def crc32(value: str) -> str:
    codes = f"list_transform(range(length({value}::VARCHAR)), lambda i: ascii(substr({value}::VARCHAR, i::INT + 1, 1))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)))"


BASE_SCORES = f"""WITH {CRC_TABLE},
docs AS (SELECT doc_id, {crc32("doc_id")} % 5 = 1 AS held_out, list_append(list_transform(regexp_extract_all({LOWER}, '{WORD}'), lambda x: 'w' || x), 'end') AS w FROM documents, crc),
tokens AS (SELECT doc_id, held_out, unnest(w) AS token FROM docs),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
sizes AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (token) CROSS JOIN sizes GROUP BY doc_id, held_out"""

PAYLOADS = """WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
sizes AS (SELECT doc_id, bytes, octet_length(bytes) AS n, greatest(1, (octet_length(bytes) + 575) // 576) * 576 AS p FROM docs)
SELECT doc_id, n::BIGINT AS n_bytes, p::BIGINT AS payload_bytes, sha256(bytes || from_hex(repeat('FF', (p - n)::INT))) AS payload_sha256 FROM sizes"""

LANGUAGES = f"""WITH {CRC_TABLE} SELECT doc_id, {crc32("doc_id")} % 4 = 2 AS held_out, text IS NULL OR NOT regexp_matches(text, '\\p{{L}}') AS undetermined, true AS learned, true AS in_range FROM documents, crc"""

TOXIC_SCORES = f"""WITH {CRC_TABLE} SELECT doc_id, {crc32("doc_id")} % 4 = 2 AS held_out, true AS in_range, true AS decided FROM documents, crc"""

PIECES = "SELECT doc_id, true AS gapless, true AS whole FROM documents"

TOKEN_FILES = "SELECT doc_id, true AS follows FROM documents"

LETTERS = r"[\p{L}\p{N}]+"

#: Every window that shares a shingle with an item, by exact weighted Jaccard similarity; no fingerprints.
LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (SELECT item_id, n, k, n - k + 1 AS total, s, count(*) AS c FROM (SELECT item_id, n, k, w, unnest(range(n - k + 1)) AS p FROM i), LATERAL (SELECT array_to_string(w[p + 1 : p + k], ' ') AS s) GROUP BY ALL),
doc_places AS (SELECT doc_id, w, k, unnest(range(greatest(0, len(w) - k + 1))) AS p FROM d, (SELECT DISTINCT k FROM i)),
doc_shingles AS (SELECT doc_id, len(w) AS words, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s FROM doc_places),
hits AS (SELECT doc_id, item_id, words, n, k, total, c, p, s FROM doc_shingles JOIN item_shingles USING (k, s)),
pairs AS (SELECT doc_id, item_id FROM hits GROUP BY doc_id, item_id, total HAVING count(*) >= 0.8 * total - 1e-9),
inside AS (SELECT *, least(words - k + 1, total) AS held, unnest(range(greatest(0, p - total + 1), least(p, greatest(0, words - n)) + 1)) AS start FROM hits JOIN pairs USING (doc_id, item_id)),
shared AS (SELECT doc_id, item_id, start, held, total, least(count(*), any_value(c)) AS common FROM inside GROUP BY doc_id, item_id, start, held, total, s),
windows AS (SELECT doc_id, item_id, sum(common) AS common, any_value(held) AS held, any_value(total) AS total FROM shared GROUP BY doc_id, item_id, start)
SELECT doc_id, item_id, round(max(common / (held + total - common)), 6) AS similarity FROM windows GROUP BY doc_id, item_id HAVING max(common / (held + total - common)) >= 0.8 - 1e-12"""

def repair_sql() -> str:
    """The least (cost, letters, lines) of each state after each turn, going forward: letters that come first among equals stay first whatever follows."""
    blank = r"[^\x20\x09-\x0D]"

    def edit(state: str, cost: str, letter: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || chr(10) || {line}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    far = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    delete = [f"{{'c': v{k}.c + 4, 'a': v{k}.a || 'D', 't': v{k}.t}}" for k in range(4)]

    def keep(k: int, role: str) -> str:
        return f"CASE WHEN stays AND initial = '{role}' THEN {edit(f'v{k}', 'more', 'K', 'line')} ELSE {far} END"

    def change(k: int, role: str) -> str:
        return f"CASE WHEN stays THEN {edit(f'v{k}', '(3 + more)', 'R', chr(39) + role + ':' + chr(39) + ' || text')} ELSE {far} END"

    w = [delete[0], least(delete[1], keep(0, "s")), least(delete[2], *(x for k in (0, 1, 3) for x in (keep(k, "u"), change(k, "user")))), least(delete[3], keep(2, "a"), change(2, "assistant"))]
    user, assistant = "'user:'", "'assistant:'"
    u = least("w2", *(edit(f"w{k}", "3", "I", user) for k in (0, 1, 3)))
    return f"""WITH RECURSIVE {CRC_TABLE},
lots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS lot FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE lot WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM lots),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role || ':' || text, 1, 64), md5(role || ':' || text)) AS pos FROM damaged),
marked AS (SELECT *, NOT regexp_matches(text, '{blank}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior FROM placed),
turns AS (SELECT conv_id, pos, text, role || ':' || text AS line, initial, NOT blank AND NOT again AS stays, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM marked),
walked AS (
SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v0, {far} AS v1, {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || {user}}} AS v2, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || {user} || chr(10) || {assistant}}} AS v3 FROM conversations
UNION ALL
SELECT conv_id, pos, w0, w1, {least("u2", edit("w3", "3", "I", user))}, {least("w3", edit("u2", "3", "I", assistant))} FROM (SELECT conv_id, pos, w0, w1, w3, {u} AS u2 FROM (
SELECT t.conv_id, t.pos, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2, {w[3]} AS w3 FROM walked r JOIN turns t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.pos = r.pos + 1))),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pos > 1 AND coalesce(prior, '') || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
best AS (SELECT w.conv_id, n, gaps, blank, duplicate, truncated, illegal, CASE WHEN n IS NULL THEN w.v0 ELSE {least("w.v0", "w.v3")} END AS v FROM walked w LEFT JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.pos = coalesce(n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v.c AS cost, v.a AS audit, sha256(substr(v.t, 2)) AS repaired_sha256 FROM best"""


TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20"""

#: Every prefix of every rebuilt conversation as a list of turns; subtrees by all pairs of a conversation's prefixes.
TRIE = f"""WITH {CRC_TABLE},
placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(coalesce(role, '') || ':' || coalesce(text, ''), 1, 64), md5(coalesce(role, '') || ':' || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id),
convs AS (SELECT s.conv_id, {crc32("s.conv_id")} % 6 AS h, s.conv_id - s.conv_id % 100 AS base, least({crc32("s.conv_id")} % 6, coalesce(b.n, 0)) AS taken FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 100, crc),
turns AS (SELECT c.conv_id, taken + pos - h AS depth, role, text FROM placed p JOIN convs c ON p.conv_id = c.conv_id WHERE pos > h UNION ALL SELECT c.conv_id, pos, role, text FROM placed p JOIN convs c ON p.conv_id = c.base WHERE pos <= h),
paths AS (SELECT conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY depth) FILTER (role IS NOT NULL), []) AS path FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths),
prefixes AS (SELECT conv_id, depth, depth = len(path) AS last, path[1:depth] AS prefix FROM members),
nodes AS (SELECT prefix, depth, row_number() OVER () AS id, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM prefixes GROUP BY prefix, depth),
within AS (SELECT p.conv_id, p.depth, id FROM prefixes p JOIN nodes n USING (prefix) WHERE p.depth = n.depth),
ups AS (SELECT n.id AS id, w.id AS up, u.conv_id AS up_conv FROM nodes n JOIN within w ON w.conv_id = n.conv_id AND w.depth = n.depth - 1 JOIN nodes u ON u.id = w.id),
below AS (SELECT up AS id, count(*) AS n_children FROM ups GROUP BY up),
pairs AS (SELECT DISTINCT a.id AS id, b.id AS inner_id FROM within a JOIN within b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT p.id AS id, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE length(n.prefix[-1].t) END)::BIGINT AS saved_tokens FROM pairs p JOIN nodes n ON n.id = p.inner_id LEFT JOIN below b ON b.id = p.inner_id GROUP BY p.id)
SELECT n.conv_id, n.depth, up_conv AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM nodes n LEFT JOIN ups USING (id) LEFT JOIN below USING (id) JOIN sums USING (id)"""

ORACLES = {
    "llm_leaks": LEAKS,
    "op11_repair": repair_sql(),
    "op12_top_k": TOP_K,
    "op13_trie": TRIE,
    "op6_simhash": simhash(3, 2),
    "llm_base_scores": BASE_SCORES,
    "llm_payloads": PAYLOADS,
    "llm_languages": LANGUAGES,
    "llm_toxic_scores": TOXIC_SCORES,
    "llm_pieces": PIECES,
    "llm_token_files": TOKEN_FILES,
}
