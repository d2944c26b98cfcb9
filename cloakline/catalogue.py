"""The catalogue: a query for each operator over the driver's tables, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .expected import EXPECTED
from .functions import text
from .functions.evidence import Context, evidence, shape_labels
from .functions.patterns import ALIASES, BLOCKED_TOKENS, CATEGORIES, CATEGORY_OF, COUNTRIES, GENERIC_TOKENS, NON_NAME_TOKENS, PRECISE_SHAPES, TOKEN_AFTER, TOKEN_BEFORE, URL_TOKEN, re2, sql
from .operators import identity, intervals, profiles, redaction, scan, seeds, words
from .operators.scan import exploded, scan_values, with_context, with_findings
from .plans import documents as plan
from .plans.options import PRESETS, Options
from .plans.storage import stored
from .sources.readers import melted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """A plain scan's rows over all cores where the files give fewer tasks than that, as one small file does; larger inputs aren't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < 2 * cores else rows


def sample_values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(samples.VALUES), "doc_id long, label string, category string, value string, key_hint string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and our samples, as values without a field."""
    own = dealt(table(spark, sf_dir, "documents").selectExpr("doc_id", "text as value"))
    return with_context(own.union(sample_values(spark).select("doc_id", "value"))).withColumn("kind", F.lit("text"))


SAMPLES_SQL = f"{samples.values_clause(samples.VALUES)} AS s(doc_id, label, category, value, key_hint)"
TEXTS_SQL = f"(SELECT doc_id, text AS value FROM documents UNION ALL SELECT doc_id, value FROM {SAMPLES_SQL})"


def spans_sql(source: str, pattern: str) -> str:
    """DuckDB: every match with its offsets."""
    p = re2(pattern)
    size = "lambda x: length(x)"
    return f"""(SELECT doc_id, original, start, start + length(original) AS stop FROM (
      SELECT t.doc_id, t.ms[i.i] AS original, CAST(list_sum(list_transform(t.gs[1:i.i], {size})) + coalesce(list_sum(list_transform(t.ms[1:i.i - 1], {size})), 0) AS INTEGER) AS start
      FROM (SELECT doc_id, regexp_extract_all(value, {p}) AS ms, string_split_regex(value, {p}) AS gs FROM {source} v WHERE value IS NOT NULL) t,
        LATERAL (SELECT unnest(generate_series(1, len(t.ms))) AS i) i))"""


DIGITS_SQL = "length(regexp_replace(original, '[^0-9]', '', 'g'))"
LUHN_SQL = f"""({DIGITS_SQL} > 0 AND list_sum(list_transform(generate_series(1, {DIGITS_SQL}), lambda k:
      CASE WHEN k % 2 = 0 THEN (CASE WHEN 2 * CAST(substr(reverse(regexp_replace(original, '[^0-9]', '', 'g')), k, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(reverse(regexp_replace(original, '[^0-9]', '', 'g')), k, 1) AS INTEGER) - 9
        ELSE 2 * CAST(substr(reverse(regexp_replace(original, '[^0-9]', '', 'g')), k, 1) AS INTEGER) END)
      ELSE CAST(substr(reverse(regexp_replace(original, '[^0-9]', '', 'g')), k, 1) AS INTEGER) END)) % 10 = 0)"""


def iban_sql(value: str) -> str:
    compact = f"upper(regexp_replace({value}, '\\s', '', 'g'))"
    turned = f"(substr({compact}, 5) || substr({compact}, 1, 4))"
    digit = f"CASE WHEN substr({turned}, k, 1) BETWEEN '0' AND '9' THEN CAST(substr({turned}, k, 1) AS BIGINT) ELSE ascii(substr({turned}, k, 1)) - 55 END"
    return f"""(regexp_full_match({compact}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(generate_series(1, length({turned})), lambda k: {digit})),
      lambda r, d: CASE WHEN d > 9 THEN (r * 100 + d) % 97 ELSE (r * 10 + d) % 97 END) = 1)"""


IBANS_SQL = f"(SELECT * FROM {spans_sql(TEXTS_SQL, 'IBAN')} WHERE {iban_sql('original')})"
NO_IBAN_SQL = f"NOT EXISTS (SELECT 1 FROM {IBANS_SQL} b WHERE b.doc_id = m.doc_id AND m.start >= b.start AND m.stop <= b.stop)"
LETTERS_SQL = "length(regexp_replace(original, '[^A-Z]', '', 'g'))"
#: Detector: pattern, confidence in thousandths, predicate (all as SQL over a text without a field).
DETECTORS_SQL = {
    "EMAIL": ("EMAIL", "910", None), "API_KEY": ("API_KEY", "960", None), "AWS_ACCESS_KEY": ("AWS_ACCESS_KEY", "950", None), "JWT": ("JWT", "920", None), "UUID": ("UUID", "870", None),
    "IPV4_CIDR": ("IPV4_CIDR", "940", None), "IPV4": ("IPV4", "820", None), "IPV6": ("IPV6", "820", None), "SSN": ("SSN", "950", None), "US_TAX_ID": ("US_TAX_ID", "900", None),
    "IBAN": ("IBAN", "960", iban_sql("original")), "VAT_ID": ("VAT_ID", "860", None), "MAC_ADDRESS": ("MAC_ADDRESS", "920", None), "POTENTIAL_SECRET": ("SECRET", "660", None),
    "PHONE": ("PHONE", f"CASE WHEN {DIGITS_SQL} >= 10 THEN 850 ELSE 720 END", f"{DIGITS_SQL} BETWEEN 7 AND 15 AND NOT regexp_matches(original, {re2('DATE')}) AND {NO_IBAN_SQL}"),
    "VIN": ("VIN", "900", None), "PASSPORT": ("PASSPORT", "760", f"{LETTERS_SQL} >= 1 AND {DIGITS_SQL} >= 5"), "PASSPORT_NUMBER": ("PASSPORT_NUMBER", "860", None), "MRZ_LINE": ("MRZ_LINE", "900", None),
    "CREDIT_CARD": ("CREDIT_CARD", f"CASE WHEN {LUHN_SQL} THEN 900 ELSE 580 END", NO_IBAN_SQL), "BIC": ("BIC", "780", f"regexp_matches(original, {re2('BIC_COUNTRY')})"),
}
FOUND = ("doc_id", "start", "stop", "original", "conf_milli")


def found(values: DataFrame, only: tuple[str, ...], options: Options = Options()) -> DataFrame:
    return exploded(with_findings(values, options, only=only)).withColumnRenamed("milli", "conf_milli")


for _name, (_pattern, _conf, _keep) in DETECTORS_SQL.items():
    query(
        f"detect_{_name.lower()}",
        f"SELECT doc_id, start, stop, original, CAST({_conf} AS INTEGER) AS conf_milli FROM {spans_sql(TEXTS_SQL, _pattern)} m" + (f" WHERE {_keep}" if _keep else ""),
    )(lambda spark, sf_dir, name=_name: found(texts(spark, sf_dir), (name,)).select(*FOUND))

_BEFORE = f"^(.*?(?:^|{TOKEN_BEFORE})){URL_TOKEN}(?:$|{TOKEN_AFTER})".replace("'", "''")
_TOKEN = f"^(?:.*?(?:^|{TOKEN_BEFORE}))({URL_TOKEN})(?:$|{TOKEN_AFTER})".replace("'", "''")


@query(
    "detect_url_secret",
    f"""SELECT doc_id, CAST(start + length(regexp_extract(original, '{_BEFORE}', 1)) AS INTEGER) AS start, CAST(start + length(regexp_extract(original, '{_BEFORE}', 1)) + length(regexp_extract(original, '{_TOKEN}', 1)) AS INTEGER) AS stop,
      regexp_extract(original, '{_TOKEN}', 1) AS original, CAST(880 AS INTEGER) AS conf_milli
      FROM {spans_sql(TEXTS_SQL, 'URL')} m WHERE regexp_matches(original, {re2('API_PATH')}) AND regexp_extract(original, '{_TOKEN}', 1) <> ''""",
)
def detect_url_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(texts(spark, sf_dir), ("URL_SECRET",)).select(*FOUND)


def trimmed_sql(v: str) -> str:
    return f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


def address_sql(v: str, t: str) -> str:
    """DuckDB: a trimmed value v with the tokens t reads as an address."""
    not_these = " AND ".join(f"NOT regexp_matches({v}, {re2(n)})" for n in ("NOT_ADDRESS", "DATE", "EMAIL_VALUE", "PHONE_VALUE", "IPV4_VALUE", "IPV4_CIDR_VALUE"))
    near = f"list_bool_or(list_transform(generate_series(1, len({t})), lambda i: regexp_matches({t}[i], {re2('HOUSE_NUMBER')}) AND list_bool_or(list_transform(generate_series(1, len({t})), lambda j: regexp_matches({t}[j], {re2('STREET_WORD')}) AND abs(i - j) <= 5))))"
    return f"length({v}) BETWEEN 5 AND 160 AND regexp_matches({v}, '[0-9]') AND regexp_matches({v}, '\\p{{Latin}}') AND {not_these} AND len({t}) BETWEEN 2 AND 10 AND len(list_filter({t}, lambda x: regexp_matches(x, '[0-9]'))) <= 2 AND coalesce({near}, FALSE)"


@query(
    "detect_street_address",
    f"""WITH l AS (SELECT doc_id, start, regexp_replace(original, '\r$', '') AS line FROM {spans_sql(TEXTS_SQL, '[^\n]+')} m),
    p AS (SELECT doc_id, start, line, 1 AS k, {trimmed_sql("substr(line, strpos(line, ':') + 1)")} AS v FROM l WHERE contains(line, ':') UNION ALL SELECT doc_id, start, line, 2, {trimmed_sql('line')} FROM l),
    t AS (SELECT *, regexp_extract_all(v, {re2('ADDRESS_TOKEN')}) AS t FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY k) AS rn FROM t WHERE {address_sql('v', 't')})
    SELECT doc_id, CAST(start + strpos(line, v) - 1 AS INTEGER) AS start, CAST(start + strpos(line, v) - 1 + length(v) AS INTEGER) AS stop, v AS original, CAST(CASE WHEN regexp_matches(v, {re2('POSTAL_CODE')}) THEN 780 ELSE 720 END AS INTEGER) AS conf_milli FROM o WHERE rn = 1""",
)
def detect_street_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(texts(spark, sf_dir), ("STREET_ADDRESS",)).select(*FOUND)


def field_values(spark: SparkSession) -> DataFrame:
    return with_context(sample_values(spark).filter("key_hint is not null").select("doc_id", "value", "key_hint")).withColumn("kind", F.lit("table")).withColumn("preview_path", F.concat(F.lit("row 1."), "key_hint"))


@query("detect_field_hints")
def detect_field_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of hinted fields, all detectors."""
    return scan_values(field_values(spark)).withColumnRenamed("milli", "conf_milli").select("doc_id", "label", *FOUND[1:])


@query("detect_drivers_license", f"SELECT doc_id, start, stop, original, CAST(840 AS INTEGER) AS conf_milli FROM {spans_sql(f'(SELECT doc_id, value FROM {SAMPLES_SQL} WHERE key_hint = {chr(39)}driver_license{chr(39)})', 'DRIVERS_LICENSE')} m")
def detect_drivers_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(field_values(spark).filter("key_hint = 'driver_license'"), ("DRIVERS_LICENSE",)).select(*FOUND)


@query(
    "scan_pages",
    f"SELECT page_id, 'EMAIL' AS label, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id AS page_id FROM {spans_sql('(SELECT page_id AS doc_id, html AS value FROM pages)', 'EMAIL')}) GROUP BY 1 UNION ALL SELECT page_id, 'BIC', count(*) FROM (SELECT doc_id AS page_id FROM {spans_sql('(SELECT page_id AS doc_id, html AS value FROM pages)', 'BIC')} WHERE regexp_matches(original, {re2('BIC_COUNTRY')})) GROUP BY 1",
)
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_context(dealt(table(spark, sf_dir, "pages").selectExpr("page_id", "html as value"))).withColumn("kind", F.lit("text"))
    return found(rows, ("EMAIL", "BIC")).groupBy("page_id", "label").agg(F.count("*").alias("n"))


# Functions

_OWN = f"(SELECT doc_id, value AS original FROM {SAMPLES_SQL})"


def shaped(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    """What matches a pattern in whole documents and our samples."""
    spans = texts(spark, sf_dir).select("doc_id", F.posexplode_outer(F.expr(text.matches("value", sql(pattern)))).alias("n", "m")).filter("n is not null")
    return spans.select("doc_id", "m.original")


@query("checksum_luhn", f"SELECT doc_id, original, {LUHN_SQL} AS ok FROM {spans_sql(TEXTS_SQL, 'CREDIT_CARD')} UNION ALL SELECT doc_id, original, {LUHN_SQL} AS ok FROM {_OWN}")
def checksum_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sample_values(spark).select("doc_id", F.col("value").alias("original"))
    return shaped(spark, sf_dir, "CREDIT_CARD").union(own).withColumn("ok", F.expr(text.luhn_ok("original")))


@query("checksum_iban", f"SELECT doc_id, original, {iban_sql('original')} AS ok FROM {spans_sql(TEXTS_SQL, 'IBAN')}")
def checksum_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, "IBAN").withColumn("ok", F.expr(text.iban_ok("original")))


@query("normal_form", f"SELECT doc_id, trim(regexp_replace(translate(lower(strip_accents(value)), '{text.LEET_FROM}', '{text.LEET_TO}'), '[^a-z0-9]+', ' ', 'g')) AS normal FROM {TEXTS_SQL} t")
def normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.expr(text.normal("value")).alias("normal"))


def evidence_sql(label: str) -> str:
    aliases = " OR ".join(f"contains(j, '{a}')" for a in ALIASES[label])
    aliases += "".join(f" OR list_bool_or(list_transform(segs, lambda s: {' AND '.join(f'list_contains(string_split(s, {chr(39)} {chr(39)}), {chr(39)}{t}{chr(39)})' for t in a.split())}))" for a in ALIASES[label] if " " in a)
    some = lambda ws: "list_bool_or(list_transform(segs, lambda s: list_has_any(string_split(s, ' '), [" + ", ".join(f"'{w}'" for w in ws) + "])))"
    score = f"CASE WHEN {aliases} THEN 160 ELSE 0 END + CASE WHEN {some(GENERIC_TOKENS)} THEN 40 ELSE 0 END"
    return f"CASE WHEN {some(BLOCKED_TOKENS)} THEN 0 ELSE {score} END" if label in ("PERSON", "PLACE", "ORG") else score


_SEG = f"trim(regexp_replace(translate(lower(strip_accents(regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g'))), '{text.LEET_FROM}', '{text.LEET_TO}'), '[^a-z0-9]+', ' ', 'g'))"
_SEGS = f"list_filter(list_transform([key_hint, preview_path, kind], lambda p: {_SEG}), lambda s: s <> '')"
#: Our sample contexts, and each page's address with the last word of its path as a field.
_CONTEXTS_SQL = f"(SELECT * FROM {samples.values_clause(samples.CONTEXTS)} AS c(context_id, key_hint, preview_path, kind) UNION ALL SELECT page_id + 1000, regexp_extract(url, '[A-Za-z]*$'), url, 'text' FROM pages)"
_SCORED = tuple(label for label in ALIASES if label not in ("SSN", "CREDIT_CARD"))


@query(
    "evidence_scores",
    " UNION ALL ".join(f"SELECT context_id, '{label}' AS label, CAST({evidence_sql(label)} AS INTEGER) AS score_milli FROM (SELECT context_id, segs, array_to_string(segs, ' ') AS j FROM (SELECT context_id, {_SEGS} AS segs FROM {_CONTEXTS_SQL}))" for label in _SCORED),
)
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(samples.CONTEXTS), "context_id long, key_hint string, preview_path string, kind string")
    rows = rows.union(table(spark, sf_dir, "pages").select(F.col("page_id") + 1000, F.regexp_extract("url", "[A-Za-z]*$", 0), "url", F.lit("text")))
    rows = rows.withColumn("segs", F.expr(Context("key_hint", "preview_path", kind="kind").segments()))
    scored = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.expr(f"cast(round({evidence('segs', 'cast(null as array<string>)', label)} * 1000) as int)").alias("score_milli")) for label in _SCORED)))
    return rows.select("context_id", scored.alias("s")).select("context_id", "s.label", "s.score_milli")


# Identity


def identity_rows(spark: SparkSession, sf_dir: str, made: str, extra: dict[str, str] | None = None) -> DataFrame:
    rows = texts(spark, sf_dir)
    for name, e in (extra or {}).items():
        rows = rows.withColumn(name, F.expr(e))
    rows = rows.withColumn("findings", F.expr(made)).select("doc_id", F.posexplode_outer("findings").alias("n", "f")).filter("n is not null")
    return rows.select("doc_id", "f.label", "f.start", "f.stop", "f.original", F.col("f.milli").alias("conf_milli"))


_HINTS = f"""SELECT *, CAST(NULL AS VARCHAR) AS preview_path, 'text' AS kind, regexp_replace({trimmed_sql("regexp_replace(substr(original, 1, strpos(original, name) - 1), '[:=-]\\s*$', '')")}, '^$', '') AS key_hint
      FROM (SELECT doc_id, start, original, regexp_extract(original, {re2('LABELLED')}, 1) AS name FROM {spans_sql(TEXTS_SQL, 'LABELLED')} m) WHERE name <> ''"""


@query(
    "identity_labelled",
    f"""SELECT doc_id, 'PERSON' AS label, CAST(start + strpos(original, name) - 1 AS INTEGER) AS start, CAST(start + strpos(original, name) - 1 + length(name) AS INTEGER) AS stop, name AS original, CAST(730 AS INTEGER) AS conf_milli
      FROM (SELECT *, array_to_string(segs, ' ') AS j FROM (SELECT *, {_SEGS} AS segs FROM ({_HINTS}))) WHERE {evidence_sql('PERSON')} > 0""".replace("(?iu", "(?i"),
)
def identity_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_rows(spark, sf_dir, identity.labelled("value", scan.HERE))


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LINES_SQL = f"(SELECT doc_id, start, regexp_replace(original, '\\r$', '') AS line FROM {spans_sql(TEXTS_SQL, '[^' + chr(92) + 'n]+')} m)"


@query(
    "identity_contact_lines",
    f"""WITH l AS (SELECT doc_id, start, string_split(line, ',') AS raw FROM {_LINES_SQL} WHERE contains(line, ',') AND contains(line, '@')),
    q AS (SELECT l.doc_id, l.start, l.raw, r.i FROM l, LATERAL (SELECT unnest(generate_series(1, len(l.raw))) AS i) r),
    z AS (SELECT doc_id, start, i, {trimmed_sql('raw[i]')} AS p, start + coalesce(list_sum(list_transform(raw[1:i - 1], lambda x: length(x) + 1)), 0) + length(raw[i]) - length(regexp_replace(raw[i], '^\\s+', '')) AS place FROM q),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, start) AS n FROM z WHERE p <> ''),
    m AS (SELECT *, min(CASE WHEN regexp_matches(p, {re2('EMAIL_LOOSE')}) THEN k END) OVER (PARTITION BY doc_id, start) AS mail FROM n WHERE n BETWEEN 2 AND 6),
    c AS (SELECT *, min(CASE WHEN k > mail AND lower(p) IN ({listed(COUNTRIES)}) THEN k END) OVER (PARTITION BY doc_id, start) AS country FROM m WHERE mail IS NOT NULL)
    SELECT doc_id, CASE WHEN k < mail THEN 'PERSON' ELSE 'PLACE' END AS label, CAST(place AS INTEGER) AS start, CAST(place + length(p) AS INTEGER) AS stop, p AS original, CAST(CASE WHEN k > mail THEN 720 WHEN n = 2 THEN 780 ELSE 740 END AS INTEGER) AS conf_milli FROM c
    WHERE (k < mail AND regexp_matches(p, {re2('NAME')})) OR (k > mail AND regexp_matches(p, {re2('PLACE_NAME')}) AND (k = country OR (k = country - 1 AND country > mail + 1)))""",
)
def identity_contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_rows(spark, sf_dir, identity.contact_lines("value"))


_PLACED = "list_sum(list_transform({gs}[1:{i}], lambda x: length(x))) + coalesce(list_sum(list_transform({ms}[1:{i} - 1], lambda x: length(x))), 0)"


@query(
    "identity_standalone_names",
    f"""WITH t AS (SELECT doc_id, start + strpos(line, {trimmed_sql('line')}) - 1 AS start, {trimmed_sql('line')} AS t FROM {_LINES_SQL} WHERE {trimmed_sql('line')} <> ''),
    g AS (SELECT *, string_split_regex(t, '\\s+') AS raw, regexp_matches(t, {re2('NAME')}) AS alone FROM t WHERE NOT regexp_matches(t, '[,@0-9]') AND NOT regexp_matches(t, {re2('NOT_A_NAME')}) AND lower(t) NOT IN ({listed(COUNTRIES)}) AND NOT list_has_any(string_split_regex(lower(t), '\\s+'), [{listed(NON_NAME_TOKENS)}])),
    k AS (SELECT DISTINCT doc_id, lower(raw[1] || ' ' || raw[2]) AS pair FROM g WHERE alone AND len(raw) = 2),
    a AS (SELECT *, regexp_extract_all(t, '\\S+') AS ms, string_split_regex(t, '\\S+') AS gs FROM g WHERE NOT alone AND len(raw) BETWEEN 4 AND 20 AND len(raw) % 2 = 0),
    u AS (SELECT a.doc_id, a.start, a.t, a.ms, a.gs, r.i, lower(a.raw[r.i] || ' ' || a.raw[r.i + 1]) AS pair FROM a, LATERAL (SELECT unnest(generate_series(1, len(a.raw) - 1, 2)) AS i) r),
    v AS (SELECT u.*, count(*) OVER (PARTITION BY u.doc_id, u.start, u.pair) > 1 OR k.pair IS NOT NULL AS ok FROM u LEFT JOIN k ON k.doc_id = u.doc_id AND k.pair = u.pair),
    w AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc_id, start) AS fine FROM v),
    e AS (SELECT doc_id, start, start + length(t) AS stop, t AS original FROM g WHERE alone UNION ALL
      SELECT doc_id, start + {_PLACED.format(gs='gs', ms='ms', i='i')}, start + {_PLACED.format(gs='gs', ms='ms', i='(i + 1)')} + length(ms[i + 1]), substr(t, CAST({_PLACED.format(gs='gs', ms='ms', i='i')} + 1 AS BIGINT), CAST({_PLACED.format(gs='gs', ms='ms', i='(i + 1)')} + length(ms[i + 1]) - ({_PLACED.format(gs='gs', ms='ms', i='i')}) AS BIGINT)) FROM w WHERE fine)
    SELECT doc_id, 'PERSON' AS label, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, original, CAST(greatest(CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 2 THEN 840 ELSE 630 END, CASE WHEN list_bool_and(list_transform(string_split_regex(original, '\\s+'), lambda x: regexp_matches(x, {re2('PROPER_TOKEN')}))) THEN 820 ELSE 630 END) AS INTEGER) AS conf_milli FROM e""",
)
def identity_standalone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_rows(spark, sf_dir, identity.name_lines("value", identity.NO_SEEDS))


_SEED_TOKENS = "list_filter(string_split(trim(regexp_replace(translate(lower(strip_accents(value)), '" + text.LEET_FROM + "', '" + text.LEET_TO + "'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


def tokens_sql(value: str) -> str:
    return _SEED_TOKENS.replace("strip_accents(value)", f"strip_accents({value})")


def near_sql(left: str, right: str) -> str:
    """DuckDB: as many words, each equal or, from four characters on, within one edit."""
    word = f"{left}[k] = {right}[k] OR (length({left}[k]) >= 4 AND length({right}[k]) >= 4 AND levenshtein({left}[k], {right}[k]) <= 1)"
    return f"len({left}) > 0 AND len({left}) = len({right}) AND coalesce(list_bool_and(list_transform(generate_series(1, least(len({left}), len({right}))), lambda k: {word})), FALSE)"


def spread_sql(source: str, doc: str, names: str, seeds: str) -> str:
    """DuckDB: candidates of values (doc_id, value) of `source` that a seed of their document fits. doc: the document of a doc_id; names: findings
    (doc_id, label, start, stop); seeds: (doc, label, w, rank)."""
    return f"""SELECT doc_id, label, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, original, CAST(680 AS INTEGER) AS conf_milli FROM (
      SELECT c.doc_id, c.start, c.stop, c.original, arg_min(s.label, s.rank) AS label FROM (SELECT *, {tokens_sql('original')} AS w FROM {spans_sql(source, 'CANDIDATE')} m) c
      JOIN {seeds} s ON s.doc = {doc.format('c.doc_id')} AND {near_sql('c.w', 's.w')} GROUP BY ALL) h
    WHERE NOT EXISTS (SELECT 1 FROM {names} f WHERE f.doc_id = h.doc_id AND f.label = h.label AND f.start = h.start AND f.stop = h.stop)"""


_NAMES_SQL = f"(SELECT *, 31 AS seq FROM ({ORACLES['identity_labelled']}) UNION ALL SELECT *, 34 AS seq FROM ({ORACLES['identity_standalone_names']}))"
_TEXT_SEEDS = f"""(SELECT doc_id AS doc, label, w, min(struct_pack(seq := seq, start := start)) AS rank FROM (SELECT *, {tokens_sql('original')} AS w FROM {_NAMES_SQL} WHERE conf_milli >= 720) WHERE len(w) > 0 GROUP BY ALL)"""


@query("identity_seed_propagation", f"WITH names AS {_NAMES_SQL}, seeds AS {_TEXT_SEEDS.replace(_NAMES_SQL, 'names')} {spread_sql(TEXTS_SQL, '{}', 'names', 'seeds')}")
def identity_seed_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident names of a text on their variants in it."""
    rows = texts(spark, sf_dir)
    made = f"concat({identity.labelled('value', scan.HERE)}, {identity.name_lines('value', identity.NO_SEEDS)})"
    names = rows.select("doc_id", F.posexplode_outer(F.expr(made)).alias("n", "f")).filter("n is not null").select("doc_id", "n", "f.label", "f.start", "f.stop", "f.original", "f.confidence")
    names = stored(names)
    confident = names.filter("confidence >= 0.72").select("doc_id", "label", F.expr(text.tokens("original")).alias("words"), F.col("n").alias("rank")).filter("size(words) > 0")
    return seeds.spread(rows.select("doc_id", "value"), ["doc_id"], [], names, confident).withColumn("conf_milli", F.lit(680))


def collection_sql(source: str, doc: str = "{}", place: str = "0", passes: int = 2) -> str:
    """DuckDB: one or both passes over values without fields. source: (doc_id, value), where doc_id names a value; doc and place: the document of a doc_id and
    its place there. Gives doc_id, label, start, stop, original, conf_milli."""
    of = lambda name: ORACLES[name].replace(TEXTS_SQL, source)
    plain = [(f"detect_{n.lower()}", {"URL_SECRET": "POTENTIAL_SECRET", "PASSPORT_NUMBER": "PASSPORT", "MRZ_LINE": "PASSPORT"}.get(n, n)) for n in (*DETECTORS_SQL, "URL_SECRET", "STREET_ADDRESS")]
    columns = "doc_id, label, start, stop, original, conf_milli"
    others = " UNION ALL ".join([f"SELECT doc_id, '{label}' AS label, start, stop, original, conf_milli, {k} AS seq FROM ({of(name)})" for k, (name, label) in enumerate(plain)] + [f"SELECT {columns}, {k} AS seq FROM ({of(name)})" for k, name in ((31, "identity_labelled"), (33, "identity_contact_lines"))])
    lines = of("identity_standalone_names")
    alone = "FROM g WHERE alone AND len(raw) = 2)"
    assert alone in lines
    known = lines.replace(alone, f"{alone[:-1]} UNION SELECT g.doc_id, array_to_string(w, ' ') FROM g JOIN known ON known.doc = {doc.format('g.doc_id')} WHERE label = 'PERSON' AND len(w) = 2)")
    rank = "min(struct_pack(p := {}, t := CAST({} AS BIGINT), a := CAST({} AS BIGINT), b := CAST({} AS BIGINT)))"
    confident = "FROM (SELECT *, " + tokens_sql("original") + " AS w FROM {}) WHERE label IN ('PERSON', 'PLACE', 'ORG') AND conf_milli >= 720 AND len(w) > 0 GROUP BY ALL"
    own = lambda names: f"SELECT doc_id AS doc, label, w, {rank.format(0, 0, 'seq', 'start')} AS rank {confident.format(names)}"
    first = f"""WITH others AS MATERIALIZED ({others}), found AS MATERIALIZED (SELECT * FROM others UNION ALL SELECT {columns}, 34 FROM ({lines})),
    seeds AS MATERIALIZED ({own('found')}), first AS MATERIALIZED (SELECT {columns}, min(seq) AS seq FROM (SELECT * FROM found UNION ALL SELECT {columns}, 35 FROM ({spread_sql(source, '{}', 'found', 'seeds')})) GROUP BY ALL)"""
    if passes == 1:
        return f"{first} SELECT {columns} FROM first"
    return f"""{first},
    known AS MATERIALIZED (SELECT {doc.format('doc_id')} AS doc, label, w, {rank.format(1, place.format('doc_id'), 'start', '-stop')} AS rank {confident.format('first')}),
    found2 AS MATERIALIZED (SELECT * FROM others UNION ALL SELECT {columns}, 34 FROM ({known})),
    seeds2 AS MATERIALIZED ({own('found2')} UNION ALL SELECT v.doc_id, label, w, rank FROM {source} v JOIN known ON known.doc = {doc.format('v.doc_id')})
    SELECT {columns} FROM first UNION SELECT {columns} FROM found2 UNION SELECT {columns} FROM ({spread_sql(source, '{}', 'found2', 'seeds2')})"""


_TURNS_SQL = "(SELECT struct_pack(c := conv_id, t := turn) AS doc_id, text AS value FROM conversations)"


@query("scan_conversations", f"SELECT doc_id.c AS doc_id, doc_id.t AS value_seq, label, start, stop, original, conf_milli FROM ({collection_sql(_TURNS_SQL, '{}.c', '{}.t')})")
def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as values of one document each conversation: seeds of names spread over a conversation."""
    rows = dealt(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("value_seq"), F.col("text").alias("value"), F.lit("text").alias("kind"))
    return scan.scan_collection(rows).select("doc_id", "value_seq", "label", "start", "stop", "original", F.col("milli").alias("conf_milli"))


@query(
    "identity_same_tokens",
    f"""WITH t AS (SELECT doc_id, {_SEED_TOKENS} AS w FROM {SAMPLES_SQL} WHERE category = 'identity')
      SELECT a.doc_id AS left_id, b.doc_id AS right_id, (len(a.w) > 0 AND len(a.w) = len(b.w) AND coalesce(list_bool_and(list_transform(generate_series(1, least(len(a.w), len(b.w))), lambda k: a.w[k] = b.w[k] OR (length(a.w[k]) >= 4 AND length(b.w[k]) >= 4 AND levenshtein(a.w[k], b.w[k]) <= 1))), FALSE)) AS same
      FROM t a, t b WHERE a.doc_id < b.doc_id""",
)
def identity_same_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy equality of the normal words of all pairs of our identity samples, a fixed handful."""
    t = sample_values(spark).filter("category = 'identity'").select("doc_id", F.expr(text.tokens("value")).alias("w"))
    a, b = t.select(F.col("doc_id").alias("left_id"), F.col("w").alias("p")), t.select(F.col("doc_id").alias("right_id"), F.col("w").alias("q"))
    return a.join(b, F.col("left_id") < F.col("right_id")).select("left_id", "right_id", F.expr(text.same_tokens("p", "q")).alias("same"))


# Findings of a few detectors, for what works on findings

SIMPLE = ("EMAIL", "IPV4", "IBAN", "POTENTIAL_SECRET", "PASSPORT", "PASSPORT_NUMBER", "MRZ_LINE", "BIC", "CREDIT_CARD", "PHONE")
_LABEL = {"PASSPORT_NUMBER": "PASSPORT", "MRZ_LINE": "PASSPORT"}
SIMPLE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{_LABEL.get(n, n)}' AS label, '{CATEGORY_OF[_LABEL.get(n, n)]}' AS category, CAST({DETECTORS_SQL[n][1]} AS INTEGER) AS conf_milli, start, stop, original FROM {spans_sql(TEXTS_SQL, DETECTORS_SQL[n][0])} m" + (f" WHERE {DETECTORS_SQL[n][2]}" if DETECTORS_SQL[n][2] else "")
    for n in SIMPLE
)
#: Distinct by label, span and rounded confidence, as a scan's findings are.
WITH_SIMPLE = f"WITH f AS (SELECT DISTINCT * FROM ({SIMPLE_SQL})), "


def simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(texts(spark, sf_dir), SIMPLE)


@query("dedupe_findings", WITH_SIMPLE + "x AS (SELECT 1) SELECT doc_id, label, category, conf_milli, start, stop, original FROM f")
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple(spark, sf_dir).select("doc_id", "label", "category", "conf_milli", "start", "stop", "original")


_ISLANDS = """o AS (SELECT *, CASE WHEN start >= coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop, conf_milli DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh,
      row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, conf_milli DESC, label) AS rn FROM g WHERE stop > start),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS island FROM o),
    c AS (SELECT doc_id, island, min(start) AS start, max(stop) AS stop, max(conf_milli) AS conf_milli, arg_max(label, conf_milli * 1000000 - rn) AS label, count(*) AS n_merged FROM i GROUP BY doc_id, island)"""


@query("overlap_collapse", WITH_SIMPLE + "g AS (SELECT * FROM f), " + _ISLANDS + " SELECT doc_id, start, stop, conf_milli, label, CAST(n_merged AS BIGINT) AS n_merged FROM c")
def overlap_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.collapsed(simple(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "start", "stop", F.round(F.col("confidence") * 1000).cast("int").alias("conf_milli"), "label", "n_merged")


_BEST = "b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, stop ORDER BY conf_milli DESC, label) AS rn FROM f) WHERE rn = 1)"


@query("best_of_ranges", WITH_SIMPLE + _BEST + " SELECT doc_id, label, start, stop, conf_milli FROM b")
def best_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.best_of_ranges(simple(spark, sf_dir), ["doc_id"]).select("doc_id", "label", "start", "stop", "conf_milli")


@query("nested_collapse", WITH_SIMPLE + _BEST + " SELECT doc_id, label, start, stop, conf_milli FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.label = b.label AND o.start <= b.start AND o.stop >= b.stop AND (o.start <> b.start OR o.stop <> b.stop))")
def nested_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.finalised(simple(spark, sf_dir), ["doc_id"]).select("doc_id", "label", "start", "stop", "conf_milli")


@query("numbered_findings", WITH_SIMPLE + _BEST + " SELECT doc_id, 'f-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS finding_id, label, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, label) AS n FROM b)")
def numbered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.best_of_ranges(simple(spark, sf_dir), ["doc_id"])
    return redaction.numbered(rows, ["doc_id"], ["start", F.desc("stop"), "label"]).select("doc_id", "finding_id", "label", "start", "stop")


@query(
    "redact_documents",
    WITH_SIMPLE + "g AS (SELECT * FROM f WHERE conf_milli >= 800), " + _ISLANDS + f""",
    p AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM c),
    r AS (SELECT p.doc_id, string_agg(substr(t.value, p.before + 1, p.start - p.before) || '[REDACTED]', '' ORDER BY p.start) AS head, max(p.stop) AS last, count(*) AS n FROM p JOIN {TEXTS_SQL} t ON t.doc_id = p.doc_id GROUP BY p.doc_id)
    SELECT t.doc_id, coalesce(r.head || substr(t.value, r.last + 1), t.value) AS redacted_text, CAST(coalesce(r.n, 0) AS INTEGER) AS n_replaced FROM {TEXTS_SQL} t LEFT JOIN r ON r.doc_id = t.doc_id""",
)
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.redact_values(with_findings(texts(spark, sf_dir), only=SIMPLE), 0.8)
    return rows.select("doc_id", F.col("output").alias("redacted_text"), "n_replaced")


_HASH = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_STEPS = ", ".join(f"({'seed' if k == 1 else f's{k - 1}'} * 1664525 + 1013904223) & 4294967295 AS s{k}" for k in range(1, 17))
_STREAM = " || ".join(f"lower(to_base(s{k}, 36))" for k in range(1, 17))


@query(
    "pseudonyms",
    WITH_SIMPLE + f"""d AS (SELECT DISTINCT label, original, label || ':' || original AS k FROM f WHERE regexp_full_match(original, '[\\x20-\\x7e]+')),
    h AS (SELECT label, original, {_HASH} AS seed FROM d), s AS (SELECT *, {_STEPS} FROM h), t AS (SELECT *, {_STREAM} AS stream FROM s)
    SELECT label, original, CASE label WHEN 'EMAIL' THEN 'user+' || substr(stream, 1, 10) || '@example.test' WHEN 'IPV4' THEN '198.51.100.' || CAST(seed % 253 + 1 AS VARCHAR)
      WHEN 'CREDIT_CARD' THEN '4111 1111 ' || substr(CAST(seed % 10000 + 1000 AS VARCHAR), 1, 4) || ' ' || substr(CAST((seed >> 2) % 10000 + 1000 AS VARCHAR), 1, 4) ELSE 'redact-' || substr(stream, 1, 16) END AS pseudonym FROM t""",
)
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simple(spark, sf_dir).select("label", "original").distinct().filter(r"original rlike r'^[\x20-\x7e]+\z'")
    return rows.withColumn("pseudonym", F.expr(text.pseudonym("label", "original")))


_PSEUDONYM_SQL = """CASE label WHEN 'EMAIL' THEN 'user+' || substr(stream, 1, 10) || '@example.test' WHEN 'IPV4' THEN '198.51.100.' || CAST(seed % 253 + 1 AS VARCHAR)
      WHEN 'CREDIT_CARD' THEN '4111 1111 ' || substr(CAST(seed % 10000 + 1000 AS VARCHAR), 1, 4) || ' ' || substr(CAST((seed >> 2) % 10000 + 1000 AS VARCHAR), 1, 4) ELSE 'redact-' || substr(stream, 1, 16) END"""


@query(
    "pseudonymise_documents",
    WITH_SIMPLE + "g AS (SELECT * FROM f WHERE conf_milli >= 800), " + _ISLANDS + f""",
    k AS (SELECT c.doc_id, c.start, c.stop, c.label, c.label || ':' || substr(t.value, c.start + 1, c.stop - c.start) AS k, t.value FROM c JOIN {TEXTS_SQL} t ON t.doc_id = c.doc_id),
    h AS (SELECT *, {_HASH} AS seed FROM k), s AS (SELECT *, {_STEPS} FROM h), w AS (SELECT *, {_STREAM} AS stream FROM s),
    p AS (SELECT *, {_PSEUDONYM_SQL} AS mask, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM w),
    r AS (SELECT doc_id, string_agg(substr(value, before + 1, start - before) || mask, '' ORDER BY start) AS head, max(stop) AS last, count(*) AS n FROM p GROUP BY doc_id)
    SELECT t.doc_id, coalesce(r.head || substr(t.value, r.last + 1), t.value) AS pseudonymised_text, CAST(coalesce(r.n, 0) AS INTEGER) AS n_replaced FROM {TEXTS_SQL} t LEFT JOIN r ON r.doc_id = t.doc_id""",
)
def pseudonymise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.redact_values(with_findings(texts(spark, sf_dir), only=SIMPLE), 0.8, "pseudo")
    return rows.select("doc_id", F.col("output").alias("pseudonymised_text"), "n_replaced")


@query("summary_by_doc", WITH_SIMPLE + "x AS (SELECT 1) SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE conf_milli >= 800) AS high, count(*) FILTER (WHERE conf_milli < 800) AS medium FROM f GROUP BY doc_id")
def summary_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.summary(simple(spark, sf_dir), ["doc_id"])


@query("summary_by_category", WITH_SIMPLE + "x AS (SELECT 1) SELECT coalesce(category, 'all') AS category, count(*) AS total, count(*) FILTER (WHERE conf_milli >= 800) AS high FROM f GROUP BY ROLLUP (category)")
def summary_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.summary_by_category(simple(spark, sf_dir))


@query("selection_threshold", WITH_SIMPLE + "x AS (SELECT 1) SELECT doc_id, label, start, stop, conf_milli FROM f WHERE conf_milli >= 800")
def selection_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.selected(simple(spark, sf_dir), "high").select("doc_id", "label", "start", "stop", "conf_milli")


@query("search_findings", WITH_SIMPLE + "x AS (SELECT 1) SELECT doc_id, label, start, stop, original FROM f WHERE contains(lower(label || ' ' || original || ' ' || 'pattern'), 'ip')")
def search_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.searched(simple(spark, sf_dir).drop("preview_path").withColumn("reasoning", F.array(F.lit("pattern"))), "ip")
    return rows.select("doc_id", "label", "start", "stop", "original")


@query("residual_risk", WITH_SIMPLE + 'x AS (SELECT 1) SELECT doc_id, category, count(*) FILTER (WHERE conf_milli >= 800) AS selected, count(*) FILTER (WHERE conf_milli < 800) AS "left" FROM f GROUP BY doc_id, category')
def residual_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.residual(simple(spark, sf_dir), 0.8)


@query("selection_trust", WITH_SIMPLE + """x AS (SELECT *, conf_milli >= 800 AS a, label IN ('EMAIL', 'PHONE') AS o FROM f)
  SELECT count(*) FILTER (WHERE a) AS recommended, count(*) FILTER (WHERE o) AS chosen, count(*) FILTER (WHERE NOT o) AS "left", count(*) FILTER (WHERE o AND NOT a) AS added, count(*) FILTER (WHERE NOT o AND a) AS removed FROM x""")  # fmt: skip
def selection_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["doc_id", "label", "start", "stop", "conf_milli"]
    rows = stored(simple(spark, sf_dir).select(*keys, "confidence"))  # findings are read twice, texts once
    return redaction.selection_trust(rows, rows.filter("label in ('EMAIL', 'PHONE')"), 0.8, keys)


@query(
    "selection_restore",
    WITH_SIMPLE + f"""old AS (SELECT doc_id, label, original, start, stop FROM f WHERE label IN ('EMAIL', 'IPV4')), fresh AS (SELECT doc_id, label, original, start + 1 AS start, stop + 1 AS stop FROM f WHERE label IN ('EMAIL', 'IPV4', 'BIC') UNION ALL SELECT doc_id, label, original, start, stop FROM f WHERE label = 'EMAIL'),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, original, start, stop) AS k FROM fresh), e AS (SELECT n.*, EXISTS (SELECT 1 FROM old WHERE old.doc_id = n.doc_id AND old.label = n.label AND old.original = n.original AND old.start = n.start AND old.stop = n.stop) AND k = 1 AS hit FROM n),
    lo AS (SELECT doc_id, label, original, count(*) AS c FROM (SELECT doc_id, label, original, start, stop FROM old EXCEPT SELECT doc_id, label, original, start, stop FROM e WHERE hit) GROUP BY 1, 2, 3), ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, original ORDER BY start) AS r FROM e WHERE NOT hit)
    SELECT label, count(*) AS n FROM (SELECT label FROM e WHERE hit UNION ALL SELECT ln.label FROM ln JOIN lo ON lo.doc_id = ln.doc_id AND lo.label = ln.label AND lo.original = ln.original AND ln.r <= lo.c) GROUP BY label""",
)
def selection_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection taken over by a scan whose spans moved by one, emails also where they were."""
    # Findings are read for each part of the old and the new selection, texts once.
    f = stored(simple(spark, sf_dir).filter("label in ('EMAIL', 'IPV4', 'BIC')").select("doc_id", "label", "original", "start", "stop", F.concat_ws(":", "start", "stop").alias("finding_id")))
    uid = F.concat_ws(":", "doc_id", "label", "start", "stop")
    old = f.filter("label in ('EMAIL', 'IPV4')").withColumn("finding_id", uid)
    moved = f.filter("label in ('EMAIL', 'IPV4', 'BIC')").withColumn("start", F.col("start") + 1).withColumn("stop", F.col("stop") + 1).withColumn("finding_id", F.concat(F.lit("m"), uid))
    new = moved.union(f.filter("label = 'EMAIL'").withColumn("finding_id", F.concat(F.lit("s"), uid)))
    kept = redaction.restored_selection(new, old, ["doc_id", "label", "original", "start", "stop"], ["doc_id", "label", "original"])
    return kept.groupBy("label").agg(F.count("*").alias("n"))


@query("selection_semi_join", WITH_SIMPLE + "x AS (SELECT 1) SELECT f.doc_id, f.label, f.start FROM f WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)")
def selection_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.of_selection(simple(spark, sf_dir), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "label", "start")


@query("muted_areas", WITH_SIMPLE + "x AS (SELECT 1) SELECT category, count(*) AS n FROM f WHERE category NOT IN ('network', 'secrets') GROUP BY category")
def muted_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the secrets preset leaves out, of the simple detectors."""
    options = PRESETS["secrets_only"]
    broad = found(texts(spark, sf_dir), SIMPLE, options.broad())  # one scan: the narrow one is that of its categories
    return redaction.muted_areas(broad.filter(F.col("category").isin(*options.categories)), broad)


@query("category_map", " UNION ALL ".join(f"SELECT '{label}' AS label, '{c}' AS category" for c, ls in CATEGORIES.items() for label in ls))
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(label, c) for label, c in CATEGORY_OF.items()], "label string, category string")


@query("coverage_report")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of our labelled samples whose label is found, by category and over all."""
    rows = with_context(sample_values(spark)).withColumn("preview_path", F.lit("benchmark"))
    hits = scan_values(rows.drop("label", "category")).select("doc_id", "label")
    return redaction.coverage(sample_values(spark).select(F.col("doc_id").alias("sample_id"), "label", "category"), hits)


# Profiles


def _shapes_sql(v: str) -> str:
    """DuckDB: shape labels of a trimmed value."""
    d = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    whole = lambda name, x=v: f"regexp_matches({x}, {re2(name)})"
    date = f"regexp_matches({v}, {re2('DATE')})"
    tests = [
        ("EMAIL", whole("EMAIL_VALUE")), ("PHONE", f"{whole('PHONE_VALUE')} AND NOT {date} AND {d} BETWEEN 7 AND 15"), ("CREDIT_CARD", whole("CARD_VALUE")), ("IBAN", whole("IBAN_VALUE", f"upper(regexp_replace({v}, '\\s+', ' ', 'g'))")),
        ("BIC", whole("BIC_VALUE", f"upper({v})")), ("VAT_ID", whole("VAT_VALUE", f"upper(regexp_replace({v}, '[\\s.-]', '', 'g'))")), ("IPV4_CIDR", whole("IPV4_CIDR_VALUE")), ("IPV4", whole("IPV4_VALUE")), ("IPV6", whole("IPV6_VALUE")),
        ("MAC_ADDRESS", whole("MAC_VALUE")), ("VIN", whole("VIN_VALUE")), ("PASSPORT", f"{whole('PASSPORT_VALUE')} AND regexp_matches({v}, '[A-Z]') AND regexp_matches({v}, '[0-9]')"), ("DRIVERS_LICENSE", whole("LICENSE_VALUE")),
        ("US_TAX_ID", whole("TAX_VALUE")), ("POTENTIAL_SECRET", whole("SECRET_VALUE")), ("STREET_ADDRESS", address_sql(v, f"regexp_extract_all({v}, {re2('ADDRESS_TOKEN')})")), ("PERSON", f"NOT {date} AND {whole('PERSON_VALUE')} AND regexp_matches({v}, '\\s')"), ("PLACE", f"NOT {date} AND {whole('PERSON_VALUE')}"),
        ("ORG", f"NOT {date} AND {whole('ORG_VALUE')} AND regexp_matches({v}, '\\p{{Latin}}')"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{label}' END" for label, t in tests) + "], lambda x: x IS NOT NULL)"


_CELLS = " UNION ALL ".join(f"SELECT 'table:{k}' AS group_key, trim(CAST({c} AS VARCHAR)) AS v FROM customer" for k, c in enumerate(("c_name", "c_mktsegment", "c_custkey")))


@query(
    "profile_columns",
    f"""WITH c AS ({_CELLS}), s AS (SELECT group_key, unnest({_shapes_sql('v')}) AS label FROM c WHERE v <> ''), t AS (SELECT group_key, count(*) AS total FROM c WHERE v <> '' GROUP BY 1), n AS (SELECT group_key, label, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT n.group_key, n.label, n.n, t.total, (n.label IN ({', '.join(f"'{p}'" for p in PRECISE_SHAPES)}) OR (n.n >= 2 AND n.n * 10 >= t.total * 6)) AS hinted FROM n JOIN t USING (group_key)""",
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = melted(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_custkey"])
    needed = {"table_index": "int", "sheet_index": "int", "disable_profile": "boolean", "path": "array<string>"}
    keyed = cells.withColumns({c: F.lit(None).cast(t) for c, t in needed.items()}).withColumn("group_key", F.expr(profiles.group_key()))
    return profiles.column_profiles(keyed).select("group_key", "label", "n", "total", "hinted")


@query("value_shapes", f"SELECT doc_id, array_to_string({_shapes_sql('v')}, ',') AS shapes FROM (SELECT doc_id, {trimmed_sql('value')} AS v FROM (SELECT doc_id, value FROM {SAMPLES_SQL} UNION ALL SELECT 1000000 + c_custkey, c_name FROM customer UNION ALL SELECT 2000000 + doc_id, text FROM documents WHERE text IS NOT NULL))")
def value_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_values(spark).select("doc_id", "value").union(table(spark, sf_dir, "customer").select(F.col("c_custkey") + 1_000_000, "c_name")).union(table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id") + 2_000_000, "text"))
    return rows.select("doc_id", F.array_join(F.expr(shape_labels("value")), ",").alias("shapes"))


@query("scan_table")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table scanned as cells, with column profiles and seeds: findings by column and label."""
    cells = melted(table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", ["s_name", "n_name"])
    return scan.scan_collection(cells).groupBy("key_hint", "label").agg(F.count("*").alias("n"), F.max("milli").alias("conf_milli"))


# Documents


def sample_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(samples.DOCUMENTS), "doc_id long, name string, text string")


@query("sniff_format")
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = plan.document_values(sample_documents(spark).unionByName(table(spark, sf_dir, "documents").selectExpr("doc_id + 1000 as doc_id", "cast(null as string) as name", "text")))
    return values.groupBy("doc_id", "reading").agg(F.max("preferred").alias("preferred"), F.count("*").alias("n_values"), F.max("reason").alias("reason"))


@query("scan_document_formats")
def scan_document_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.scan_documents(sample_documents(spark), PRESETS["balanced"]).select("doc_id", "finding_id", "reading", "label", "start", "stop", "original", F.round(F.col("confidence") * 1000).cast("int").alias("conf_milli"))


@query("redact_document_formats")
def redact_document_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sample_documents(spark)
    return plan.redact_documents(docs, plan.scan_documents(docs, PRESETS["balanced"]).filter("confidence >= 0.55")).select("doc_id", "name", "output", "n_replaced")


@query("media_types", "SELECT page_id, CASE lower(regexp_extract(url, '[^.]*$')) WHEN 'csv' THEN 'text/csv' WHEN 'json' THEN 'application/json' ELSE 'text/plain' END AS media_type FROM pages")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(plan.media_type("url")).alias("media_type"))


@query("line_endings", "SELECT doc_id, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' WHEN contains(text, chr(13)) THEN 'cr' ELSE 'lf' END AS ending FROM documents")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.expr(text.line_ending("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(ending == "\r\n", "crlf").when(ending == "\r", "cr").otherwise("lf").alias("ending"))


@query("scan_whole_documents", f"SELECT doc_id, label, count(*) AS n, max(conf_milli) AS conf_milli FROM ({collection_sql(TEXTS_SQL, passes=1)}) GROUP BY ALL")
def scan_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over whole documents as text: findings by document and label."""
    return scan_values(texts(spark, sf_dir), PRESETS["balanced"]).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.max("milli").alias("conf_milli"))


@query(
    "findings_in_lines",
    WITH_SIMPLE + f"""l AS (SELECT doc_id, start, stop FROM {spans_sql(TEXTS_SQL, '[^' + chr(92) + 'n]+')})
    SELECT f.doc_id, f.label, f.start, f.stop, l.start AS line_start, l.stop AS line_stop FROM f JOIN l ON l.doc_id = f.doc_id AND f.start < l.stop AND l.start < f.stop""",
)
def findings_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings beside the lines that they lie in, both as tables of spans."""
    rows = texts(spark, sf_dir)
    lines = rows.select("doc_id", F.posexplode_outer(F.expr(text.matches("value", sql(r"[^\n]+")))).alias("n", "m")).filter("n is not null").select("doc_id", "m.start", "m.stop")
    pairs = intervals.overlapping(stored(simple(spark, sf_dir).select("doc_id", "label", "start", "stop")), lines, ["doc_id"], prefix="line_")
    return pairs.select("doc_id", "label", "start", "stop", "line_start", "line_stop")


_ALL_FOUND = collection_sql(TEXTS_SQL, passes=1)


@query(
    "sql_redact_text",
    f"""WITH f AS MATERIALIZED ({_ALL_FOUND}), g AS (SELECT * FROM f WHERE conf_milli >= {round(Options().threshold * 1000)}), {_ISLANDS},
    p AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM c),
    r AS (SELECT p.doc_id, string_agg(substr(t.value, p.before + 1, p.start - p.before) || '[REDACTED]', '' ORDER BY p.start) AS head, max(p.stop) AS last FROM p JOIN {TEXTS_SQL} t ON t.doc_id = p.doc_id GROUP BY p.doc_id)
    SELECT t.doc_id, coalesce(r.head || substr(t.value, r.last + 1), t.value) AS redacted_text FROM {TEXTS_SQL} t LEFT JOIN r ON r.doc_id = t.doc_id""",
)
def sql_redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors and redaction by an SQL function alone."""
    from .api import register

    register(spark)
    return spark.sql("SELECT doc_id, redact_text(value) AS redacted_text FROM {texts}", texts=texts(spark, sf_dir).select("doc_id", "value"))


@query("sql_text_findings", f"SELECT conv_id, turn, label, count(*) AS n, max(f.stop) AS last_stop FROM (SELECT doc_id.c AS conv_id, doc_id.t AS turn, label, stop FROM ({collection_sql(_TURNS_SQL, passes=1)})) f GROUP BY ALL")
def sql_text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each turn by itself, by an SQL function and SQL's own explode."""
    from .api import register

    register(spark)
    turns = dealt(table(spark, sf_dir, "conversations"))
    return spark.sql("SELECT conv_id, turn, f.label, count(*) AS n, max(f.stop) AS last_stop FROM (SELECT conv_id, turn, text_findings(text) AS found FROM {turns}) LATERAL VIEW OUTER explode(found) x AS f WHERE f IS NOT NULL GROUP BY conv_id, turn, f.label", turns=turns)


# Word boxes


def sample_words(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    own = spark.createDataFrame(list(samples.WORDS), "doc_id int, page int, line_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double")
    return own, spark.createDataFrame(list(samples.PAGES), "doc_id int, page int, width double, height double, name string")


_WORDS_SQL = f"{samples.values_clause(samples.WORDS)} AS w(doc_id, page, line_no, word_no, text, x0, y0, x1, y1)"


@query(
    "word_ngrams_bbox",
    f"""WITH w AS (SELECT * FROM {_WORDS_SQL}) SELECT a.doc_id, a.page, a.line_no, a.word_no AS first, b.word_no - a.word_no + 1 AS n, string_agg(m.text, ' ' ORDER BY m.word_no) AS value, CAST(min(m.x0) AS DOUBLE) AS x0, CAST(min(m.y0) AS DOUBLE) AS y0, CAST(max(m.x1) AS DOUBLE) AS x1, CAST(max(m.y1) AS DOUBLE) AS y1
    FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no = b.line_no AND b.word_no BETWEEN a.word_no AND a.word_no + 11 JOIN w m ON m.doc_id = a.doc_id AND m.page = a.page AND m.line_no = a.line_no AND m.word_no BETWEEN a.word_no AND b.word_no GROUP BY 1, 2, 3, 4, 5""",
)
def word_ngrams_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = sample_words(spark)
    rows = words.ngrams(words.lines(own), 12).withColumn("box", F.expr(words.union_box("spots")))
    return rows.select("doc_id", "page", "line_no", "first", "n", "value", "box.x0", "box.y0", "box.x1", "box.y1")


def _boxes(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "page", "line_no", "label", "original", F.round(F.col("confidence") * 1000).cast("int").alias("conf_milli"), "box.x0", "box.y0", "box.x1", "box.y1")


@query("scan_word_boxes")
def scan_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, pages = sample_words(spark)
    return _boxes(words.scan_words(own, pages, PRESETS["paranoid"]))


@query("form_heuristics")
def form_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, pages = sample_words(spark)
    return _boxes(words.form_heuristics(words.lines(own), pages, PRESETS["paranoid"]))


@query("image_heuristics")
def image_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, pages = sample_words(spark)
    line_rows = words.lines(own)
    zones = words.passport_zones(line_rows, pages, aggressive=True)
    return _boxes(words.image_padding(zones.unionByName(words.portraits(line_rows, pages, pages.filter("page > 1"))), pages))


# Samples whose rows no SQL makes: the oracle is what each must give, row by row (expected.py)


def hinted_fields(spark: SparkSession) -> DataFrame:
    rows = with_context(spark.createDataFrame(list(samples.HINTED), "doc_id long, key_hint string, value string"))
    return rows.withColumn("kind", F.lit("table")).withColumn("preview_path", F.concat(F.lit("row 1."), "key_hint"))


@query("hinted_values")
def hinted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors that a field's name changes: loose addresses, numbers whose check fails, keys and passwords, names."""
    return scan_values(hinted_fields(spark), PRESETS["balanced"]).withColumnRenamed("milli", "conf_milli").select("doc_id", "label", *FOUND[1:])


@query("pipe_rows")
def pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, "rows.txt", line) for k, line in samples.PIPES], "doc_id long, name string, text string")
    return plan.document_values(rows).filter("unit = 'pipe'").select("doc_id", "value", "span_start", "span_stop")


def sample_books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "people.xlsx", bytearray(samples.workbook_bytes())), (2, "note.docx", bytearray(samples.word_bytes())), (3, "broken.xlsx", bytearray(b"no archive"))], "doc_id long, name string, content binary")


@query("xlsx_cells")
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.document_values(sample_books(spark)).filter("reading = 'xlsx'").select("doc_id", "sheet_index", "row_index", "column_index", "key_hint", "value")


@query("docx_text")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.document_values(sample_books(spark)).filter("doc_id > 1").select("doc_id", "reading", "value")


@query("redact_books")
def redact_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses in a workbook and a word processing file replaced; the workbook is read again."""
    books = sample_books(spark)
    done = plan.redact_documents(books, plan.scan_documents(books, PRESETS["balanced"]).filter("label = 'EMAIL'"))
    cells = plan.document_values(done.filter("data is not null").select("doc_id", "name", F.col("data").alias("content"))).filter("value <> ''")
    return cells.select("doc_id", F.concat_ws(" ", "row_index", "column_index").alias("place"), "value").unionByName(done.filter("doc_id = 2").select("doc_id", F.col("name").alias("place"), F.col("output").alias("value")))


@query("sheet_preview")
def sheet_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .api import sheet_preview as preview

    return preview(plan.document_values(sample_books(spark)).filter("reading = 'xlsx'"), rows=2).select("doc_id", "sheet_index", "row_index", F.array_join("cells", "|").alias("cells"), "nth")


@query("document_cells")
def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of our sample documents in every reading, with their places."""
    values = plan.document_values(sample_documents(spark))
    return values.filter("unit = 'cell'").select("doc_id", "reading", "preferred", "value", "key_hint", "preview_path", "span_start")


@query("ocr_words")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(samples.OCR), "doc_id int, tsv string")
    return words.rescaled(words.ocr_words(rows), 2.0, 4.0).select("doc_id", "page", "line_no", "word_no", "text", *words.BOX)


@query("page_rows")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.createDataFrame(list(samples.ITEMS), "doc_id int, page int, item_no int, text string, x0 double, y0 double, x1 double, y1 double")
    return words.page_rows(items).select("doc_id", "page", "line_no", "word_no", "text")


@query("page_texts")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _ = sample_words(spark)
    return words.document_text(words.page_text(words.lines(own)))


@query("manual_boxes")
def manual_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(words.manual_boxes(spark.createDataFrame(list(samples.DRAWN), "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")))


@query("face_boxes")
def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame(list(samples.FACES), "doc_id int, page int, face_no int, x0 double, y0 double, x1 double, y1 double")
    return _boxes(words.faces(found, sample_words(spark)[1]))


@query("redaction_boxes")
def redaction_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, pages = sample_words(spark)
    return words.redaction_boxes(words.scan_words(own, pages, PRESETS["paranoid"]).filter("confidence >= 0.9")).select("doc_id", "page", "label", *words.BOX)


@query("sniff_samples")
def sniff_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = plan.document_values(sample_documents(spark))
    return values.groupBy("doc_id", "reading").agg(F.max("preferred").alias("preferred"), F.count("*").alias("n_values"))


@query("seed_samples")
def seed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of our samples' own names on their variants, and of one value of a document on its others."""
    rows = with_context(sample_values(spark).filter("category = 'identity'").select("doc_id", "value")).withColumn("kind", F.lit("text"))
    names = f"concat({identity.labelled('value', scan.HERE)}, {identity.name_lines('value', identity.NO_SEEDS)})"
    rows = rows.withColumn("names", F.expr(names)).withColumn("seeds", F.expr(identity.seeds_of("names"))).withColumn("findings", F.expr(identity.spread("value", "names", "seeds")))
    own = rows.select("doc_id", F.explode("findings").alias("f")).select("doc_id", F.lit(0).cast("long").alias("value_seq"), "f.label", "f.start", "f.stop", "f.original", F.col("f.milli").alias("conf_milli"))
    cells = spark.createDataFrame(list(samples.CELLS), "doc_id long, value_seq long, key_hint string, value string").withColumn("kind", F.lit("json"))
    return own.unionByName(scan.scan_collection(cells).select("doc_id", "value_seq", "label", "start", "stop", "original", F.col("milli").alias("conf_milli")))


_ADDRESSES = ORACLES["detect_street_address"]


@query("address_candidates", f"SELECT doc_id, start, stop, original FROM ({_ADDRESSES})")
def address_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.structured import address_spans

    rows = texts(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit("")))
    return rows.select("doc_id", F.posexplode_outer(F.expr(address_spans("value"))).alias("n", "m")).filter("n is not null").select("doc_id", "m.start", "m.stop", "m.original")


@query("finding_badges", WITH_SIMPLE + "x AS (SELECT 1) SELECT doc_id, label, start, CASE WHEN conf_milli >= 800 THEN 'HIGH' ELSE 'MEDIUM' END AS badge, CAST(round(conf_milli / 10.0) AS INTEGER) AS percent FROM f WHERE contains(lower(label || ' ' || original || ' ' || 'pattern'), 'ban')")
def finding_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .api import findings_for_display

    rows = simple(spark, sf_dir).drop("preview_path").withColumn("reasoning", F.array(F.lit("pattern")))
    return findings_for_display(rows, " BAN ").select("doc_id", "label", "start", "badge", "percent")


@query("html_escaped", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .api import escape_html

    return table(spark, sf_dir, "documents").select("doc_id", escape_html("text").alias("escaped"))


@query("file_kinds", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '[.](png|jpe?g|gif|webp|bmp|tiff?)$') THEN 'image' WHEN regexp_matches(lower(url), '[.](pdf|docx|xlsx)$') THEN regexp_extract(lower(url), '[^.]*$') ELSE 'text' END AS kind FROM (SELECT page_id, url || ['', '.PNG', '.docx', '.jpeg', '.txt'][1 + page_id % 5] AS url FROM pages)")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.readers import kind_of_file

    named = table(spark, sf_dir, "pages").select("page_id", F.expr("concat(url, element_at(array('', '.PNG', '.docx', '.jpeg', '.txt'), cast(1 + page_id % 5 as int)))").alias("url"))
    return named.select("page_id", F.expr(kind_of_file("url")).alias("kind"))


@query("date_values", f"SELECT DISTINCT o_orderpriority, regexp_matches(CAST(o_orderdate AS VARCHAR), {re2('DATE')}) AS dated, regexp_matches(CAST(o_orderkey AS VARCHAR), {re2('DATE')}) AS numbered FROM orders")
def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "cast(o_orderdate as string) as d", "cast(o_orderkey as string) as k")
    return rows.select("o_orderpriority", F.expr(text.is_date("d")).alias("dated"), F.expr(text.is_date("k")).alias("numbered")).distinct()


for _name, _sql in EXPECTED.items():
    ORACLES[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents: all detectors, overlaps collapsed, findings of medium confidence and more redacted."""
    rows = redaction.redact_values(with_findings(with_context(table(spark, sf_dir, "documents").selectExpr("doc_id", "text as value")).withColumn("kind", F.lit("text")), PRESETS["balanced"]), 0.55)
    return rows.filter("n_replaced > 0").select("doc_id", F.col("output").alias("redacted_text"), F.col("n_replaced").alias("n_findings"))
