"""The queries ``opN_<name>``: each operator on its whole table, with production parameters.

``ORACLE`` has DuckDB SQL where SQL can say what an operator returns.  The others are tested
against brute force in ``tests/llm``: fingerprints and components (op1), another library's ids (op2),
base counts and spans by Python's ``re`` and a learner's held-out accuracy (op4, op5, op7, op10), a
lossless read-back (op6).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, matroska, mixing, pii, quality, secrets, simhash, substring, toxicity
from ._base import WORD, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Weights of the tree's levels that differ from 1, the share of all tokens wanted, and the epochs allowed.
MIX_WEIGHTS = {"domain": {"domain0": 1.0, "domain1": 3.0, "domain2": 2.0, "domain3": 2.0}, "lang": {"en": 4.0, "de": 2.0}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 17


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written("base").cast("binary"), 256).alias("base_sha256"), secrets.written("found").alias("spans"), "n_entropy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_byte_bpe, op3_substring_dedup, op4_quality_rules, op5_pii, op6_matroska, op7_secrets, op8_mixing, op9_licenses, op10_toxicity)}


_SPACE = r"[\x20\x09-\x0D]+"

_OP3 = f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\x20', '\\1' || chr(10), 'g'), chr(10)) AS u FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(range(1, len(u) + 1)) AS k, unnest(u) AS unit FROM cut),
placed AS (
  SELECT doc_id, unit, k, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start"
  FROM line),
plain AS (
  SELECT doc_id, k, CAST("start" AS BIGINT) AS "start", CAST("start" + length(unit) AS BIGINT) AS "end",
         trim(regexp_replace(lower(unit), '{_SPACE}', ' ', 'g'), ' ') AS plain FROM placed WHERE regexp_matches(unit, '{WORD}')),
units AS (SELECT *, length(plain) - length(replace(plain, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM plain),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value("start") OVER w AS first_start
  FROM units WINDOW w AS (PARTITION BY plain ORDER BY doc_id, "start")),
again AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ranked WHERE NOT (doc_id = first_doc_id AND "start" = first_start)),
passages AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS run_words FROM again)
SELECT doc_id, "start", "end", first_doc_id, first_start FROM passages WHERE run_words >= {substring.MIN_WORDS}
"""


def _cases(column: str) -> str:
    given = MIX_WEIGHTS.get(column, {})
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in sorted(given.items())) + " ELSE CAST(1 AS DOUBLE) END" if given else "CAST(1 AS DOUBLE)"


def _level(name: str, level: str, parent: list[str], given: str) -> str:
    """SQL of one level: children of each parent dealt ``given`` by weight up to capacity."""
    keys = ", ".join([*parent, level])
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    join = f"JOIN {given} g USING ({', '.join(parent)})" if parent else f"CROSS JOIN {given} g"
    return f"""
{name}_c AS (SELECT c.*, g.given FROM (SELECT {keys}, CAST(sum(capacity) AS DOUBLE) AS capacity, {_cases(level)} AS weight FROM leaves GROUP BY {keys}) c {join}),
{name}_o AS (SELECT *,
    coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER ({by} ORDER BY capacity / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM {name}_c),
{name}_f AS (SELECT *, capacity / weight <= (given - taken) / shares AS is_full FROM {name}_o),
{name} AS (SELECT {keys}, round(CASE WHEN is_full THEN capacity ELSE weight * (given - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0))
    / sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}) END, 3) AS given FROM {name}_f)"""


_OP8 = f"""
WITH counted AS (
  SELECT doc_id, 'domain' || CAST(coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4, 0) AS VARCHAR) AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_tokens) * {MIX_EPOCHS} AS BIGINT) AS capacity FROM counted GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT CAST(least(floor(sum(n_tokens) * CAST({MIX_SHARE} AS DOUBLE)), sum(capacity)) AS DOUBLE) AS given FROM leaves),
{_level("l1", "domain", [], "root")},
{_level("l2", "lang", ["domain"], "l1")},
{_level("l3", "source", ["domain", "lang"], "l2")},
budget AS (SELECT *, budget // n_tokens AS whole, budget % n_tokens AS part FROM (SELECT leaves.*, CAST(floor(given) AS BIGINT) AS budget FROM leaves JOIN l3 USING (domain, lang, source))),
placed AS (
  SELECT c.*, whole, part, sum(c.n_tokens) OVER (PARTITION BY c.domain, c.lang, c.source ORDER BY md5('{MIX_SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '?'))) AS total
  FROM counted c JOIN budget b ON c.domain = b.domain AND c.lang = b.lang AND c.source = b.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN n_tokens > 0 AND total <= part THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM placed
WHERE whole + CASE WHEN n_tokens > 0 AND total <= part THEN 1 ELSE 0 END > 0
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in table.items()) + "}"


def _gsub(expr: str, *changes: tuple[str, str]) -> str:
    for pattern, to in changes:
        expr = f"regexp_replace({expr}, {_text(pattern)}, {to if to.startswith('chr(') or '||' in to else _text(to)}, 'g')"
    return expr


def _licence_ids(pieces: str) -> str:
    """SQL of the identifiers of a list of sentences."""
    whole, heads, names = licenses.lookup()
    plain = "trim(" + _gsub("lower(p)", (licenses.DROPPED, ""), (licenses.SPACED, " ")) + ", ' ')"
    plain = _gsub(plain, *[(a, b.replace("@1", "\\1").replace("@2", "\\2")) for a, b in licenses.TOLD])
    bare = _gsub(f"' ' || replace({_gsub('q', (licenses.PHRASE, ''), (licenses.TAIL, ''))}, ' ', '  ') || ' '", (licenses.FILLER, ""), (" +", " "), (" v ?([0-9])", " \\1"))
    head = f"array_to_string(string_split(q, ' ')[1:{licenses.HEAD}], ' ')"
    found = f"coalesce({_map(whole)}[q], {_map(heads)}[{head}], {_map(names)}[trim({bare}, ' ')])"
    return f"list_filter(list_transform(list_transform({pieces}, lambda p: {plain}), lambda q: {found}), lambda z: z IS NOT NULL)"


def _op9() -> str:
    cut = _gsub("text", ("\\r\\n?", "chr(10)"), (f"(?m){licenses.MARKS}", ""), (licenses.BLANK, "chr(1)"), (licenses.STOP, "'\\1' || chr(1)"))
    cues, joined = _text(licenses.CUES), "replace(s, chr(10), ' ')"
    rules, last = [], "r0"
    for k, (name, sequence) in enumerate(licenses.RULES, 1):
        now = f"replace(rest, {_text(''.join(f',{x},' for x in sequence))}, '|')"
        rules.append(f"r{k} AS (SELECT doc_id, ids, {now} AS rest, CASE WHEN {now} <> rest THEN list_append(found, {_text(name)}) ELSE found END AS found FROM {last})")
        last = f"r{k}"
    single = f"list_filter(list_transform(list_filter(regexp_split_to_array(rest, '[,|]+'), lambda x: x <> ''), lambda x: {_map(licenses.SINGLE)}[x]), lambda x: x IS NOT NULL)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, CASE WHEN regexp_matches(text, {cues}) THEN list_filter(string_split({cut}, chr(1)), lambda s: regexp_matches(s, {cues})) ELSE [] END AS sentences FROM t),
one AS (SELECT doc_id, k, s, {_licence_ids(f"[{joined}]")} AS whole, {_licence_ids(f"regexp_split_to_array({joined}, {_text(licenses.PARTS)})")} AS parts, {_licence_ids("string_split(s, chr(10))")} AS lines
  FROM (SELECT doc_id, unnest(range(1, len(sentences) + 1)) AS k, unnest(sentences) AS s FROM cut)),
told AS (SELECT doc_id, k, CASE WHEN len(whole) > 0 THEN whole WHEN len(parts) > len(lines) THEN parts ELSE lines END AS ids FROM one),
every AS (SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM told GROUP BY doc_id),
r0 AS (SELECT t.doc_id, coalesce(ids, []) AS ids, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',,') || ',' ELSE '' END AS rest, CAST([] AS VARCHAR[]) AS found FROM t LEFT JOIN every ON every.doc_id = t.doc_id),
{", ".join(rules)},
done AS (SELECT doc_id, ids, found, {single} AS single, len(list_filter(regexp_split_to_array(rest, '[,|]+'), lambda x: x <> '')) AS n FROM {last}),
named AS (SELECT *, list_concat(found, single) AS names FROM done)
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentences,
  coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses, CAST(n - len(single) AS BIGINT) AS unmatched FROM named
"""


ORACLE = {"op3_substring_dedup": _OP3, "op8_mixing": _OP8, "op9_licenses": _op9()}
