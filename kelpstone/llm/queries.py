"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest, htmltext, licences, linededup, mixing, neardup, packing, quality, tokencount, warc
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


# Stated apart from the operator: limits and patterns are written out here.
ORACLE_SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(0, len(words) - 7)) AS i FROM d),
twice AS (SELECT doc_id, i FROM spots QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(words[i + 1 : i + 8], ' ')) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
told AS (
  SELECT *, regexp_matches(right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 16), '[.!?:;,…。！？]["''”’»)\]]*$') AS ended,
    regexp_matches(x, '[.!?…]["''”’»)\]]* ') AS sentence, len(regexp_extract_all(x, '[|»•·›>]')) AS separators, len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols,
    regexp_matches(x, '(?i)\b(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|log ?in|sign ?(?:up|in)|subscribe|newsletter|click here|read more|share (?:this|on)|follow us|skip to content|lorem ipsum)\b')
    OR regexp_matches(x, '(?i)\b(?:alle rechte vorbehalten|impressum|nutzungsbedingungen|jetzt (?:anmelden|registrieren|abonnieren)|hier klicken|folgen sie uns|zum inhalt springen)\b')
    OR regexp_matches(x, '(?i)\b(?:todos los derechos reservados|aviso legal|iniciar sesi[oó]n|leer m[aá]s|suscr[ií]bete|comparte en|s[ií]guenos|saltar al contenido)\b') OR regexp_matches(x, '(?i)\bha(?:ga|z) clic aqu')
    OR regexp_matches(x, '(?i)\b(?:tous droits r[eé]serv[eé]s|mentions l[eé]gales|cliquez ici|lire la suite|abonnez-vous|partager sur|suivez-nous|aller au contenu)\b') AS phrase
  FROM lines WHERE n > 0
),
judged AS (SELECT doc_id, x, (ended OR sentence OR n < 12) AND NOT (phrase AND n <= 20) AND symbols <= 0.5 * n AND NOT (n >= 2 AND separators >= 3 AND n <= 4 * separators) AS good FROM told),
per AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (good), 0) AS kept FROM judged GROUP BY doc_id),
counts AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(kept, 0)::BIGINT AS kept_chars
  FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN again ON d.doc_id = again.doc_id),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND 2 * kept_chars >= word_chars AS kept FROM base
"""


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "copied", F.length("clean_text").cast("long").alias("n_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


ORACLE_SQL["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, n, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
), bad AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= 5
), each AS (
  SELECT doc_id, count_if(b.line IS NOT NULL) AS gone, count_if(b.line IS NULL AND l.line <> '') AS own, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (b.line IS NULL), '') AS rest
  FROM lines l LEFT JOIN bad b ON l.line = b.line GROUP BY doc_id
), told AS (
  SELECT d.doc_id, coalesce(gone > 0 AND own = 0, false) AS copied, CASE WHEN gone > 0 AND own > 0 THEN gone ELSE 0 END AS removed, CASE WHEN gone > 0 AND own > 0 THEN rest ELSE text END AS clean
  FROM documents d LEFT JOIN each e ON d.doc_id = e.doc_id
)
SELECT doc_id, removed::BIGINT AS n_removed, copied, length(clean)::BIGINT AS n_chars, sha256(clean) AS clean_sha256 FROM told
"""


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN g.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first <> page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 100
"""


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    """The rules stated apart from the operator; only the notices, their words and the base phrases are its."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    templates = ", ".join(f"('{t.label}', '{t.text}', {quoted(t.needs.split())}, {quoted(t.without.split())})" for t in licences.TEMPLATES)
    phrases = ", ".join(f"('{label}', {quoted(p)})" for p, label in licences.PHRASES.items())
    word, low = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, {low.format("coalesce(text, '')")} AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
t AS (SELECT row_number() OVER () AS id, label, needs, without, all_words, len(all_words) AS n, list_distinct(all_words) AS words, ceil(0.8 * len(list_distinct(all_words)) - 1e-9) AS least
  FROM (SELECT label, needs, without, regexp_extract_all({low.format("notice")}, '{word}') AS all_words FROM (VALUES {templates}) v(label, notice, needs, without))),
pairs AS (SELECT doc_id, low, w.words, id FROM w, t WHERE list_has_all(w.words, t.needs) AND len(list_intersect(w.words, t.words)) >= least),
blocks AS (
  SELECT doc_id, id, p.words[i + 1 : i + ceil(1.25 * n)::INT + greatest(1, n // 4) - 1] AS block FROM pairs p JOIN t USING (id), unnest(range(0, len(p.words), greatest(1, n // 4))) AS r(i)
  UNION ALL
  SELECT doc_id, id, block FROM (SELECT doc_id, id, n, regexp_extract_all(unnest(string_split(low, chr(10))), '{word}') AS block FROM pairs JOIN t USING (id)) WHERE len(block) <= 2 * n
),
met AS (
  SELECT doc_id, label, len(list_intersect(block, t.words)) / len(t.words) AS share FROM blocks JOIN t USING (id)
  WHERE len(list_intersect(block, t.words)) >= least AND list_has_all(block, needs) AND NOT list_has_any(block, without)
),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS most FROM met GROUP BY doc_id),
p(label, phrase) AS (VALUES {phrases}),
spots AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM w),
places AS (SELECT doc_id, label, i FROM spots, p WHERE words[i + 1] = phrase[1] AND words[i + 1 : i + len(phrase)] = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM places GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(most, 0) END::DOUBLE AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN method ON w.doc_id = method.doc_id
"""


ORACLE_SQL["op7_license_scan"] = _licence_sql()


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")
