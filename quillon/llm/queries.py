"""The registered query of each operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, fingerprint, html, langid, merkle, mixing, near_dup, ngram_lm, quality, substring, tokens, warc

#: The vocabulary of the token files.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the token files."""
    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, read back from the bundles."""
    records = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with the passage of each."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and each source's own terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of earlier ones."""
    out = substring.deduplicated(table(spark, sf_dir, "documents"), text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


# Shingle sets, all pairs that share a shingle, and everything reachable over links.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g
  FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.k + y.k - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a
), m AS (
  SELECT doc_id, min(node) AS least FROM r GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id, coalesce(m.least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 AND page_id IS NOT NULL GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.payload_bytes >= 100 AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.payload_bytes >= 100 AND f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

# Both towers level by level, the siblings of each row, and its fold; crc32 bit by bit.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, n_chars, source, lang, text,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda s, c: list_reduce([xor(s, c), 1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), h AS (
  SELECT doc_id, g, crc, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM d
), l AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + CAST(coalesce(xor(crc, 4294967295) % 7 = 0, false) AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(coalesce(xor(crc, 4294967295) % 7 = 0, false) AS INT)), '-') || tail) AS used FROM h
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), lower_tree AS (
  SELECT g, 0 AS lv, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lower_tree WHERE n > 1 GROUP BY g, lv, i // 2, n
), subroots AS (
  SELECT g, h AS subroot, lv AS levels, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS m FROM lower_tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS lv, k AS i, m AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE n > 1 GROUP BY lv, i // 2, n
), top AS (
  SELECT h AS root, lv AS heights FROM upper_tree WHERE n = 1
), fold AS (
  SELECT l.g, l.i AS leaf_i, 0 AS lv, CASE WHEN s.levels = 0 THEN s.k ELSE l.i END AS pos, l.used AS h, '' AS sib, s.levels, s.k, t.heights FROM leaves l JOIN subroots s ON s.g = l.g CROSS JOIN top t
  UNION ALL
  SELECT f.g, f.leaf_i, f.lv + 1, CASE WHEN f.lv + 1 = f.levels THEN f.k ELSE f.pos // 2 END,
         sha256(CASE WHEN coalesce(a.h, b.h) IS NULL THEN f.h WHEN f.pos % 2 = 0 THEN f.h || coalesce(a.h, b.h) ELSE coalesce(a.h, b.h) || f.h END),
         f.sib || coalesce(a.h, b.h, ''), f.levels, f.k, f.heights
  FROM (SELECT * FROM fold WHERE lv < levels + heights) f
  LEFT JOIN lower_tree a ON f.lv < f.levels AND a.g = f.g AND a.lv = f.lv AND a.i = xor(f.pos, 1)
  LEFT JOIN upper_tree b ON f.lv >= f.levels AND b.lv = f.lv - f.levels AND b.i = xor(f.pos, 1)
)
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(f.sib) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN fold f ON f.g = l.g AND f.leaf_i = l.i AND f.lv = f.levels + f.heights CROSS JOIN top t
"""

# Every group laid out over all kept terms of its language.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (
  SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n::HUGEINT + 5 * l.v) AS p, 1 + (1000000000 * (k.total + 5)) // (l.n + 5 * l.v) AS q
  FROM g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

# The first document of every 13 words.
OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS x FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE doc_id IS NOT NULL)
), f AS (
  SELECT x, min(doc_id) AS first FROM s GROUP BY x
), hit AS (
  SELECT s.r, s.i FROM s JOIN f ON f.x = s.x WHERE f.first < s.doc_id
), gone AS (
  SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM hit) GROUP BY r
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ')
                   ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(js, j)), lambda j: ws[j]), ' ') END) AS kept_sha256
FROM w LEFT JOIN gone ON gone.r = w.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_token_output": op2_token_output,
    "op3_near_dup": op3_near_dup,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_fingerprint": op7_fingerprint,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_lm_scores": op10_lm_scores,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_substring": op13_substring,
}
ORACLE_SQL: dict[str, str] = {
    "op3_near_dup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op11_merkle": OP11_SQL,
    "op12_divergence": OP12_SQL,
    "op13_substring": OP13_SQL,
}
