"""The queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, extraction, jaccard_join, packing, pii, quality_model, quality_rules, substring_dedup, token_counts, toxicity
from .common import bucket_of, table

Query = Callable[[SparkSession, str], DataFrame]


def _held_out(mod: int, fold: int) -> Column:
    """Whether the row is in the fold; a null doc_id is in none."""
    return F.coalesce(bucket_of("doc_id", mod) == fold, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), train_rows=bucket_of("doc_id", 4) != 2)
    d = quality_model.score(docs, model)
    return d.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.select("doc_id", "spans", pii.span_digest(kinds=pii.BASE).alias("_base"))
    counts = [F.expr(f"bigint(size(filter(spans, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in pii.BASE]
    return d.select("doc_id", *counts, F.sha2("_base", 256).alias("base_sha256"), pii.span_digest().alias("spans"), pii.span_scores().alias("scores"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), token_counts.number_edits)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train_rows=bucket_of("doc_id", 3) != 1)
    d = toxicity.score(docs, model)
    return d.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_pii, op3_token_counts, op4_substring_dedup, op5_toxicity, op6_jaccard_join, op7_decontamination, op8_extraction, op9_packing, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_pii": _op2(), "op4_substring_dedup": _OP4, "op6_jaccard_join": _OP6, "op7_decontamination": _OP7, "op10_quality_rules": _OP10}


_WORDS = r"[^\x20\x09-\x0D]+"
_OP4 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
g AS (SELECT doc_id, i, i > 400 + LAG(i) OVER (PARTITION BY doc_id ORDER BY i) AS far FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING COUNT(*) > 1)),
k AS (SELECT doc_id, i, SUM(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 400 AS z FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, a, z, coalesce(LAG(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS open FROM s),
c AS (SELECT doc_id, SUM(z - a) AS removed, COUNT(*) AS spans, MAX(z) AS tail, string_agg(hex(CASE WHEN a > open THEN array_slice(b, open, a - 1) ELSE ''::BLOB END), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(CASE WHEN spans IS NULL THEN b ELSE unhex(head || CASE WHEN tail <= n THEN hex(array_slice(b, tail, n)) ELSE '' END) END) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
#: kind: (pattern without look-around, what confirms a match v, what makes it likelier, score, its bonus, words for and against, and their weights).
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE", r"regexp_matches(v, '^[A-Za-z0-9].*\.[A-Za-z]{2,24}$') AND NOT contains(v, '..')", 60, 30,
     "e-?mail|mailto|contact|write|cc|from|to", 10, "noreply|no-reply|example|placeholder", 20),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0",
     r"NOT regexp_matches(v, '^0*(?:0|10|127|2(?:2[4-9]|[34][0-9]|5[0-5]))\.|^0*192\.0*168\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*169\.0*254\.')", 40, 20,
     "ip|host|server|address|addr|client|login|from", 30, "v|ver|version|release|chapter|section|build", 30),
    ("card", r"[0-9](?:[ -]?[0-9])+", "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse(digits)[i + 1] AS INTEGER) ELSE 2 * CAST(reverse(digits)[i + 1] AS INTEGER) - CASE WHEN reverse(digits)[i + 1] > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
     "regexp_matches(v, '^(?:4|5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?[47]|6[ -]?(?:0|4|5))')", 40, 20,
     "card|visa|mastercard|amex|credit|debit|pan|payment|cvv|cvc", 30, "isbn|order|invoice|tracking|serial|ticket|reference|ref", 20),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(digits) BETWEEN 10 AND 15", r"regexp_matches(v, '^\+[1-9]') AND NOT regexp_matches(v, '[ ().-]{4}')", 50, 20,
     "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms", 20, "sum|total|add|equals|score", 20),
    ("iban", r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", "NOT regexp_matches(behind, '^[A-Za-z0-9]') AND length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(v, 1, 4), ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), lambda a, y: (a * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1",
     "FALSE", 55, 0, "iban|account|konto|compte|cuenta|bank|bic|swift|transfer", 40, "serial|tracking|model|part|sku|licen[cs]e|example", 20),
    ("national_id", "[0-9-]+", "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND substr(v, 1, 3) NOT IN ('000', '666') AND v[1] <> '9' AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000'",
     "FALSE", 30, 0, "ssn|social|security|national|id|tax", 30, "phone|part|order|serial", 20),
    ("secret", r'(?:^|[^A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:password|passwd|token|secret|api_?key) ?[=:] ?"?[A-Za-z0-9_+/.-]{12,})', "NOT (starts_with(v, 'AKIA') AND regexp_matches(behind, '^[A-Za-z0-9]'))",
     "starts_with(v, 'AKIA') OR regexp_matches(v, '[=:].*[0-9]')", 60, 20, "key|login|auth|credential|credentials|bearer|aws", 20, "example|dummy|placeholder|sample|fake", 40),
]


def _op2() -> str:
    base = "('email', 'ip', 'card', 'phone')"
    word = lambda w: f"regexp_matches(near, '(?:^|[^a-z])(?:{w})(?:[^a-z]|$)')"
    raw = " UNION ALL ".join(f"SELECT doc_id, {k} AS rank, '{n}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for k, (n, p, *_) in enumerate(_PII))
    valid = " ".join(f"WHEN '{x[0]}' THEN {x[2]}" for x in _PII)
    score = " ".join(f"WHEN '{n}' THEN {c} + CASE WHEN {more} THEN {b} ELSE 0 END + CASE WHEN {word(w)} THEN {up} ELSE 0 END - CASE WHEN {word(a)} THEN {down} ELSE 0 END" for n, _, _, more, c, b, w, up, a, down in _PII)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({raw}),
u AS (SELECT doc_id, rank, kind, unnest(m) AS w, unnest(g[1 : len(m)]) AS gap, unnest(range(len(m))) AS i FROM raw WHERE len(m) > 0),
p AS (SELECT *, CASE WHEN kind IN ('iban', 'secret') THEN regexp_replace(w, '^[^A-Za-z0-9]', '') ELSE w END AS v, CAST(SUM(length(gap) + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS INTEGER) AS z FROM u),
s AS (SELECT doc_id, rank, kind, v, z - length(v) AS a, z, regexp_replace(v, '[^0-9]', '', 'g') AS digits, substr(t, z + 1, 48) AS behind, lower(substr(t, greatest(z - length(v) - 48, 0) + 1, least(z - length(v), 48)) || '|' || substr(t, z + 1, 48)) AS near FROM p JOIN d USING (doc_id)),
c AS (SELECT *, least(100, greatest(0, CASE kind {score} END)) AS score FROM s WHERE CASE kind {valid} END),
k AS (SELECT *, kind || ':' || a || ':' || z AS span FROM c WHERE kind IN {base} OR score >= 50)
SELECT d.doc_id, {', '.join(f"COUNT(*) FILTER (kind = '{x}') AS n_{x}" for x in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (kind IN {base}), '')) AS base_sha256,
 coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY a, rank), '') AS scores FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""


_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) - 4 AS n, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bg AS (SELECT item_id, len(w) - 4 AS m, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
bc AS (SELECT item_id, m, g, COUNT(*) AS c FROM bg GROUP BY 1, 2, 3),
bs AS (SELECT item_id, SUM(c * (length(g) - 4)) AS total FROM bc GROUP BY 1),
win AS (SELECT DISTINCT doc_id, item_id, m, unnest(range(greatest(pos - m + 1, 0), least(pos, greatest(n - m, 0)) + 1)) AS start FROM dg JOIN bc USING (g)),
wc AS (SELECT win.doc_id, item_id, start, g, COUNT(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND pos >= start AND pos < start + m GROUP BY 1, 2, 3, 4),
x AS (SELECT doc_id, item_id, start, SUM(wc.c * (length(g) - 4)) AS total, SUM(CASE WHEN bc.c IS NULL THEN 0 ELSE least(wc.c, bc.c) * (length(g) - 4) END) AS shared FROM wc LEFT JOIN bc USING (item_id, g) GROUP BY 1, 2, 3),
y AS (SELECT doc_id, item_id, start, CAST(shared AS DOUBLE) / CAST(x.total + bs.total - shared AS DOUBLE) AS similarity FROM x JOIN bs USING (item_id)),
z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM y WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(len(w) AS INTEGER) AS n_words, similarity FROM z JOIN b USING (item_id) WHERE rn = 1
"""
_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT both_ways.a, r.c FROM r JOIN both_ways ON both_ways.b = r.id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, MIN(c) AS component_id FROM r GROUP BY 1) l USING (doc_id)
"""
_OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
k AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING COUNT(*) > 1),
c AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN k USING (doc_id, g)) GROUP BY 1),
s AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, greatest(len(w), 1) AS n1, greatest(2, length(t) - length(replace(t, chr(10), '')) + 1) AS n_lines
 FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars > 20 * n1 OR word_chars < 2 * n1 OR 10 * n_symbols > 3 * n1 OR 10 * n_dup_lines > 5 * n_lines
 OR 10 * len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), lambda x: regexp_full_match(x, '\p{{Lu}}{{2,}}'))) > 6 * n1
 OR 2 * length(regexp_replace(t, '\P{{L}}+', '', 'g')) < word_chars OR 10 * len(regexp_extract_all(t, '(?m)^[ \t]*[-*•‣]')) > 9 * n_lines AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM v
"""
