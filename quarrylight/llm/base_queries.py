"""The base columns of operators whose further columns SQL cannot express, each with its DuckDB counterpart.

Every query is the operator's own over the whole table, with fewer columns.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from quarrylight.llm.secret_scan import KINDS

_FORMATS = (
    (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("AKIA[A-Z0-9]+", 0, 18),
    ("[0-9a-f]+", 0, 16),
)
_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


def _spans_sql() -> str:
    """doc_id, kind, start, end of the fixed formats: matches and the gaps between them give places."""
    of = []
    for kind, (pattern, group, least) in enumerate(_FORMATS):
        of.append(
            f"SELECT doc_id, {kind} AS kind, p AS start, p + length(m[i]) AS stop FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS p FROM "
            f"(SELECT doc_id, m, g, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d))) WHERE length(v[i]) >= {least}"
        )
    return " UNION ALL ".join(of)


_NAME = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS[:3])) + " END"
_PHRASES = {"gpl": ("gnu", "general", "public", "license"), "apache": ("apache", "license"), "cc-by": ("cc", "by"), "mit": ("mit", "license")}
_PLACES = ", ".join("list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(p)) + f") AS p{n}" for n, p in enumerate(_PHRASES.values()))

SQL = {
    "base1_secret_formats": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_spans_sql()}),
  a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg({_NAME} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS written FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(written, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "base4_edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, n - n // 2) || substring(u, 1, n // 2)) AS edited_sha256 FROM e""",
    "base6_unigrams": f"""
WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, list_append(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), ' ') AS w FROM documents),
  o AS (SELECT doc_id, held_out, unnest(w) AS word FROM d), c AS (SELECT word, count(*) AS c FROM o WHERE NOT held_out GROUP BY word), z AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM o LEFT JOIN c USING (word) CROSS JOIN z GROUP BY doc_id, held_out""",
    "base8_sizes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'key' AS law FROM documents",
    "base9_phrases": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), p AS (SELECT doc_id, w, {_PLACES} FROM d),
  a AS (SELECT *, list_concat(p0, list_concat(p1, list_concat(p2, p3))) AS places FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(_PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a""",
}


def queries(of: dict) -> dict:
    """``of``: the operators' queries by name."""
    return {
        "base1_secret_formats": lambda spark, sf: of["op1_secret_scan"](spark, sf).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
        "base4_edited_texts": lambda spark, sf: of["op4_order_minhash"](spark, sf).select("doc_id", "n_chars", "edited_sha256"),
        "base6_unigrams": lambda spark, sf: of["op6_kneser_ney"](spark, sf).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score")),
        "base8_sizes": lambda spark, sf: of["op8_hash_tree_sharding"](spark, sf).select("doc_id", "size", "law"),
        "base9_phrases": lambda spark, sf: of["op9_license_index"](spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    }
