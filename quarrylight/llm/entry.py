"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import base_queries, bin_packing, decontaminate, hash_tree, kneser_ney, license_index, ngram_join, order_minhash, pii_surrogates, secret_scan, substring_dedup, token_alignment, toxicity, turn_repair
from quarrylight.llm.shared import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS)]
    return found.select("doc_id", *counts[:3], F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"), counts[3])


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))[0]


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii_surrogates.replace(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"])))
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), least_within=5)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    apart = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(docs.where(~apart).select("text"))
    return kneser_ney.score(docs, model).select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits", "toxic_weight")


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign_shards(_read(spark, sf_dir, "documents"), shards=8)


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_index.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.transform("base", lambda b: b["word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    method = F.transform("found", lambda f: f["label"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"), best.alias("score"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(_read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(_read(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    made = turn_repair.repair(turn_repair.damage(conversations), every=conversations)
    hashes = turn_repair.digests(made.rows).withColumnRenamed("conv_id", "k")
    both = made.report.join(hashes, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    return both.select(*made.report.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (op1_secret_scan, op2_ngram_jaccard_join, op3_pii_surrogates, op4_order_minhash, op5_benchmark_decontamination, op6_kneser_ney, op7_toxicity, op8_hash_tree_sharding, op9_license_index, op10_best_fit_packing, op11_token_alignment, op12_turn_repair, op13_substring_dedup)}
    return own | base_queries.queries(own)


#: Sets of word 5-grams, all pairs that share one, and groups by recursion: the join without MinHash.
_JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d
), sets AS (
  SELECT s, min(doc_id) AS set_id, count(*) AS copies FROM g GROUP BY s
), e AS (
  SELECT set_id, len(s) AS n, unnest(s) AS gram FROM sets
), p AS (
  SELECT x.set_id AS a, y.set_id AS b, count(*) AS c, any_value(x.n + y.n) AS n FROM e x JOIN e y ON x.gram = y.gram AND x.set_id <> y.set_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 10 * c >= 8 * (n - c)
), r AS (
  SELECT set_id AS node, set_id AS root FROM sets UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), k AS (
  SELECT node, min(root) AS class_id FROM r GROUP BY node
), m AS (
  SELECT l.a, sum(sets.copies) AS n FROM l JOIN sets ON sets.set_id = l.b GROUP BY l.a
)
SELECT g.doc_id, k.class_id, sets.set_id, CAST(sets.copies - 1 + coalesce(m.n, 0) AS BIGINT) AS n_links
FROM g JOIN sets ON g.s = sets.s JOIN k ON k.node = sets.set_id LEFT JOIN m ON m.a = sets.set_id
"""


#: Every window by its words, and the least document that holds it.
_REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS lo FROM x GROUP BY s
), g AS (
  SELECT x.doc_id, list(DISTINCT i + j) AS gone FROM x JOIN f USING (s), range(13) AS t(j) WHERE f.lo < x.doc_id GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def _edit(w: str, cost: int, letter: str, line: str = "''") -> str:
    """A weight (eight digits, audit, a mark, what is said) after one more edit."""
    return f"(printf('%08d', CAST(left({w}, 8) AS BIGINT) + {cost}) || substr({w}, 9, instr({w}, chr(1)) - 9) || '{letter}' || substr({w}, instr({w}, chr(1))) || {line})"


def _repair_sql() -> str:
    """Row by row, the least weight of each of the four states; weights are strings that sort by cost and audit."""
    bad = {q: _edit(f"w{q}", 4, "D") for q in range(4)}
    then = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    said = {2: "'\nuser:' || text", 3: "'\nassistant:' || text"}
    same = "'\n' || role || ':' || text"

    def rerole(w: str, q: int) -> str:
        return f"CASE WHEN fault IN ('', 'truncated') THEN {_edit(w, 0, 'R', said[q])} END".replace("+ 0)", f"+ 3 + {then})")

    def keep(w: str, initial: str) -> str:
        return f"CASE WHEN fault IN ('', 'truncated') AND left(role, 1) = '{initial}' THEN {_edit(w, 0, 'K', same)} END".replace("+ 0)", f"+ {then})")

    ways = {
        0: [bad[0]],
        1: [bad[1], keep("w0", "s")],
        2: [bad[2], *(keep(f"w{q}", "u") for q in (0, 1, 3)), *(rerole(f"w{q}", 2) for q in (0, 1, 3))],
        3: [bad[3], keep("w2", "a"), rerole("w2", 3)],
    }
    row = ", ".join(f"least({', '.join(w)}, NULL) AS x{q}" for q, w in ways.items())

    def closed(x: str) -> str:
        """Inserts, from the states ``x0`` to ``x3``."""
        user, assistant = "'\nuser:'", "'\nassistant:'"
        return f"{x}0 AS w0, {x}1 AS w1, least({x}2, {_edit(f'{x}0', 3, 'I', user)}, {_edit(f'{x}1', 3, 'I', user)}, {_edit(f'{x}3', 3, 'I', user)}) AS w2, {x}3 AS y3, {_edit('w2', 3, 'I', assistant)} AS y2, least(y3, y2) AS w3"

    crc = base_queries._CRC.replace("string_split(CAST(doc_id AS VARCHAR), '')", "string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')")
    assert "conv_id" in crc
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, {crc} % 20 AS c FROM conversations
), e AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE r END AS role, CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE c <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM e
), f AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o
), s AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), z AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, w0, w1, w2, w3 FROM (SELECT *, {closed("x")} FROM (SELECT conv_id, '00000000' || chr(1) AS x0, CAST(NULL AS VARCHAR) AS x1, CAST(NULL AS VARCHAR) AS x2, CAST(NULL AS VARCHAR) AS x3 FROM s))
  UNION ALL
  SELECT conv_id, i, w0, w1, w2, w3 FROM (SELECT conv_id, i, {closed("x")} FROM (SELECT z.conv_id, f.i, {row} FROM z JOIN f ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = z.i + 1))
), g AS (
  SELECT s.*, least(z.w0, z.w3) AS w FROM s JOIN z ON s.conv_id IS NOT DISTINCT FROM z.conv_id AND s.n = z.i
), k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(w, 8), '0') AS BIGINT) AS cost, coalesce(substr(w, 9, instr(w, chr(1)) - 9), '') AS audit, sha256(coalesce(substr(w, instr(w, chr(1)) + 2), '')) AS repaired_sha256
FROM k LEFT JOIN g ON k.conv_id IS NOT DISTINCT FROM g.conv_id
""".replace("\\n", "\n")


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": _JOIN_SQL, "op12_turn_repair": _repair_sql(), "op13_substring_dedup": _REPEATS_SQL} | base_queries.SQL
