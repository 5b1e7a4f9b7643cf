"""The queries over the corpus operators: each reads whole tables, applies its operator and derives digest columns."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, fitting, licences, lm, quality, rules, simhash, substring, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text", *more)


def _predictions(scored: DataFrame, modulus: int, held: int) -> DataFrame:
    held_out = (fitting.id_hash() % modulus == held).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(_documents(spark, sf_dir), carry=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_documents(spark, sf_dir), fitting.id_hash() % 7 != 2)
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score")]  # sums of doubles, whose last digits depend on their order
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *rounded)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    more = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.lit(record).alias("record"))
    turns = chat.turns(_read(spark, sf_dir, "conversations"), "conv_id").unionByName(chat.turns_of_records(more, "id", "record"))
    made = chat.render(turns)
    read = made.select("key", "formatted", chat.parse(F.col("formatted")).alias("turns"), F.array_join(chat.masked(F.col("formatted"), F.col("loss")), "").alias("lost"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("key").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, _read(spark, sf_dir, "labels"), 4, 2)
    return _predictions(quality.score(docs, model, carry=False), 4, 2)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), 3, 1)
    return _predictions(toxicity.score(docs, model, carry=False), 3, 1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply(_documents(spark, sf_dir, "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    read = bpe.encode(_documents(spark, sf_dir), path, carry=False, packed=True, decoded_to="decoded")  # both in one pass of Python
    return read.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_model, op3_chat, op4_decontamination, op5_quality_classifier, op6_licences, op7_toxicity, op8_quality_rules, op9_bpe, op10_simhash)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: What SQL can express: the rest depends on fitted models, a tokenizer or a hash that SQL lacks.
SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
judged AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) > 1 AS again FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM judged WHERE again),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_language_model": rf"""
WITH crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
held AS (SELECT r, doc_id, w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 2 AS held_out FROM d, crc),
tok AS (SELECT r, NOT held_out AS train, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM held),
g AS (SELECT r, train, p, w, coalesce(lag(w) OVER o, '  ') AS b, CASE WHEN p > 1 THEN coalesce(lag(w, 2) OVER o, '  ') END AS a FROM tok WINDOW o AS (PARTITION BY r ORDER BY p)),
g1 AS (SELECT w, CAST(count(*) AS DOUBLE) AS n FROM g WHERE train GROUP BY w),
g2 AS (SELECT b, w, CAST(count(*) AS DOUBLE) AS n FROM g WHERE train GROUP BY b, w),
g3 AS (SELECT a, b, w, CAST(count(*) AS DOUBLE) AS n FROM g WHERE train AND p > 1 GROUP BY a, b, w),
h2 AS (SELECT b, sum(n) AS t, count(*) AS f FROM g2 GROUP BY b),
h3 AS (SELECT a, b, sum(n) AS t, count(*) AS f FROM g3 GROUP BY a, b),
ones AS (SELECT 1 AS k, count(*) FILTER (n = 1) AS o, count(*) FILTER (n = 2) AS u FROM g1 UNION ALL SELECT 2, count(*) FILTER (n = 1), count(*) FILTER (n = 2) FROM g2 UNION ALL SELECT 3, count(*) FILTER (n = 1), count(*) FILTER (n = 2) FROM g3),
dd AS (SELECT max(CASE WHEN k = 1 THEN x END) AS d1, max(CASE WHEN k = 2 THEN x END) AS d2, max(CASE WHEN k = 3 THEN x END) AS d3 FROM (SELECT k, CASE WHEN o = 0 THEN 0.5 ELSE least(greatest(o / (o + 2.0 * u), 0.1), 0.95) END AS x FROM ones)),
tt AS (SELECT sum(n) AS total, CAST(count(*) AS DOUBLE) AS types FROM g1),
one AS (SELECT g.r, g.p, g.w, g.a, g.b, g1.n AS c, total, types, d2, d3, CASE WHEN g1.n > 0 THEN (g1.n - d1) / total ELSE d1 * types / total END AS p1 FROM g CROSS JOIN tt CROSS JOIN dd LEFT JOIN g1 ON g.w = g1.w),
two AS (SELECT one.*, CASE WHEN h2.t IS NULL THEN p1 ELSE greatest(coalesce(g2.n, 0) - d2, 0) / h2.t + d2 * h2.f / h2.t * p1 END AS p2 FROM one LEFT JOIN h2 ON one.b = h2.b LEFT JOIN g2 ON one.b = g2.b AND one.w = g2.w),
three AS (SELECT two.*, CASE WHEN h3.t IS NULL THEN p2 ELSE greatest(coalesce(g3.n, 0) - d3, 0) / h3.t + d3 * h3.f / h3.t * p2 END AS p3 FROM two LEFT JOIN h3 ON two.a = h3.a AND two.b = h3.b LEFT JOIN g3 ON two.a = g3.a AND two.b = g3.b AND two.w = g3.w)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM held JOIN (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(total) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (total + types + 1))), 6) AS base_score, round(sum(log10(p3)), 6) AS score FROM three GROUP BY r) USING (r)""",
    "op3_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '(<|\[)\\*(\||/?s>|/?INST\])')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item FROM places JOIN phrases USING (size, g)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN met USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
