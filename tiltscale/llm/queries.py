"""Registered queries over the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, lm_score, packing, pieces, prefix_trie, quality, shards, simhash, token_files, toxicity, wordpiece
from .shared import materialize, read

SHARDS = 8


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, path = public_tokenizers.path("byte_bpe_50k.json"), token_files.corpus_dir(spark)
    index = token_files.token_files(read(spark, sf_dir, "documents"), path, tokenizer, end_id=0)
    return token_files.read_ids(index, path, tokenizer)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size(decontam.hit_words(F.col("spans"))).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation with the first turns of that whose id is the next lower multiple of five in place of its own."""
    first = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    heads = paths.where("conv_id % 5 = 0").select(F.col("conv_id").alias("head_id"), F.slice("path", 1, 8).alias("head"))
    both = paths.withColumn("head_id", F.expr("conv_id - conv_id % 5")).join(heads, "head_id", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), first)).otherwise(F.slice("path", 1, 0))
    rest = F.slice("path", first + 1, F.size("path"))
    return both.select("conv_id", F.when(F.col("conv_id").isNull(), F.col("path")).otherwise(F.concat(head, rest)).alias("path"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = materialize(prefix_trie.paths(read(spark, sf_dir, "conversations")), "paths")
    nodes = prefix_trie.with_digests(prefix_trie.trie(_rebuilt(paths)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, path = public_tokenizers.path("byte_bpe_50k.json"), packing.sequence_dir(spark)
    index = packing.pack(read(spark, sf_dir, "documents"), path, tokenizer)
    return packing.read_pieces(index, path, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align.align(read(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_lm_score": op2_lm_score,
    "op3_simhash_bktree": op3_simhash_bktree,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}

_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS coded,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS coded_role
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(coded + CASE WHEN prev = role THEN 6 ELSE 13 + coded_role END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS t FROM d, unnest(range(1, len(w) - 3)) AS x(i)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, t) > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), line AS (
  SELECT r, doc_id, host, text, array_to_string(regexp_extract_all({_LOWER.format('x')}, '[^\x20\x09-\x0D]+'), ' ') AS line FROM (SELECT r, doc_id, host, text, unnest(lines) AS x FROM d)
), limits AS (
  SELECT host, count(DISTINCT {{'i': doc_id, 't': text}}) * {quality.MAX_SHARE} AS lim FROM d GROUP BY host
), frequent AS (
  SELECT host, line FROM line JOIN limits USING (host) GROUP BY host, line
  HAVING count(DISTINCT {{'i': doc_id, 't': text}}) > any_value(lim) AND count(DISTINCT text) > {quality.MIN_TEXTS}
    OR len(string_split(line, ' ')) >= {quality.LONG_WORDS} AND count(DISTINCT text) > {quality.LONG_TEXTS}
), removed AS (
  SELECT r, sum(len(string_split(line, ' '))) AS removed_words FROM line JOIN frequent USING (host, line) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)
)
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words) AND NOT n_words - removed_words < {quality.KEEP_SHARE} * n_words AS kept
FROM m
"""

_OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, least({decontam.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS x(i)
), dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS x(i)
), h AS (
  SELECT r, i, dw.n, item FROM dw JOIN bw USING (n, t)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: Unsigned CRC-32 of a text of ASCII characters, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))))"""

_OP11 = f"""
WITH t AS (
  SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations
), own AS (
  SELECT c, list(x ORDER BY i) AS own, {_CRC32.format('c::VARCHAR')} % 9 AS h FROM t GROUP BY c
), rebuilt AS (
  SELECT a.c, CASE WHEN a.c IS NULL THEN a.own ELSE list_concat(coalesce(b.own, [])[:a.h], a.own[a.h + 1:]) END AS path
  FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5
), members AS (
  SELECT c, path[:d] AS path, d, len(path) = d AS ends FROM rebuilt, unnest(range(len(path) + 1)) AS u(d)
), nodes AS (
  SELECT path, d, CASE WHEN bool_or(c IS NULL) THEN NULL ELSE min(c) END AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(coalesce(c::VARCHAR, 'null'), ',' ORDER BY c NULLS FIRST) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, d
), children AS (
  SELECT path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[-1].text) END AS saved FROM nodes LEFT JOIN children USING (path)
), subtrees AS (
  SELECT path[:u.e] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM counted, unnest(range(d + 1)) AS u(e) GROUP BY 1
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
FROM counted a JOIN subtrees USING (path) LEFT JOIN nodes p ON a.d > 0 AND p.path = a.path[:a.d - 1]
"""

ORACLES: dict[str, str] = {"op5_quality_rules": _OP5, "op6_decontamination": _OP6, "op9_chat_format": _OP9, "op11_prefix_trie": _OP11}
