"""The queries ``op<N>_<name>`` and, where SQL can say the same, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, staged, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens by source, language and tokenizer version, from committed batches.

    The totals come out of every kind of change, each over the whole table: two loads, a revision to another version
    of the word counter, a withdrawal of the documents with a source and their return, replays, and two folds.
    """
    from tidemark.llm.bpe import public_vocabulary
    from tidemark.llm.token_counts import TokenRollup, bpe_counts, deletes, inserts, revisions, word_counts

    docs = table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, fresh_path(spark, "token_counts"))
    # Counted once: the later batches read these counts, not the texts.
    words = staged(word_counts(docs, "words-0", r"\x20").unionByName(word_counts(docs)), "words")
    draft, final = words.where("tokenizer = 'words-0'"), words.where("tokenizer = 'words-1'")
    placed = final.where("source is not null")
    rollup.commit("load-words", inserts(draft))
    rollup.commit("load-bpe", inserts(bpe_counts(docs, public_vocabulary(spark), "byte_bpe_50k")))
    rollup.commit("words-1", revisions(draft, final))
    rollup.compact()
    rollup.commit("withdraw", deletes(placed))
    for _ in range(2):
        rollup.commit("return", inserts(placed))
        rollup.commit("load-words", inserts(draft))
    rollup.compact()
    return rollup.totals()


def token_counts_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of op1's word counter, which SQL can count too."""
    from tidemark.llm.token_counts import TokenRollup, deletes, inserts, revisions, word_counts

    counts = staged(word_counts(table(spark, sf_dir, "documents")), "words")
    rollup = TokenRollup(spark, fresh_path(spark, "token_counts"))
    rollup.commit("load", inserts(counts))
    rollup.commit("correct", revisions(counts, counts.withColumn("tokens", F.col("tokens") + 1)))
    rollup.compact()
    rollup.commit("put-back", revisions(counts.withColumn("tokens", F.col("tokens") + 1), counts))
    rollup.commit("withdraw", deletes(counts.where("lang = 'de'")))
    return rollup.totals()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item and the window that matches it."""
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of nearly equal bytes."""
    from tidemark.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and the component of near copies that they belong to."""
    from tidemark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity scores; the model learns from the labels outside the held-out fold."""
    from tidemark.llm.toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' quality scores; the model learns from the labels outside the held-out fold."""
    from tidemark.llm.quality import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token counts and the digests of their ids and of the bytes decoded from them."""
    from tidemark.llm.bpe import public_vocabulary, token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_vocabulary(spark))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives in the shared folder and read back from them."""
    from tidemark.llm.warc import page_summaries, read_archives, write_archives

    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return page_summaries(read_archives(spark, path))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of their group of equal texts."""
    from tidemark.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs judged by rule or, without one, by the boosted trees."""
    from tidemark.llm.urls import fit, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of all conversations."""
    from tidemark.llm.prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is full of control strings, formatted and read back from the output."""
    from tidemark.llm.chat import formatted, read_back, turn_digest

    given = table(spark, sf_dir, "conversations").select(F.struct("conv_id", F.lit(False).alias("planted")).alias("conv"), "turn", "role", "text")
    said = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    conv = F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(True).alias("planted")).alias("conv")
    planted = spark.range(1).select(conv, said.alias("s")).select("conv", "s.turn", "s.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = read_back(formatted(given.unionByName(planted), "conv"), "conv")
    return back.select(
        "conv.conv_id", F.size("turns").cast("long").alias("n_turns"), turn_digest(F.col("turns")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite embeddings, whitened by up to 16 components of the different ones."""
    from tidemark.llm.whitening import whitened_embeddings

    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: every URL's host, path and rule."""
    from tidemark.llm.urls import with_rules

    return with_rules(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "ruled")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_whitening": op13_whitening,
    "token_counts_by_words": token_counts_by_words,
    "url_rules": url_rules,
}

ORACLE_SQL = {
    "token_counts_by_words": r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS documents,
       CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS BIGINT) AS tokens
FROM documents WHERE lang IS DISTINCT FROM 'de' GROUP BY source, lang""",
    "url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(ruled, rule, own, prefix) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/'))
SELECT page_id, host, path, rule, ruled FROM p LEFT JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op8_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN first USING (h)""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
