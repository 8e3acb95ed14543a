"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papershed.llm import (
    chat_format, conversation_repair, decontaminate, html_extract, langid, line_dedup, packing, resample, sharding, simhash, sketch,
    token_store, toxicity,
)
from papershed.llm.common import shared_dir, stored, table, text_or_empty, unsigned_crc32
from papershed.llm.resampling_sql import LINES_SQL, REPAIR_SQL, RESAMPLING_SQL

N_SHARDS = 40
PACKING_END_ID, STORE_END_ID = 1, 2
BYTE_VOCABULARY = 50257


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def remainder(of: int):
    """crc32 of doc_id as text, modulo ``of``; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(0))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    filters = langid.fit(docs, remainder(4) == 2)
    return docs.select("doc_id", (remainder(4) == 2).alias("held_out"), langid.language(filters, F.col("text")).alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) == 0)
    scored = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), toxicity.toxicity(lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in as few sequences of 4096 tokens as the plan finds."""
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"), PACKING_END_ID)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a content-addressed store of ids and read back."""
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), STORE_END_ID)
    return token_store.read_digests(spark, path, BYTE_VOCABULARY)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by the law ``bytes``: slots dealt so that bytes come out near equal.

    A null text counts as empty, rows of one doc_id (or of none) share a virtual slot, repeated rows keep a row each,
    columns besides doc_id and text are ignored, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    text = text_or_empty()
    records = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            unsigned_crc32(text).alias("text_crc32"),
            sharding.virtual_slot(F.col("doc_id")).alias("virtual_slot"),
        )
    )
    path = f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    slot_map = sharding.write_map(sharding.make_map(sharding.slot_bytes(records), N_SHARDS), path)
    return sharding.place(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts."""
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = html_extract.main_text(html_extract.fit(pages), F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and number -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(probe)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after planted damage and its repair."""
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents, a quarter drawn towards the benchmark's distribution."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them share."""
    kept = line_dedup.without_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_html_text": op9_html_text,
    "op10_chat_format": op10_chat_format,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL = {
    "op3_decontamination": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (
          SELECT item_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
        dw AS (
          SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
        h AS (SELECT r, p, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
        n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
        m AS (SELECT r, count(DISTINCT item_id) AS n_items,
                     string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
    "op10_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
          SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS erole,
                 regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS etext,
                 row_number() OVER w AS rn, lag(role) OVER w AS prev
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(etext) + CASE WHEN prev IS NULL THEN 16 + length(erole)
                        WHEN prev = role THEN 8 ELSE 23 + length(erole) END) + 7 AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_conversation_repair": REPAIR_SQL,
    "op12_importance_resampling": RESAMPLING_SQL,
    "op13_line_dedup": LINES_SQL,
}
