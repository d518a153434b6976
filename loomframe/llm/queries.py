"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, extraction, jaccard, langid, linedup, packing, quality, secretscan, urls
from .common import code_points, table

Query = Callable[[SparkSession, str], DataFrame]

#: A conversation of control strings.
_ODD = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
#: The url rules of the query.
URL_RULES = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]


def sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(_ODD, "conv_id long, turn long, role string, text string"))
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), F.lit("message").alias("kind"), "role", "text")
    out = chat.format_chats(events)
    read = out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("masked"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"),
        code_points(F.col("masked")).alias("loss_chars"), sha(F.col("masked")).alias("loss_sha256"), code_points(F.col("formatted")).alias("formatted_chars"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def held_out() -> F.Column:
    """Whether a row's language is not learned from; the text of a null id is empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.learn(docs, ~held_out())
    return langid.identify(docs.select("doc_id", "text"), known).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def tokenizer() -> dict[str, str | None]:
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).documents


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", code_points(F.col("text")).alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secretscan.scan(docs)
    out = secretscan.digests(docs, ledger.findings)
    return out.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", sha(F.col("base_spans")).alias("base_sha256"), "spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("n_removed_words", "removed_lines")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_url_filters, op3_language_id, op4_best_fit_packing, op5_jaccard_join, op6_html_extraction, op7_line_dedup, op8_secret_scans, op9_quality_rules, op10_decontamination)}
