"""The operators over the given tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from embgauge.llm import ann, decontaminate, html_extract, line_dedup, ngram_join, packing, phrases, piece_bpe, secrets
from embgauge.llm import sharding, sql, suffix_dedup, token_align, toxicity

SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 2039
CATEGORIES = ("junk", "toxic")


def model_path() -> str:
    """The tokenizer's file: ``LLM_PIECE_MODEL``, or the one of the installed public tokenizers."""
    if named := os.environ.get("LLM_PIECE_MODEL"):
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_bpe_path() -> str:
    """The byte-level tokenizer's file: ``LLM_BYTE_BPE``, or the one of the installed public tokenizers."""
    if named := os.environ.get("LLM_BYTE_BPE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf):
    found = ngram_join.jaccard_components(table(spark, sf, "documents"), n=4, num=85, den=100)
    return found.withColumnRenamed("id", "doc_id")


def category_labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


def op2_toxicity_chain(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, category_labels(spark, sf), list(CATEGORIES))
    scores = toxicity.score(docs, model)
    rejected = F.col("p_toxic") >= model.cuts[1]
    return scores.select(F.col("id").alias("doc_id"), "p_junk", "p_toxic", rejected.alias("rejected"))


def op3_decontamination(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", items, "contaminated"
    )


def op4_sharding(spark, sf):
    placed = sharding.place(table(spark, sf, "documents").select("doc_id"), SHARDS, "doc_id", SLOTS)
    return placed.select("doc_id", "slot", "shard")


def op5_secret_scan(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans",
        "n_copied", "n_live",
    )


def op6_sentencepiece(spark, sf):
    found = piece_bpe.round_trip(table(spark, sf, "documents"), model_path())
    return found.withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark, sf):
    found = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("line_count").cast("long").alias("n_lines"),
        F.col("lines_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_ann(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_suffix_array_dedup(spark, sf):
    columns = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents"), columns=columns)
    return found.withColumnRenamed("id", "doc_id")


def op10_html_extraction(spark, sf):
    found = html_extract.main_text(table(spark, sf, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_phrase_collocations(spark, sf):
    # a file's rows stay in one shard, so that tasks add up before they send
    return phrases.collocations(table(spark, sf, "documents"), shard=F.input_file_name())


def op12_packing(spark, sf):
    found = packing.pack(table(spark, sf, "documents"), byte_bpe_path())
    return found.withColumnRenamed("id", "doc_id")


def op13_token_alignment(spark, sf):
    found = token_align.align(table(spark, sf, "documents"), byte_bpe_path(), model_path())
    return found.withColumnRenamed("id", "doc_id")


def queries():
    import corpus_pipeline

    named = [
        op1_ngram_jaccard_join, op2_toxicity_chain, op3_decontamination, op4_sharding, op5_secret_scan,
        op6_sentencepiece, op7_line_dedup, op8_ann, op9_suffix_array_dedup, op10_html_extraction,
        op11_phrase_collocations, op12_packing, op13_token_alignment,
    ]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": sql.OP1,
        "op3_decontamination": sql.OP3,
        "op4_sharding": sql.op4(SHARDS, SLOTS),
        "op5_secret_scan": sql.op5(secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.LOOSE, secrets.ASSIGN_LEAST, 3),
        "op7_line_dedup": sql.OP7,
        "op11_phrase_collocations": sql.OP11,
    }
