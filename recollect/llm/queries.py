"""Registered queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from recollect.llm import chat_format as cf
from recollect.llm import collocations
from recollect.llm import decontamination as dc
from recollect.llm import html_main_text, jaccard_join
from recollect.llm import metric_search as ms
from recollect.llm import oracle, periodic_runs, piece_sampling, quality, substring_dedup, suffix_dedup
from recollect.llm import token_counts as tc
from recollect.llm import token_files as tf
from recollect.session import work_dir

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    found = dc.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op3_metric_search(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", ms.quantised(F.col("embedding")).alias("vector"))
    return ms.top_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_html_main_text(spark, sf_dir):
    found = html_main_text.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_piece_sampling(spark, sf_dir):
    model = public_tokenizers.path(PIECES)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = piece_sampling.with_sampled_pieces(docs, model, checked="lossless")
    return pieces.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), "lossless")


def op7_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tc.token_counts(docs, public_tokenizers.path(WORD_BPE), work_dir(spark, "token-counts"), normalise=tc.collapsed_space, by_word=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_quality(docs, quality.train(docs, labels=_table(spark, sf_dir, "labels"))).select("doc_id", "junk_score", "abuse_score", "keep")


def op9_token_files(spark, sf_dir):
    path = work_dir(spark, "token-files")
    tf.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 2, path)
    return tf.crc32(tf.read_token_files(spark, path))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(substring_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _with_periods(docs):
    """A tenth of the documents, by the checksum of their id, repeats a period of its own from some word on."""
    check = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(check / 10), F.size("w")
    first = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - first) / (3 + g % 8))
    periodic = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    words = F.when(check % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    planned = docs.select("doc_id", "text", words.alias("w")).withColumn("a", first).withColumn("p", period)
    text = F.when(F.size("w") > 0, F.array_join(F.transform("w", periodic), " ")).otherwise(F.col("text"))
    return planned.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark, sf_dir):
    docs = _with_periods(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.with_runs(docs))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_chat_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = cf.format_turns(rows.unionByName(said), parts=cf.text_parts(F.col("text")))
    return cf.digests(cf.format_conversations(turns)).withColumnRenamed("conv", "conv_id")


QUERIES = {
    "op1_decontamination": (op1_decontamination, oracle.OP1),
    "op2_jaccard_join": (op2_jaccard_join, oracle.OP2),
    "op3_metric_search": (op3_metric_search, oracle.OP3),
    "op4_html_main_text": (op4_html_main_text, None),
    "op5_suffix_dedup": (op5_suffix_dedup, oracle.OP5),
    "op6_piece_sampling": (op6_piece_sampling, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_quality": (op8_quality, None),
    "op9_token_files": (op9_token_files, None),
    "op10_substring_dedup": (op10_substring_dedup, oracle.OP10),
    "op11_collocations": (op11_collocations, oracle.OP11),
    "op12_chat_format": (op12_chat_format, oracle.OP12),
    "op13_periodic_runs": (op13_periodic_runs, oracle.OP13),
}
