"""The queries of the training-data operators with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import anisotropic, bpe, histogram_sort, language, minhash, oracles, packing, quotes, secret_scan, segments, warc
from knotwork.llm.common import new_path, table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The id after the last of RANK_FILE, which marks the end of a document in a packed sequence.
END = 50_256


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read(spark, path)).withColumnRenamed("key", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return segments.top_k(rows, rows.filter("vec_id % 100 = 0"), k=10, scale=1024.0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN, decoded=True))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.sharded(table(spark, sf_dir, "documents"), n_shards=40)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.counted(table(spark, sf_dir, "documents"), RANK_FILE)


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_texts(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN, END)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op10_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return anisotropic.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": op1_warc_revisits,
        "op2_segment_topk": op2_segment_topk,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_minhash": op4_minhash,
        "op5_histogram_sort": op5_histogram_sort,
        "op6_secret_scan": op6_secret_scan,
        "op7_quotes": op7_quotes,
        "op8_best_fit": op8_best_fit,
        "op9_language": op9_language,
        "op10_anisotropic": op10_anisotropic,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": oracles.OP1,
        "op2_segment_topk": oracles.OP2,
        "op4_minhash": oracles.OP4,
        "op7_quotes": oracles.OP7,
    }
