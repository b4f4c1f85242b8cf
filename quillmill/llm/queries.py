"""One query per corpus operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, table
from .oracles import ORACLES  # noqa: F401  the driver reads it beside QUERIES


def byte_bpe() -> dict:
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, separator=0, **byte_bpe())


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=85)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import DIGESTS, digest, encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), then=digest, schema=DIGESTS)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of documents serve as those of the pages with the same number: no table labels pages themselves."""
    from .urlfilter import Rule, judge_urls

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rules = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]
    return judge_urls(table(spark, sf_dir, "pages"), labels, rules)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, size=20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, media_rows

    return media_features(media_rows(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify

    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc() % 5 == 0)
    model = fit_languages(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc() % 5 == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs.where(~F.col("held_out")), labels)
    return score_toxicity(docs, model, keep=["held_out"]).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_bpe_transducer": op4_bpe_transducer,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_hmm_scoring": op7_hmm_scoring,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
}
