"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; :func:`run` writes each result as Parquet and rereads it for the next.
All stages but the last return the columns of ``documents``. Stages learn from
rows of ``documents`` that reach them; labels come from ``sf_dir``.

Repeated ids count as one document written more than once: near-dedup keeps
one of its rows. Rows without an id pass the filters on their texts and are
otherwise left as they are. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import id_crc, table, written

#: SQL can't express trained models, so the stages are tested against plain Python versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.5 or more."""
    from quillmill.llm.toxicity import fit_toxicity, score_toxicity

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs.where(id_crc() % 5 != 0), labels)
    return score_toxicity(docs, model, keep=docs.columns).where("score < 0.5").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those on which the languages tie."""
    from quillmill.llm.langid import fit_languages, identify

    model = fit_languages(docs.where(id_crc() % 5 != 0))
    return identify(docs, model, keep=docs.columns).where("not rejected").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five words, similarity 0.8."""
    from quillmill.llm.minhash import near_duplicates

    gone = near_duplicates(docs, width=5, threshold=80).where("not kept").select("doc_id").distinct()
    named, rest = docs.where("doc_id is not null"), docs.where("doc_id is null")  # the latter are linked with nothing
    left = named.join(gone, "doc_id", "left_anti").select(docs.columns)
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce("text", F.lit("")))
        left = left.groupBy(F.col("doc_id").alias("__id")).agg(row.alias("__row")).select("__row.*")
    return left.unionByName(rest)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words that occur earlier; a text that loses none stays as it is."""
    from quillmill.llm.substring import remove_repeats

    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = remove_repeats(docs, size=20).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    from quillmill.llm.packing import pack_documents
    from quillmill.llm.queries import byte_bpe

    return pack_documents(docs, capacity=2048, separator=0, **byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
