"""The paper table: schema, normalised rows, content-addressed blobs, assets and statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import fallback_id
from ..functions.nulls import any_of, fill, has_value
from ..functions.textops import merge_lists

#: The columns of a paper, by family, and the values that statuses can have.
METADATA = "paper_id doi title journal publication_date authors sources core_id pdf_url pdf_source text_source abstract_source elsevier_link pmid pmcid arxiv_id medrxiv_doi biorxiv_doi chemrxiv_doi".split()
STATUSES = "metadata_status pdf_status text_status abstract_status image_status text_scrape_status abstract_scrape_status image_scrape_status enrichment_status".split()
PATHS = "text_path pdf_path image_dir last_error".split()
COUNTS = "num_images num_text_materials num_abstract_materials num_image_materials".split()
CHUNKS = "num_text_chunks num_abstract_chunks".split()
ENRICHMENT = "openalex_id publisher work_type volume issue pages issn issn_l language is_oa oa_status license is_retracted cited_by_count referenced_works_count enrichment_sources enrichment_json enriched_at".split()
ENRICHMENT_INTEGERS = {"is_oa", "is_retracted", "cited_by_count", "referenced_works_count"}
ENRICHMENT_STATES = ("pending", "succeeded", "partial", "not_found", "unresolved", "failed")
FILTER_STATES = ("included", "excluded", "unavailable")


def column_default(name: str) -> Column:
    if name in STATUSES:
        return F.lit("pending")
    if name in COUNTS or name in ENRICHMENT_INTEGERS:
        return F.lit(0).cast("long")
    if name in CHUNKS:
        return F.lit(None).cast("long")
    return F.lit("")


def is_integer(name: str) -> bool:
    return name in COUNTS or name in CHUNKS or name in ENRICHMENT_INTEGERS


def normalize_papers(rows: DataFrame) -> DataFrame:
    """All columns of a paper, missing values as defaults, and an id for every row; ``ingest_seq`` is kept."""
    have = set(rows.columns)
    out = []
    for name in [*METADATA, *STATUSES, *PATHS, *COUNTS, *CHUNKS]:
        if name not in have:
            out.append(column_default(name).alias(name))
        elif is_integer(name):
            out.append(F.coalesce(F.col(name).cast("long"), column_default(name)).alias(name))
        else:
            out.append(F.when(has_value(name), F.col(name).cast("string")).otherwise(column_default(name)).alias(name))
    extra = [F.col(c) for c in ("ingest_seq", "metadata_json") if c in have]
    full = rows.select(*out, *extra)
    ids = {c: F.col(c) for c in ("pmid", "arxiv_id", "medrxiv_doi", "biorxiv_doi", "chemrxiv_doi", "core_id")}
    own = fallback_id(F.col("title"), F.col("publication_date"), F.col("authors"), F.col("doi"), **ids)
    return full.withColumn("paper_id", F.when(has_value("paper_id"), F.col("paper_id")).otherwise(own))


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as papers: the first line is the title, the text the full text, the id the order of arrival."""
    line = F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    return documents.select(F.col("doc_id").cast("string").alias("paper_id"), F.col("doc_id").alias("ingest_seq"), line.alias("title"), F.col("text").alias("full_text"), F.col("source").alias("sources"))


def merge_column(name: str, current: Column, incoming: Column) -> Column:
    """The value that a stored paper keeps when another row of it arrives."""
    if name == "sources":
        return merge_lists(current, incoming)
    if is_integer(name):
        return F.when(F.coalesce(current, F.lit(0)) == 0, F.coalesce(incoming, current)).otherwise(current)
    if name in STATUSES:
        return F.when(~has_value(current) | (current == "pending"), F.when(has_value(incoming), incoming).otherwise(current)).otherwise(current)
    return fill(current, F.when(has_value(incoming), incoming).otherwise(current))


def upsert_papers(stored: DataFrame, incoming: DataFrame, key: str = "paper_id") -> DataFrame:
    """``stored`` with ``incoming`` (one row per key) written over it: new values win, ``created_at`` and enrichment stay."""
    kept = set(ENRICHMENT) | {"created_at", "enrichment_status"}
    s, i = stored.alias("s"), incoming.alias("i")
    out = []
    for c in stored.columns:
        old, new = F.col(f"s.{c}"), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
        if c == "metadata_json":
            out.append(F.when(F.col(f"i.{key}").isNull(), old).otherwise(F.coalesce(new, F.lit("{}"))).alias(c))
        else:
            out.append((F.coalesce(old, new) if c in kept or c not in incoming.columns else F.coalesce(new, old)).alias(c))
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer").select(*out)


def blobs(contents: DataFrame, content: str = "content") -> DataFrame:
    """One row per distinct content: ``sha256, blob_id, original_size, content``."""
    keyed = contents.where(F.col(content).isNotNull()).withColumn("sha256", F.sha2(F.col(content), 256))
    picked = keyed.groupBy("sha256").agg(F.first(content).alias("content"))  # all are equal
    return picked.select("sha256", F.concat(F.lit("blob:"), "sha256").alias("blob_id"), F.octet_length("content").alias("original_size"), "content")


def blob_summary(contents: DataFrame, content: str = "content", key: str = "paper_id") -> DataFrame:
    """One row per distinct content, without it: ``sha256, blob_id, original_size``, how many rows have it, and the first key."""
    keyed = contents.where(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("long").alias("n"), F.col(key).alias("key"))
    out = keyed.groupBy("sha256").agg(F.max("n").alias("original_size"), F.count("*").alias("papers"), F.min("key").alias("first"))
    return out.select("sha256", F.concat(F.lit("blob:"), "sha256").alias("blob_id"), "original_size", "papers", F.col("first").alias(f"first_{key}"))


def compressed(stored: DataFrame, content: str = "content", level: int = 6) -> DataFrame:
    """Add ``stored`` (gzip) and ``stored_size``; the built-ins have no gzip."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    at = stored.columns.index(content)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column(at).to_pylist():
                data = b"" if value is None else value.encode() if isinstance(value, str) else value
                coder = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed.append(coder.compress(data) + coder.flush())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array([len(p) for p in packed], pa.int64())], names=[*batch.schema.names, "stored", "stored_size"])

    return stored.mapInArrow(press, f"{fields}, stored binary, stored_size long")


def link_assets(links: DataFrame, added: DataFrame, key: tuple[str, ...] = ("paper_id", "role", "source", "original_filename"), order: str = "asset_seq") -> DataFrame:
    """Links with ``added`` over them: the latest row of each key stays."""
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return links.unionByName(added).withColumn("__n", latest).where("__n = 1").drop("__n")


def latest_assets(assets: DataFrame, keys: tuple[str, ...] = ("paper_id", "role"), order: tuple[str, ...] = ("created_at", "asset_seq")) -> DataFrame:
    """The newest asset of each paper and role."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return assets.withColumn("__n", newest).where("__n = 1").drop("__n")


def get_asset(assets: DataFrame, stored: DataFrame, paper: str, role: str, source: str | None = None) -> DataFrame:
    """The newest asset of one paper and role (and source), with its content; no row if there is none."""
    own = assets.where((F.col("paper_id") == paper) & (F.col("role") == role))
    if source is not None:
        own = own.where(F.col("source") == source)
    newest = own.orderBy(F.desc("created_at"), F.desc("asset_seq")).limit(1)
    return newest.join(stored.select("blob_id", "sha256", "original_size", "content"), "blob_id")


def corpus_stats(assets: DataFrame, stored: DataFrame) -> DataFrame:
    """Papers with an asset, distinct papers per role, blobs, and their sizes, in one row."""
    roles = ("abstract", "text", "pdf")
    links = assets.agg(F.countDistinct("paper_id").alias("papers"), F.count("*").alias("assets"), *(F.countDistinct(F.when(F.col("role") == r, F.col("paper_id"))).alias(f"{r}_papers") for r in roles))
    saved = F.when(F.sum("original_size") > 0, 1 - F.sum("stored_size") / F.sum("original_size")).otherwise(0.0)
    sizes = stored.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes"), saved.alias("savings"))
    return links.crossJoin(F.broadcast(sizes))  # one row each


def status_counts(rows: DataFrame, column: str, states: tuple[str, ...]) -> DataFrame:
    """Rows per state, with the states that don't occur."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(s,) for s in states], "status string")
    counts = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def set_enrichment_status(papers: DataFrame, changed: DataFrame, key: str = "paper_id") -> DataFrame:
    """``papers`` with the statuses of ``changed (key, enrichment_status)``; a status that isn't one fails the job."""
    states = F.array(*map(F.lit, ENRICHMENT_STATES))
    new = F.when(F.array_contains(states, F.col("enrichment_status")), F.col("enrichment_status")).otherwise(F.raise_error(F.concat(F.lit("not an enrichment status: "), F.coalesce("enrichment_status", F.lit("null")))))
    found = changed.select(key, new.alias("__new"))
    return papers.join(found, key, "left").withColumn("enrichment_status", F.coalesce("__new", "enrichment_status")).drop("__new")


def pipeline_status(papers: DataFrame) -> DataFrame:
    """Papers, those with each kind of content and of finished work, and the sums of extracted records, in one row."""
    has = {"with_doi": has_value("doi"), **{f"with_{k}": F.col(f"{k}_status") == "succeeded" for k in ("abstract", "text", "pdf", "image")}}
    done = {f"{k}_scraped": F.col(f"{k}_scrape_status") == "succeeded" for k in ("abstract", "text", "image")}
    failed = any_of([F.col(c) == "failed" for c in STATUSES if c in papers.columns])
    counts = {**has, **done, "enriched": F.col("enrichment_status").isin("succeeded", "partial"), "failed": failed}
    sums = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("num_text_materials", "num_abstract_materials")]
    return papers.agg(F.count("*").alias("papers"), *(F.count_if(c).alias(n) for n, c in counts.items()), *sums)


def run_summary(results: DataFrame, status: str = "status", states: tuple[str, ...] = ("succeeded", "failed")) -> DataFrame:
    """How many items a run left in each state, those of no item too."""
    return status_counts(results, status, states)


def children(rows: DataFrame, paper: str, order: str = "position", **only: str) -> DataFrame:
    """One paper's rows of a child table, some of them (by ``scheme`` or ``source``), in order."""
    own = rows.where(F.col("paper_id") == paper)
    for column, value in only.items():
        own = own.where(F.col(column) == value)
    return own.orderBy(order)


def enrichment_candidates(papers: DataFrame, states: list[str], *, after: int = 0, limit: int = 100, refreshed_before: str = "", seq: str = "ingest_seq") -> DataFrame:
    """The next rows in order of arrival that have one of the states, or are stale successes."""
    wanted = F.col("enrichment_status").isin(states)
    if refreshed_before:
        wanted = wanted | ((F.col("enrichment_status") == "succeeded") & has_value("enriched_at") & (F.col("enriched_at") < refreshed_before))
    return papers.where((F.col(seq) > after) & wanted).orderBy(seq).limit(limit)


def violations(papers: DataFrame) -> DataFrame:
    """Rows that break a constraint: no id, an unknown enrichment status, or a flag other than 0 and 1."""
    bad = [~has_value("paper_id")]
    if "enrichment_status" in papers.columns:
        bad.append(~F.col("enrichment_status").isin(*ENRICHMENT_STATES))
    bad += [~F.col(c).isin(0, 1) for c in ("is_oa", "is_retracted") if c in papers.columns]
    return papers.where(any_of(bad))


def reset_pipeline(papers: DataFrame) -> DataFrame:
    """All pipeline columns at their defaults, metadata as retrieved."""
    fresh = {c: column_default(c) for c in [*STATUSES, *PATHS, *COUNTS, *CHUNKS] if c in papers.columns}
    if "metadata_status" in fresh:
        fresh["metadata_status"] = F.lit("retrieved")
    return papers.withColumns(fresh)


def unfinished(papers: DataFrame, assets: DataFrame, role: str, *, force: bool = False) -> DataFrame:
    """Papers without an asset of the role, or all with ``force``."""
    return papers if force else papers.join(assets.where(F.col("role") == role).select("paper_id"), "paper_id", "left_anti")
