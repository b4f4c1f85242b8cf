"""The flows that join the operators: search, download, enrich and scrape.

Each takes tables and gives tables. Sources are DataFrames of records (live
ones are read through ``sources.snapshot``), models and loaders are callables.
A source that can't be read is reported and leaves the others; only if none is
left does a flow fail.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import has_value
from ..operators import children, corpus, download, enrich, extract, resolve, search
from ..sources.mappers import MAPPERS
from ..sources.registry import resolve_names
from .filterstack import gate
from .storage import written


def read_sources(asks: dict[str, Callable[[], DataFrame]], wanted: list[str] | None, capability: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Records of the wanted sources, written as they are read, in the capability's order, and errors by source."""
    named = resolve_names(capability, wanted)
    chosen = {n: asks[n] for n in named if n in asks}
    return enrich.isolated({n: (lambda n=n, ask=ask: written(ask(), n)) for n, ask in chosen.items()})


def search_for_papers(asks: dict[str, Callable[[], DataFrame]], stored: DataFrame | None = None, *, wanted: list[str] | None = None, query: str = "", count: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Records ``(ingest_seq, record)`` of all sources as papers, resolved and merged with the stored ones.

    Stored papers keep their place; new ones follow in order of source, then of
    arrival. ``query`` and ``count`` narrow each source's records first.
    """
    records, errors = read_sources(asks, wanted, "search")
    frames = []
    for place, (name, rows) in enumerate(records.items(), 1):
        if "ingest_seq" not in rows.columns:
            rows = rows.withColumn("ingest_seq", F.monotonically_increasing_id())
        found = MAPPERS[name](rows)
        if query or count:
            found = search.scan_archive(found, search.Query.parse(query), count or 2**31 - 1)
        frames.append(corpus.normalize_papers(found.withColumn("ingest_seq", F.col("ingest_seq") + place * 2**48)))
    if stored is not None:
        frames.insert(0, corpus.normalize_papers(stored))
    if not frames:
        raise ValueError("no source could be read: " + "; ".join(f"{n}: {e}" for n, e in errors.items()))
    everything = written(reduce(DataFrame.unionByName, frames), "found")
    return resolve.merge_entities(resolve.resolve(everything)).withColumnRenamed("entity", "ingest_seq"), errors


def download_papers(papers: DataFrame, loaders: dict[str, dict[str, Callable[[dict], bytes | str | None]]], assets: DataFrame | None = None, *, force: bool = False, now: str = "") -> tuple[DataFrame, DataFrame]:
    """Contents for each role by its loaders in order, and papers with the roles' statuses.

    ``loaders[role][source]`` is asked for a row. Papers that have an asset of
    the role are not asked again. The second result holds
    ``paper_id, role, source, content, created_at``.
    """
    out, added = papers, []
    for role, by_source in loaders.items():
        todo = papers if assets is None else corpus.unfinished(papers, assets, role, force=force)
        order = [n for n in resolve_names(role) if n in by_source] + [n for n in by_source if n not in resolve_names(role)]
        got = written(download.download(todo, role, {n: by_source[n] for n in order}), f"{role}s")
        added.append(got.where("status = 'succeeded'").select("paper_id", F.lit(role).alias("role"), "source", "content", F.lit(now).alias("created_at")))
        state = got.select("paper_id", F.col("status").alias("__status"), F.col("source").alias("__source"), F.col("last_error").alias("__error"))
        out = out.join(state, "paper_id", "left")
        old = F.col(f"{role}_status") if f"{role}_status" in papers.columns else F.lit("pending")
        out = out.withColumn(f"{role}_status", F.coalesce("__status", old)).withColumn(f"{role}_source", F.coalesce(F.nullif("__source", F.lit("")), F.col(f"{role}_source") if f"{role}_source" in papers.columns else F.lit("")))
        errors = F.col("last_error") if "last_error" in out.columns else F.lit("")
        out = out.withColumn("last_error", F.when(has_value("__error"), F.concat_ws("; ", F.nullif(errors, F.lit("")), "__error")).otherwise(errors)).drop("__status", "__source", "__error")
    return out, reduce(DataFrame.unionByName, added)


def enrich_corpus(papers: DataFrame, asks: dict[str, Callable[[], DataFrame]], *, now: str, states: tuple[str, ...] = ("pending", "partial", "failed"), wanted: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Papers in one of the states with their providers' fields, all others as they were, and errors by provider."""
    fields, errors = read_sources(asks, wanted, "enrich")
    named = [n for n in resolve_names("enrich", wanted) if n in asks]
    full = papers.withColumns({c: F.lit("") if c not in corpus.ENRICHMENT_INTEGERS else F.lit(0) for c in corpus.ENRICHMENT if c not in papers.columns})
    todo = full.where(F.col("enrichment_status").isin(*states))
    done = enrich.enrich_papers(todo, fields, now=now, failed=tuple(errors), requested=named)
    rest = full.where(~F.col("enrichment_status").isin(*states))
    same = [F.col(c).cast(full.schema[c].dataType).alias(c) for c in full.columns]
    return done.select(same).unionByName(rest), errors


def write_children(stored: dict[str, DataFrame], works: DataFrame) -> dict[str, DataFrame]:
    """Authors, subjects and references of enriched papers in place of what is stored of them, by paper and source."""
    fresh = {"authors": children.authors(works), "subjects": children.openalex_subjects(works), "references": children.references(works)}
    return {n: resolve.replace_children(stored[n], rows) if n in stored else rows for n, rows in fresh.items()}


def scrape_papers(papers: DataFrame, recipe: extract.Recipe, model: Callable[[str], str], *, stored: DataFrame | None = None, evaluated: DataFrame | None = None, order: str = "corpus", count: int | None = None, limit: int = 32_000) -> tuple[DataFrame, DataFrame]:
    """Records of the papers that pass their filters, with those stored, and the papers with status and counts."""
    chosen = papers if evaluated is None else gate(papers, evaluated)
    if "text_scrape_status" in papers.columns:
        chosen = chosen.where("text_scrape_status <> 'succeeded'")
    chosen = search.select_papers(chosen, order, count)
    plan = extract.chunk_plan(chosen, limit=limit, prompt=recipe.prompt()).where("n_chunks > 0")
    answers = written(extract.ask_model(plan, recipe, model), "answers")  # each chunk is paid for once
    records = extract.store_results(stored, [extract.records_with_provenance(answers, papers, recipe)], recipe)
    state = extract.paper_status(answers).select("paper_id", F.col("status").alias("__status"), F.col("last_error").alias("__error"), F.col("num_text_materials").alias("__n"))
    fields = {"text_scrape_status": ("__status", "pending"), "last_error": ("__error", ""), "num_text_materials": ("__n", 0)}
    out = papers.join(state, "paper_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(new), F.col(c) if c in papers.columns else F.lit(default)) for c, (new, default) in fields.items()})
    return records, out.drop("__status", "__error", "__n")
