"""Enrichment: fields of several providers under one precedence, and exploded child tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import arxiv_id, date_parts_text, match_doi, orcid, pmcid, pmid, position_label, short_openalex_id
from ..functions.nulls import any_of, first_value, has_value, nz

#: Providers in order of precedence, and the columns that each rule covers.
PROVIDERS = ("crossref", "openalex", "pubmed", "arxiv", "medrxiv", "biorxiv", "chemrxiv")
PREPRINTS = ("arxiv", "medrxiv", "biorxiv", "chemrxiv")
SHARED = "doi title journal publication_date authors pmid pmcid arxiv_id medrxiv_doi biorxiv_doi chemrxiv_doi publisher work_type volume issue pages issn language".split()
OPENALEX = "openalex_id issn_l oa_status license".split()
PRESERVED = "publisher work_type volume issue pages issn language openalex_id issn_l is_oa oa_status license cited_by_count referenced_works_count is_retracted".split()


def lookup_keys(papers: DataFrame) -> DataFrame:
    """Papers with ``lookup_doi``, the key by which providers are asked, and whether there is any."""
    any_key = any_of([match_doi("doi") != "", *(has_value(c) for c in ("openalex_id", "pmid", "arxiv_id") if c in papers.columns)])
    return papers.withColumn("lookup_doi", F.nullif(match_doi("doi"), F.lit(""))).withColumn("resolvable", any_key)


def assemble(papers: DataFrame, records: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Left join each provider's records (one per key) as a struct column of the provider's name."""
    for name, rows in records.items():
        key = keys[name]
        unique = rows.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*rows.columns)).alias(name))
        papers = papers.join(unique, F.nullif(F.col(key), F.lit("")) == F.col("__key"), "left").drop("__key")
    return papers


def _field(frame: DataFrame, provider: str, name: str) -> Column | None:
    if provider not in frame.columns or name not in frame.schema[provider].dataType.fieldNames():
        return None
    return F.col(provider)[name]


def merge_fields(assembled: DataFrame, requested: list[str], errors: Column | None = None) -> DataFrame:
    """Provider structs reduced to one set of columns; the papers' own columns of these names are replaced.

    The first provider, in order, that has a value gives it. Open access
    columns are OpenAlex's, with preprint servers filling its gaps.
    """

    def values(name: str, order=PROVIDERS) -> list[Column]:
        return [c for p in order if (c := _field(assembled, p, name)) is not None]

    def flag(name: str, order=PROVIDERS) -> Column:
        return F.coalesce(any_of([F.coalesce(c.cast("boolean"), F.lit(False)) for c in values(name, order)]), F.lit(False)).cast("int")

    out = {c: first_value(*values(c)) if values(c) else F.lit("") for c in SHARED}
    out |= {c: first_value(*values(c, ("openalex",))) if values(c, ("openalex",)) else F.lit("") for c in OPENALEX}
    out["oa_status"] = first_value(out["oa_status"], *values("oa_status", PREPRINTS))
    out["license"] = first_value(out["license"], *values("license", PREPRINTS[1:]))
    counts = [F.nullif(c.cast("long"), F.lit(0)) for c in values("referenced_works_count", ("openalex", "crossref"))]
    out["referenced_works_count"] = F.coalesce(*counts, F.lit(0))
    out["cited_by_count"] = F.coalesce(*[c.cast("long") for c in values("cited_by_count", ("openalex",))], F.lit(0))
    out["is_retracted"] = flag("is_retracted", ("crossref", "openalex"))
    out["is_oa"] = flag("is_oa", ("openalex", *PREPRINTS))
    present = [p for p in PROVIDERS if p in assembled.columns]
    found = F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), p) for p in present)))
    failed = F.coalesce(errors, F.lit(False)) if errors is not None else F.lit(False)
    n = F.size(found)
    out["enrichment_sources"] = F.array_join(found, ";")
    out["enrichment_status"] = F.when((n == 0) & failed, "failed").when(n == 0, "not_found").when(n == len(requested), "succeeded").otherwise("partial")
    out["enrichment_json"] = F.to_json(F.struct(*(F.col(p) for p in sorted(present))))
    return assembled.withColumns(out).drop(*present)


def preserve(fresh: DataFrame, stored: DataFrame, failed: Column, key: str = "paper_id") -> DataFrame:
    """Keep stored values where a provider failed and the fresh one is missing or 0."""
    names = [c for c in PRESERVED if c in fresh.columns and c in stored.columns]
    old = stored.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in names))
    joined = fresh.join(old, key, "left")

    def empty(c: Column) -> Column:
        return ~has_value(c) | (c.cast("string") == "0")

    kept = {c: F.when(failed & empty(F.col(c)) & ~empty(F.col(f"__{c}")), F.col(f"__{c}")).otherwise(F.col(c)) for c in names}
    return joined.withColumns(kept).select(fresh.columns)


# --- provider records to shared fields


def crossref_fields(messages: DataFrame) -> DataFrame:
    """Crossref messages (nested) as shared fields; list columns give their first value."""
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    names = F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    retracted = F.exists(F.coalesce("update-to", F.array()), lambda u: F.lower(u["type"]) == "retraction") if "update-to" in messages.columns else F.lit(False)
    return messages.select(
        match_doi("DOI").alias("doi"), first("title").alias("title"), first("container-title").alias("journal"), date_parts_text(F.col("issued.date-parts")).alias("publication_date"),
        F.array_join(F.filter(names, lambda n: n != ""), "; ").alias("authors"), "publisher", F.col("type").alias("work_type"), "volume", "issue", first_value("page", "article-number").alias("pages"),
        F.array_join(F.array_distinct("ISSN"), ";").alias("issn"), "language", F.col("references-count").cast("long").alias("referenced_works_count"), retracted.alias("is_retracted"),
    )


def openalex_fields(works: DataFrame) -> DataFrame:
    place = F.col("primary_location.source")
    ids = lambda pattern, c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, 0)
    pages = F.col("biblio.first_page"), F.col("biblio.last_page")
    return works.select(
        match_doi("doi").alias("doi"), F.coalesce("title", F.lit("")).alias("title"), place["display_name"].alias("journal"), "publication_date",
        F.array_join(F.transform("authorships", lambda a: a["author"]["display_name"]), "; ").alias("authors"), ids(r"\d+$", "ids.pmid").alias("pmid"), short_openalex_id("id").alias("openalex_id"),
        F.col("type").alias("work_type"), F.col("biblio.volume").alias("volume"), F.col("biblio.issue").alias("issue"), F.concat_ws("-", *(nz(p) for p in pages)).alias("pages"),
        F.array_join(F.coalesce(place["issn"], F.array().cast("array<string>")), ";").alias("issn"), place["issn_l"].alias("issn_l"), "language", F.col("open_access.is_oa").alias("is_oa"),
        F.col("open_access.oa_status").alias("oa_status"), F.col("primary_location.license").alias("license"), "is_retracted", "cited_by_count", "referenced_works_count",
    )


def record_fields(rows: DataFrame, provider: str) -> DataFrame:
    """Papers of a mapper in ``sources.mappers`` (PubMed and the preprint servers) as shared fields.

    A preprint that names its published version describes that version, so it
    has no work type of its own. Preprints are free to read.
    """
    shared = [first_value(c).alias(c) for c in ("title", "journal", "publication_date", "authors")]
    if provider == "pubmed":
        kind = F.coalesce(F.get("publication_types", F.lit(0))["name"], F.lit(""))
        return rows.select(match_doi("doi").alias("doi"), *shared, pmid("pmid").alias("pmid"), pmcid("pmcid").alias("pmcid"), kind.alias("work_type"))
    own = "arxiv_id" if provider == "arxiv" else f"{provider}_doi"
    published = match_doi("published_doi")
    doi = match_doi("doi") if provider == "arxiv" else F.when(published != "", published).otherwise(match_doi(own))
    license = [] if provider == "arxiv" else [first_value("license").alias("license")]
    number = arxiv_id(own) if provider == "arxiv" else match_doi(own)
    return rows.select(doi.alias("doi"), *shared, number.alias(own), F.when(published != "", "").otherwise("preprint").alias("work_type"), *license, F.lit(True).alias("is_oa"), F.lit("green").alias("oa_status"))


#: The column by which each provider is asked, and the prefix of a paper's id that can stand for it.
LOOKUP = {"crossref": ("doi", ""), "openalex": ("openalex_id", "openalex:"), "pubmed": ("pmid", "pmid:"), "arxiv": ("arxiv_id", "arxiv:"), "medrxiv": ("medrxiv_doi", "medrxiv:"), "biorxiv": ("biorxiv_doi", "biorxiv:"), "chemrxiv": ("chemrxiv_doi", "chemrxiv:")}
_CLEANERS = {"doi": match_doi, "openalex_id": short_openalex_id, "pmid": pmid, "arxiv_id": arxiv_id}


def lookup_key(papers: DataFrame, provider: str) -> Column:
    """What a paper is looked up by: its own column, else what follows the prefix of its id; null if neither."""
    column, prefix = LOOKUP[provider]
    clean = _CLEANERS.get(column, match_doi)
    parts = [F.nullif(clean(column), F.lit(""))] if column in papers.columns else []
    if prefix:
        parts.append(F.when(F.col("paper_id").startswith(prefix), F.nullif(clean(F.substr("paper_id", F.lit(len(prefix) + 1))), F.lit(""))))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def partition_candidates(papers: DataFrame, seq: str = "ingest_seq") -> tuple[dict[str, DataFrame], DataFrame]:
    """``(key, paper_id)`` for each provider, and the ids of papers that neither a DOI nor an OpenAlex id names.

    A DOI goes before an OpenAlex id. Of papers with the same key the last one
    to arrive is the one that is asked for.
    """
    papers = papers.where(has_value("paper_id"))
    doi, work = lookup_key(papers, "crossref"), lookup_key(papers, "openalex")
    keys = {"crossref": doi, "openalex_doi": doi, "openalex": F.when(doi.isNull(), work)}
    keys |= {p: lookup_key(papers, p) for p in LOOKUP if p not in keys}
    found = {p: papers.select(k.alias("key"), "paper_id", F.col(seq).alias("__seq")).where("key is not null").groupBy("key").agg(F.max_by("paper_id", "__seq").alias("paper_id")) for p, k in keys.items()}
    return found, papers.where(doi.isNull() & work.isNull()).select("paper_id")


def enrich_papers(papers: DataFrame, records: dict[str, DataFrame], *, now: str, failed: tuple[str, ...] = (), requested: list[str] | None = None, seq: str = "ingest_seq") -> DataFrame:
    """Papers with the merged fields of their providers' records, status, sources and provenance.

    ``records`` has shared fields per provider, one row per key (or more: the
    largest counts), under the provider's own column (:data:`LOOKUP`; OpenAlex
    by DOI where there is one). ``failed`` names providers that could not be
    asked: papers without any record are then failed rather than not found, and
    stored values stay where a fresh one is missing. Papers that no provider
    can look up are unresolved.
    """
    asked = requested or [*records, *(p for p in failed if p not in records)]
    rows = papers.withColumn("resolvable", F.lit(False))
    keys = {}
    for p in PROVIDERS:
        if p in records:
            rows = rows.withColumn(f"__{p}", lookup_key(papers, p))
            keys[p] = f"__{p}"
    if "openalex" in records:
        rows = rows.withColumn("__openalex_doi", lookup_key(papers, "crossref"))
    can = [lookup_key(papers, p).isNotNull() for p in asked] + ([lookup_key(papers, "crossref").isNotNull()] if "openalex" in asked else [])
    rows = rows.withColumn("resolvable", any_of(can))
    for p, key in keys.items():
        fresh, column = records[p], LOOKUP[p][0]
        one = fresh.groupBy(F.col(column).alias("__key")).agg(F.max(F.struct(*fresh.columns)).alias(p)).where(has_value("__key"))
        rows = rows.join(one, F.col(key) == F.col("__key"), "left").drop("__key")
        if p == "openalex" and "doi" in fresh.columns:
            by_doi = fresh.groupBy(F.col("doi").alias("__key")).agg(F.max(F.struct(*fresh.columns)).alias("__by_doi")).where(has_value("__key"))
            rows = rows.join(by_doi, F.col("__openalex_doi") == F.col("__key"), "left").withColumn(p, F.coalesce("__by_doi", p)).drop("__key", "__by_doi")
    merged = merge_fields(rows.drop(*(c for c in rows.columns if c.startswith("__"))), asked, F.lit(bool(failed)))
    kept = [c for c in papers.columns if c in SHARED and c in merged.columns]
    old = papers.select(F.col("paper_id"), *(F.col(c).alias(f"__{c}") for c in kept))
    out = merged.join(old, "paper_id").withColumns({c: first_value(f"__{c}", c) for c in kept}).drop(*(f"__{c}" for c in kept))  # what a paper has is not overwritten
    out = preserve(out, papers, F.lit(bool(failed)))
    out = out.withColumn("enrichment_status", F.when(~F.col("resolvable"), "unresolved").otherwise(F.col("enrichment_status"))).drop("resolvable")
    return out.withColumn("enriched_at", F.when(F.col("enrichment_status").isin("succeeded", "partial"), now).otherwise(F.col("enriched_at") if "enriched_at" in papers.columns else F.lit("")))


# --- children


def author_rows(works: DataFrame, paper: str = "paper_id", source: str = "openalex") -> DataFrame:
    """One row per author and affiliation (one with empty affiliation if there is none), positions from 1."""
    people = works.select(paper, F.size("authorships").alias("__n"), F.posexplode("authorships").alias("__i", "a"))
    place = F.posexplode_outer("a.institutions").alias("__j", "org")
    rows = people.select(paper, "__n", (F.col("__i") + 1).alias("position"), "a", place)
    return rows.select(
        paper, F.lit(source).alias("source"), "position", position_label(F.col("position"), F.col("__n")).alias("position_label"), F.coalesce("a.author.display_name", F.lit("")).alias("name"),
        orcid("a.author.orcid").alias("orcid"), short_openalex_id("a.author.id").alias("author_id"), F.coalesce("a.is_corresponding", F.lit(False)).cast("int").alias("is_corresponding"),
        (F.coalesce("__j", F.lit(0)) + 1).alias("affiliation_rank"), F.coalesce("org.display_name", F.lit("")).alias("affiliation"), F.coalesce("org.ror", F.lit("")).alias("ror"), F.coalesce("org.country_code", F.lit("")).alias("country"),
    )


def subject_rows(works: DataFrame, paper: str = "paper_id", schemes: dict[str, str] | None = None) -> DataFrame:
    """Subjects of the given schemes, by default topics, keywords and concepts (array columns of ``struct<id, display_name, score>``), the first rank of each id."""
    schemes = schemes or {"topic": "topics", "keyword": "keywords", "concept": "concepts"}

    def of(scheme: str, column: str) -> Column:
        def subject(s: Column, i: Column) -> Column:
            return F.struct(F.lit(scheme).alias("scheme"), (i + 1).alias("rank"), short_openalex_id(s["id"]).alias("subject_id"), s["display_name"].alias("name"), s["score"].cast("double").alias("score"))

        return F.transform(F.coalesce(F.col(column), F.array()), subject)

    parts = F.flatten(F.array(*(of(n, c) for n, c in schemes.items() if c in works.columns)))
    rows = works.select(paper, F.explode(parts).alias("s")).select(paper, "s.*")
    first = F.row_number().over(Window.partitionBy(paper, "scheme", "subject_id").orderBy("rank"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def reference_rows(works: DataFrame, paper: str = "paper_id", column: str = "referenced_works") -> DataFrame:
    rows = works.select(paper, F.posexplode(F.col(column)).alias("__i", "ref"))
    return rows.select(paper, (F.col("__i") + 1).alias("position"), short_openalex_id("ref").alias("referenced_openalex_id"))


def resolve_references(references: DataFrame, works: DataFrame) -> DataFrame:
    """Fill ``referenced_doi`` of references that only have an OpenAlex id, from a snapshot of works."""
    known = works.groupBy(short_openalex_id("id").alias("referenced_openalex_id")).agg(F.first(match_doi("doi")).alias("__doi"))
    return references.join(known, "referenced_openalex_id", "left").withColumn("referenced_doi", first_value("referenced_doi", "__doi")).drop("__doi")


def paired_affiliations(works: DataFrame, crossref: str = "crossref_authors", openalex: str = "authorships") -> Column:
    """Author structs of both providers, matched by position."""
    return F.arrays_zip(F.col(openalex), F.col(crossref))


def isolated(providers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Frames of the providers that can be asked, and the errors of the others; a single provider's error is raised."""
    frames, errors = {}, {}
    for name, ask in providers.items():
        try:
            frames[name] = ask()
        except Exception as e:
            if len(providers) == 1:
                raise
            errors[name] = f"{type(e).__name__}: {e}"
    return frames, errors
