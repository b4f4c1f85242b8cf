"""Child tables of papers: authors, subjects and references, from provider records.

Each table is one explode of arrays that Catalyst builds; a subject that a
record names twice under one scheme keeps its first rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import match_doi, orcid, position_label, short_openalex_id
from ..functions.nulls import first_value, has_value, nz

#: The columns of the subject table.
SUBJECTS = "scheme string, subject_id string, display_name string, score double, subject_rank int, is_primary int, level int, parent_field string, parent_domain string"
#: OpenAlex columns by scheme, where a list of subjects stands, and the levels above a primary topic.
SCHEMES = {"topic": "topics", "concept": "concepts", "keyword": "keywords", "sdg": "sustainable_development_goals"}
LEVELS = ("subfield", "field", "domain")


def _has(rows: DataFrame, column: str, field: str) -> bool:
    """Whether the elements (or the value) of a column have a field; records of older snapshots lack some."""
    kind = rows.schema[column].dataType
    kind = getattr(kind, "elementType", kind)
    return field in kind.fieldNames()


def _subject(scheme: str, subject_id: Column, name: Column, rank: Column, *, score=None, primary=None, level=None, field=None, domain=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(scheme).alias("scheme"), F.coalesce(subject_id, F.lit("")).alias("subject_id"), F.coalesce(nz(name), F.lit("")).alias("display_name"), (none if score is None else score).cast("double").alias("score"),
        rank.cast("int").alias("subject_rank"), (F.lit(0) if primary is None else primary).cast("int").alias("is_primary"), (none if level is None else level).cast("int").alias("level"),
        (F.lit("") if field is None else F.coalesce(field, F.lit(""))).alias("parent_field"), (F.lit("") if domain is None else F.coalesce(domain, F.lit(""))).alias("parent_domain"),
    )


def _exploded(rows: DataFrame, paper: str, parts: list[Column], source: str) -> DataFrame:
    kind = f"array<struct<{SUBJECTS.replace(' ', ':').replace(',:', ',')}>>"
    arrays = [F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts] or [F.array().cast(kind)]
    each = rows.select(paper, F.explode(F.concat(*arrays)).alias("s")).select(paper, "s.*").where(F.col("subject_id") != "")
    first = F.row_number().over(Window.partitionBy(paper, "scheme", "subject_id").orderBy("subject_rank"))
    return each.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("source", F.lit(source))


def openalex_subjects(works: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Topics, concepts, keywords and development goals, and the levels above the primary topic."""
    primary = short_openalex_id("primary_topic.id") if "primary_topic" in works.columns else F.lit("")
    parts = []
    for scheme, column in SCHEMES.items():
        if column not in works.columns:
            continue
        fields = {f: _has(works, column, f) for f in ("score", "level", "field", "domain")}

        def of(s: Column, i: Column, scheme=scheme, fields=fields) -> Column:
            own = short_openalex_id(s["id"])
            if scheme == "keyword":
                own = F.coalesce(F.nullif(own, F.lit("")), s["display_name"])
            more = {"score": s["score"] if fields["score"] else None, "level": s["level"] if fields["level"] else None}
            if scheme == "topic":
                more |= {"primary": own == primary, "field": s["field"]["display_name"] if fields["field"] else None, "domain": s["domain"]["display_name"] if fields["domain"] else None}
            return _subject(scheme, own, s["display_name"], i, **more)

        parts.append(_with_index(F.col(column), of))
    if "primary_topic" in works.columns:
        for level in LEVELS:
            if _has(works, "primary_topic", level):
                entry = F.col("primary_topic")[level]
                parts.append(F.array(_subject(level, short_openalex_id(entry["id"]), entry["display_name"], F.lit(0), primary=F.lit(1))))
    return _exploded(works, paper, parts, "openalex")


def _with_index(values: Column, of) -> Column:
    """``transform`` with position, for functions whose defaults would count as parameters."""
    return F.transform(values, lambda s, i: of(s, i))


def term_subjects(rows: DataFrame, scheme: str, column: str, source: str, paper: str = "paper_id") -> DataFrame:
    """Subjects from ``array<struct<id, name, is_primary>>``."""
    terms = F.transform(F.col(column), lambda t, i: _subject(scheme, nz(t["id"]), F.coalesce(nz(t["name"]), t["id"]), i, primary=F.coalesce(t["is_primary"], F.lit(False))))
    return _exploded(rows, paper, [terms], source)


def word_subjects(rows: DataFrame, scheme: str, column: str, source: str, paper: str = "paper_id", *, lower: bool = False) -> DataFrame:
    """Subjects from an array of words, which name themselves."""
    words = F.transform(F.col(column), lambda w, i: _subject(scheme, F.lower(nz(w)) if lower else nz(w), w, i))
    return _exploded(rows, paper, [words], source)


def pubmed_subjects(rows: DataFrame, paper: str = "paper_id") -> DataFrame:
    """MeSH descriptors and qualifiers, publication types and author keywords."""
    parts = [term_subjects(rows, s, c, "pubmed", paper) for s, c in (("mesh", "mesh"), ("mesh_qualifier", "qualifiers"), ("publication_type", "publication_types"))]
    return reduce(DataFrame.unionByName, [*parts, word_subjects(rows, "mesh_keyword", "keywords", "pubmed", paper)])


def preprint_subjects(rows: DataFrame, server: str, paper: str = "paper_id") -> DataFrame:
    """Categories of a preprint server; chemRxiv's keywords too."""
    out = term_subjects(rows, f"{server}_category", "categories", server, paper)
    return out.unionByName(word_subjects(rows, "chemrxiv_keyword", "keywords", server, paper, lower=True)) if server == "chemrxiv" and "keywords" in rows.columns else out


def authors(rows: DataFrame, paper: str = "paper_id", *, openalex: str = "authorships", crossref: str = "author") -> DataFrame:
    """One row per author and affiliation, positions and ranks from 0.

    OpenAlex's authorships are the spine; Crossref's authors of the same
    position give the split name, and go on where OpenAlex's list ends.
    """
    a, c = F.col(openalex), F.col(crossref)
    n, m = F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(c), F.lit(0))
    total = F.greatest(n, m, F.lit(0))
    places = rows.select(paper, a.alias("__a"), c.alias("__c"), F.greatest(n, F.lit(0)).alias("__n"), total.alias("__m"))
    each = places.where("__m > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("__m") - 1))).withColumn("a", F.get("__a", F.col("i"))).withColumn("c", F.get("__c", F.col("i")))
    spine = F.col("i") < F.col("__n")
    place = "struct<rank:int,affiliation:string,institution_name:string,institution_ror:string,institution_country:string>"
    empty = F.lit("")
    raw = lambda j: F.coalesce(F.get("a.raw_affiliation_strings", j), empty)
    known = F.transform("a.institutions", lambda o, j: F.struct(j.alias("rank"), raw(j).alias("affiliation"), o["display_name"].alias("institution_name"), short_openalex_id(o["ror"]).alias("institution_ror"), o["country_code"].alias("institution_country")).cast(place))
    alone = lambda text: F.array(F.struct(F.lit(0).alias("rank"), text.alias("affiliation"), empty.alias("institution_name"), empty.alias("institution_ror"), empty.alias("institution_country")).cast(place))
    deposited = F.transform("c.affiliation", lambda o, j: F.struct(j.alias("rank"), o["name"].alias("affiliation"), empty.alias("institution_name"), empty.alias("institution_ror"), empty.alias("institution_country")).cast(place))
    some = lambda arr: F.coalesce(F.size(arr), F.lit(0)) > 0
    found = F.when(spine, F.when(some(F.col("a.institutions")), known).otherwise(alone(raw(F.lit(0))))).otherwise(F.when(some(F.col("c.affiliation")), deposited).otherwise(alone(empty)))
    given, family = first_value("c.given"), first_value("c.family")
    own = position_label(F.col("i") + 1, F.when(spine, F.col("__n")).otherwise(F.col("__m")))
    label = F.coalesce(F.when(spine, nz("a.author_position")), own)
    out = each.select(
        paper, F.col("i").alias("author_position"), label.alias("position_label"), F.when(spine, first_value("a.author.display_name")).otherwise(F.concat_ws(" ", nz(given), nz(family))).alias("display_name"), given.alias("given_name"), family.alias("family_name"),
        F.when(spine & (orcid("a.author.orcid") != ""), orcid("a.author.orcid")).otherwise(orcid("c.ORCID")).alias("orcid"), F.when(spine, F.coalesce("a.is_corresponding", F.lit(False))).otherwise(F.lit(False)).cast("int").alias("is_corresponding"),
        F.when(spine, short_openalex_id("a.author.id")).otherwise("").alias("openalex_author_id"), F.when(spine, "openalex").otherwise("crossref").alias("source"), F.explode(found).alias("p"),
    )
    texts = [F.coalesce(f"p.{x}", empty).alias(x) for x in ("affiliation", "institution_name", "institution_ror", "institution_country")]
    return out.select(*(x for x in out.columns if x != "p"), F.col("p.rank").alias("affiliation_rank"), *texts)


def references(rows: DataFrame, paper: str = "paper_id", *, crossref: str = "reference", openalex: str = "referenced_works") -> DataFrame:
    """Both providers' reference lists side by side: Crossref's DOIs and OpenAlex's ids, ranks from 0."""
    out = []
    if crossref in rows.columns:
        each = rows.select(paper, F.posexplode(crossref).alias("reference_rank", "r"))
        out.append(each.select(paper, F.lit("crossref").alias("source"), "reference_rank", match_doi("r.DOI").alias("referenced_doi"), F.lit("").alias("referenced_openalex_id")))
    if openalex in rows.columns:
        each = rows.select(paper, F.posexplode(openalex).alias("reference_rank", "r"))
        out.append(each.select(paper, F.lit("openalex").alias("source"), "reference_rank", F.lit("").alias("referenced_doi"), short_openalex_id("r").alias("referenced_openalex_id")).where("referenced_openalex_id <> ''"))
    return reduce(DataFrame.unionByName, out)


def with_paper(records: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Records with the ``paper_id`` that asked for their key (``key, paper_id``)."""
    return records.where(has_value(key)).join(keys, key)
