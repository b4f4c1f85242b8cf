"""Provider records as paper rows.

JSON providers are declared schemas and projections over a ``record`` column of
JSON text. PubMed and arXiv answer in XML with mixed content, which is read by
an Arrow function. Every mapper gives the columns of :data:`CORE`; preprint
servers give :data:`PREPRINT` besides. Columns that order records
(``ingest_seq``, ``page``, ``position``) pass through. A malformed XML record
is a row without an id whose ``error`` says why, and fails nothing.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.nulls import first_value, has_value
from ..functions.textops import clean_doi, clean_text, strip_tags, text_from_positions

CORE = "paper_id doi title journal publication_date authors sources metadata_status abstract".split()
PREPRINT = "categories category primary_category published_doi version pdf_url license".split()
ORDER = ("ingest_seq", "page", "position")
#: What each preprint server is called, and where its files are.
SERVERS = {"medrxiv": ("medRxiv", "https://www.medrxiv.org/content/"), "biorxiv": ("bioRxiv", "https://www.biorxiv.org/content/")}

RXIV = "doi string, published string, title string, date string, authors string, version string, category string, license string, abstract string, jatsxml string"
CHEMRXIV = "id string, doi string, title string, abstract string, publishedDate string, submittedDate string, version string, license struct<name:string>, authors array<struct<firstName:string,lastName:string>>, categories array<struct<id:string,name:string>>, keywords array<string>, vor struct<vorDoi:string>, asset struct<original:struct<url:string>>"
CORE_WORK = "id string, doi string, title string, abstract string, publishedDate string, yearPublished string, authors array<struct<name:string>>, journals array<struct<title:string>>, publisher string, downloadUrl string"
ELSEVIER = "`dc:identifier` string, eid string, `prism:doi` string, `dc:title` string, `prism:publicationName` string, `prism:coverDate` string, `dc:creator` string, `dc:description` string, `prism:teaser` string, link array<struct<`@ref`:string,`@href`:string>>"
CROSSREF = "DOI string, title array<string>, `container-title` array<string>, issued struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string,name:string>>, abstract string"
OPENALEX = "id string, doi string, title string, publication_date string, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>,pdf_url:string>, best_oa_location struct<pdf_url:string>, locations array<struct<pdf_url:string>>, ids struct<pmid:string,pmcid:string>, abstract_inverted_index map<string,array<int>>"


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in rows.columns if c != "record"]
    return rows.select(*keep, F.from_json("record", schema).alias("r")).select(*keep, "r.*")


def _paper(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    doi = columns["doi"]
    columns.setdefault("paper_id", F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(""))
    keep = [c for c in ORDER if c in rows.columns]
    fixed = {"sources": F.lit(source), "metadata_status": F.lit("retrieved")}
    return rows.select(*keep, *(c.alias(n) for n, c in {**columns, **fixed}.items()))


def _names(people: Column, given: str, family: str) -> Column:
    each = F.transform(people, lambda a: F.trim(F.concat_ws(" ", a[given], a[family])))
    return F.array_join(F.filter(F.coalesce(each, F.array().cast("array<string>")), lambda n: n != ""), "; ")


def _terms(ids_column: Column, names: Column) -> Column:
    """``array<struct<id, name, is_primary>>``; the first is primary."""
    return F.transform(F.arrays_zip(ids_column.alias("id"), names.alias("name")), lambda t, i: F.struct(t["id"].alias("id"), t["name"].alias("name"), (i == 0).alias("is_primary")))


def _with_primary(columns: dict[str, Column], terms: Column) -> dict[str, Column]:
    first = F.get(terms, F.lit(0))
    return {**columns, "categories": terms, "category": F.coalesce(first["name"], F.lit("")), "primary_category": F.coalesce(first["id"], F.lit(""))}


def rxiv(rows: DataFrame, server: str) -> DataFrame:
    """medRxiv or bioRxiv records; a published paper has its own DOI and no preprint journal."""
    label, base = SERVERS[server]
    r = _parsed(rows, RXIV)
    own = ids.preprint_stem("doi")
    published = F.when(F.lower(F.trim("published")) == "na", "").otherwise(ids.match_doi("published"))
    name = clean_text("category")
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    terms = F.when(name != "", _terms(F.array(slug), F.array(name))).otherwise(_terms(F.array().cast("array<string>"), F.array().cast("array<string>")))
    version = clean_text("version")
    columns = {
        "doi": F.when(published != "", published).otherwise(own), f"{server}_doi": own, "title": clean_text("title"), "journal": F.when(published != "", "").otherwise(label), "publication_date": clean_text("date"),
        "authors": ids.author_list("authors"), "abstract": clean_text("abstract"), "published_doi": published, "version": version, "license": clean_text("license"),
        "pdf_url": F.when(own != "", F.concat(F.lit(base), own, F.lit("v"), F.when(version != "", version).otherwise("1"), F.lit(".full.pdf"))).otherwise(""),
    }
    return _paper(r, server, **_with_primary(columns, terms))


def chemrxiv(rows: DataFrame) -> DataFrame:
    """chemRxiv items, alone or wrapped in ``item``."""
    whole = F.coalesce(F.get_json_object("record", "$.item"), F.col("record"))
    r = _parsed(rows.withColumn("record", whole), CHEMRXIV)
    own, published = ids.match_doi("doi"), ids.match_doi("vor.vorDoi")
    none = F.array().cast("array<struct<id:string,name:string>>")
    items = F.coalesce("categories", none)
    terms = _terms(F.transform(items, lambda c: c["id"]), F.transform(items, lambda c: c["name"]))
    version = F.coalesce(F.nullif(clean_text("version"), F.lit("")), F.nullif(ids.preprint_version("doi").cast("string"), F.lit("0")), F.lit(""))
    columns = {
        "doi": F.when(published != "", published).otherwise(own), "chemrxiv_doi": own, "title": clean_text("title"), "journal": F.when(published != "", "").otherwise("chemRxiv"),
        "publication_date": F.substring(first_value("publishedDate", "submittedDate"), 1, 10), "authors": _names(F.col("authors"), "firstName", "lastName"), "abstract": strip_tags("abstract"),
        "published_doi": published, "version": version, "license": clean_text("license.name"), "pdf_url": first_value("asset.original.url"), "chemrxiv_stem": ids.preprint_stem("doi"), "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
    }
    return _paper(r, "chemrxiv", **_with_primary(columns, terms))


def core(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, CORE_WORK)
    doi, own = ids.match_doi("doi"), first_value("id")
    named = F.when(own != "", F.concat(F.lit("core:"), own)).when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise("")
    date = F.coalesce(F.nullif(F.substring(first_value("publishedDate"), 1, 10), F.lit("")), F.col("yearPublished"), F.lit(""))
    names = F.array_join(F.transform(F.coalesce("authors", F.array()), lambda a: ids.given_family(a["name"])), "; ")
    return _paper(r, "core", paper_id=named, doi=doi, core_id=own, title=clean_text("title"), journal=first_value(F.get("journals", F.lit(0))["title"], F.col("publisher")), publication_date=date, authors=names, pdf_url=first_value("downloadUrl"), abstract=clean_text("abstract"))


def elsevier(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, ELSEVIER)
    link = F.get(F.filter(F.coalesce("link", F.array()), lambda x: x["@ref"] == "full-text"), F.lit(0))["@href"]
    return _paper(
        r, "elsevier", paper_id=first_value("`dc:identifier`", "eid"), doi=ids.match_doi("`prism:doi`"), title=clean_text("`dc:title`"), journal=clean_text("`prism:publicationName`"), publication_date=clean_text("`prism:coverDate`"),
        authors=clean_text("`dc:creator`"), elsevier_link=first_value(link), abstract=clean_text(first_value("`dc:description`", "`prism:teaser`")),
    )


def crossref(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, CROSSREF)
    first = lambda c: first_value(F.get(F.col(c), F.lit(0)))
    people = F.transform(F.coalesce("author", F.array()), lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"], F.lit("")))
    return _paper(r, "crossref", doi=ids.match_doi("DOI"), title=strip_tags(first("title")), journal=first("`container-title`"), publication_date=ids.date_parts_text("issued.`date-parts`"), authors=F.array_join(F.filter(people, lambda n: n != ""), "; "), abstract=strip_tags("abstract"))


def openalex(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, OPENALEX)
    doi, own = ids.match_doi("doi"), ids.short_openalex_id("id")
    named = F.when(doi != "", F.concat(F.lit("doi:"), doi)).when(own != "", F.concat(F.lit("openalex:"), own)).otherwise("")
    pdfs = F.array_distinct(F.array_compact(F.concat(F.array("best_oa_location.pdf_url", "primary_location.pdf_url"), F.coalesce(F.transform("locations", lambda x: x["pdf_url"]), F.array().cast("array<string>")))))
    abstract = F.coalesce(text_from_positions("abstract_inverted_index"), F.lit(""))
    return _paper(
        r, "openalex", paper_id=named, doi=doi, openalex_id=own, title=clean_text("title"), journal=first_value("primary_location.source.display_name"), publication_date=first_value("publication_date"), pmid=ids.pmid("ids.pmid"), pmcid=ids.pmcid("ids.pmcid"),
        authors=F.array_join(F.filter(F.transform(F.coalesce("authorships", F.array()), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))), lambda n: n != ""), "; "), pdf_url=first_value(F.get(pdfs, F.lit(0))), pdf_candidates=pdfs, abstract=abstract,
    )


# --- XML


def _words(element) -> str:
    return "" if element is None else " ".join("".join(element.itertext()).split())


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _children(element, name: str) -> list:
    return [e for e in element.iter() if _local(e) == name]


def _term(element) -> dict:
    return {"id": element.get("UI", ""), "name": _words(element), "is_primary": element.get("MajorTopicYN") == "Y"}


def _pubmed_date(article) -> str:
    found = next(iter(_children(article, "PubDate")), None)
    if found is None:
        return ""
    parts = {_local(e): (e.text or "").strip() for e in found}
    year = parts.get("Year") or (re.search(r"\d{4}", parts.get("MedlineDate", "")) or [""])[0]
    month = parts.get("Month", "")
    number = int(month) if month.isdigit() else ids.MONTHS.get(month[:3].lower(), 0)
    day = parts.get("Day", "")
    return "-".join([year, *([f"{number:02d}"] if year and number else []), *([f"{int(day):02d}"] if year and number and day.isdigit() else [])])


def pubmed_record(xml: str) -> dict:
    """One PubMed article or book as a paper row."""
    root = ET.fromstring(xml)
    one = lambda name: _words(next(iter(_children(root, name)), None))
    kinds = {e.get("IdType"): (e.text or "").strip() for e in _children(root, "ArticleId")}
    doi = kinds.get("doi") or next((e.text or "" for e in _children(root, "ELocationID") if e.get("EIdType") == "doi"), "")
    people = [_words(next(iter(_children(a, "CollectiveName")), None)) or " ".join(w for w in (_words(a.find("ForeName")) or _words(a.find("Initials")), _words(a.find("LastName"))) if w) for a in _children(root, "Author")]
    parts = [(f"{e.get('Label')}: " if e.get("Label") else "") + _words(e) for e in _children(root, "AbstractText")]
    journals = [_words(j.find(n)) for j in _children(root, "Journal") for n in ("Title", "ISOAbbreviation")]
    return {
        "doi": doi, "pmid": one("PMID") or kinds.get("pubmed", ""), "pmcid": kinds.get("pmc", ""), "title": one("ArticleTitle") or one("BookTitle"), "journal": next(filter(None, journals), ""),
        "publication_date": _pubmed_date(root), "authors": "; ".join(p for p in people if p), "sources": "pubmed", "metadata_status": "retrieved", "abstract": "\n".join(parts),
        "mesh": [_term(e) for e in _children(root, "DescriptorName")], "qualifiers": [_term(e) for e in _children(root, "QualifierName")],
        "keywords": [_words(e) for e in _children(root, "Keyword")], "publication_types": [_term(e) for e in _children(root, "PublicationType")],
    }


def arxiv_record(xml: str) -> dict:
    """One Atom entry as a paper row."""
    root = ET.fromstring(xml)
    one = lambda name: _words(next(iter(_children(root, name)), None))
    found = re.search(r"abs/(.+?)(?:v(\d+))?$", one("id"))
    number, version = (found[1], found[2] or "") if found else ("", "")
    published = one("doi")
    terms = [e.get("term", "") for e in _children(root, "category")]
    primary = next((e.get("term", "") for e in _children(root, "primary_category")), terms[0] if terms else "")
    terms = [primary, *(t for t in terms if t != primary)] if primary else terms
    journal = re.match(r"(.*?)(?=\s[\d(]|$)", one("journal_ref"))
    pdf = next((e.get("href") for e in _children(root, "link") if e.get("title") == "pdf"), f"https://arxiv.org/pdf/{number}" if number else "")
    return {
        "doi": published, "arxiv_id": number, "title": one("title"), "journal": (journal[1].strip() if journal and journal[1].strip() else "" if published else "arXiv"),
        "publication_date": one("published")[:10], "authors": "; ".join(_words(e) for e in _children(root, "name")), "sources": "arxiv", "metadata_status": "retrieved", "abstract": one("summary"),
        "categories": [{"id": t, "name": t, "is_primary": t == primary} for t in terms], "category": primary, "primary_category": primary, "published_doi": published, "version": version, "pdf_url": pdf, "license": next((e.get("href", "") for e in _children(root, "license")), ""),
    }


_TERMS = "array<struct<id:string,name:string,is_primary:boolean>>"
PUBMED_ROWS = f"doi string, pmid string, pmcid string, title string, journal string, publication_date string, authors string, sources string, metadata_status string, abstract string, mesh {_TERMS}, qualifiers {_TERMS}, keywords array<string>, publication_types {_TERMS}"
ARXIV_ROWS = f"doi string, arxiv_id string, title string, journal string, publication_date string, authors string, sources string, metadata_status string, abstract string, categories {_TERMS}, category string, primary_category string, published_doi string, version string, pdf_url string, license string"


def _xml(read: Callable[[str], dict], schema: str, number: str, prefix: str) -> Callable[[DataFrame], DataFrame]:
    names = [f.split()[0] for f in re.split(r", (?=\w+ (?:string|array))", schema)]

    def mapper(rows: DataFrame) -> DataFrame:
        keep = [c for c in ORDER if c in rows.columns]

        def parse(batches):
            for batch in batches:
                out = []
                for *order, record in zip(*(batch[c] for c in [*keep, "record"])):
                    try:
                        found = {"error": "", **read(record)}
                    except Exception as e:  # one malformed record leaves the others
                        found = {"error": f"{type(e).__name__}: {e}"}
                    out.append([*order, *(found.get(n) for n in names), found["error"]])
                yield pd.DataFrame(out, columns=[*keep, *names, "error"])

        fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
        parsed = rows.where(has_value("record")).select(*keep, "record").mapInPandas(parse, f"{fields}{schema}, error string")
        dois = {c: clean_doi(c) for c in ("doi", "published_doi") if c in names}
        named = F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")).when(has_value(number), F.concat(F.lit(f"{prefix}:"), number)).otherwise("")
        out = parsed.withColumns(dois).withColumn("paper_id", named)
        return out.select(*keep, "paper_id", *names, "error")

    return mapper


pubmed = _xml(pubmed_record, PUBMED_ROWS, "pmid", "pmid")
arxiv = _xml(arxiv_record, ARXIV_ROWS, "arxiv_id", "arxiv")

MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "arxiv": arxiv, "medrxiv": lambda rows: rxiv(rows, "medrxiv"), "biorxiv": lambda rows: rxiv(rows, "biorxiv"), "chemrxiv": chemrxiv, "pubmed": pubmed, "openalex": openalex, "crossref": crossref, "core": core, "elsevier": elsevier,
}
