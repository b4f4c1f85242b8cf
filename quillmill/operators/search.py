"""The query language of archive scans, selection and ordering of papers."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import orcid
from ..functions.nulls import all_of, any_of, has_value
from ..functions.textops import clean_text, decompose_all

_SCOPES = ("category", "from", "to")
_PART = re.compile(r'(?:(category|from|to):)?(?:"([^"]*)"|(\S+))', re.IGNORECASE)
ORDERS = ("corpus", "random", "publication-asc", "publication-desc", "title", "paper-id")


@dataclass(frozen=True)
class Query:
    """Terms that must all match, and the scope of a scan."""

    terms: tuple[str, ...] = ()
    scope: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Query:
        terms, scope = [], {}
        for name, quoted, bare in _PART.findall(text or ""):
            value = " ".join((quoted or bare).split())
            if not value:
                continue
            if not name:
                terms.append(value)
                continue
            if name.lower() != "category" and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
                raise ValueError(f"{name}: takes a date like 2024-01-31, not {value!r}")
            scope[name.lower()] = value
        return cls(tuple(terms), scope)

    def matches(self, *fields: Column | str) -> Column:
        """Each term starts a word somewhere in the fields, without regard to case."""
        text = F.concat_ws(" ", *(clean_text(f) for f in fields))
        quoted = [r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in t.split()) for t in self.terms]
        return all_of([text.rlike(rf"(?iU)\b{q}") for q in quoted])

    def in_scope(self, date: Column, category: Column | None = None) -> Column:
        tests = [F.lit(True)]
        if "from" in self.scope:
            tests.append(date >= self.scope["from"])
        if "to" in self.scope:
            tests.append(date <= self.scope["to"])
        if "category" in self.scope and category is not None:
            tests.append(F.lower(category) == self.scope["category"].lower())
        return all_of(tests)


def scan_archive(archive: DataFrame, query: Query, count: int, *, date: str = "publication_date") -> DataFrame:
    """The newest ``count`` records of a snapshot that match; collapse versions before."""
    category = F.col("category") if "category" in archive.columns else None
    fields = [c for c in ("title", "abstract", "authors", "category") if c in archive.columns]
    return archive.where(query.in_scope(F.col(date), category) & query.matches(*fields)).orderBy(F.desc(date), "paper_id").limit(count)


def select_papers(papers: DataFrame, order: str = "corpus", count: int | None = None, *, seed: int | None = None, seq: str = "ingest_seq", date: str = "publication_date") -> DataFrame:
    """Papers in one of the orders, at most ``count``; equal keys stay in order of arrival, undated papers come last by date."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    if count is not None and count < 1:
        raise ValueError("count must be positive")
    if order == "random" and seed is None:
        raise ValueError("a random order needs a seed")
    dated = F.when(has_value(date), F.col(date).cast("string")).otherwise("9999-99-99") if date in papers.columns else F.lit("")
    keys = {"corpus": [F.col(seq)], "random": [F.xxhash64(F.lit(seed or 0), F.col(seq)), F.col(seq)], "publication-asc": [dated, F.col(seq)], "publication-desc": [dated.desc(), F.col(seq)], "title": [F.lower(F.coalesce("title", F.lit(""))), F.col(seq)], "paper-id": [F.coalesce("paper_id", F.lit("")), F.col(seq)]}
    ordered = papers.orderBy(*keys[order])
    return ordered if count is None else ordered.limit(count)


def author_matches(authors: Column, family: str, given: str = "", own_orcid: str = "", affiliation: str = "") -> Column:
    """Whether an array of ``struct<given, family, ORCID, affiliation array<struct<name>>>`` holds the person.

    An ORCID decides where both sides have one. Else the family names are equal
    and the given names equal, or equal by initials when either is one; an
    affiliation must occur in one of the author's.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{M}+", "")), r"(?U)[^\p{L}\p{N}]+", " "))
    initials = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.left(w, F.lit(1))), "")
    wanted_family, wanted_given, wanted_place = (plain(F.lit(unicodedata.normalize("NFKD", v))) for v in (family, given, affiliation))
    # names are decomposed as whole arrays, before the comparison of each author
    given_names, families = F.transform(authors, lambda a: F.coalesce(a["given"], F.lit(""))), F.transform(authors, lambda a: F.coalesce(a["family"], F.lit("")))
    places = decompose_all(F.transform(authors, lambda a: F.array_join(F.transform(F.coalesce(a["affiliation"], F.array()), lambda f: F.coalesce(f["name"], F.lit(""))), "\n")))
    people = F.arrays_zip(decompose_all(given_names).alias("given"), decompose_all(families).alias("family"), places.alias("places"), F.transform(authors, lambda a: a["ORCID"]).alias("orcid"))

    def same(a: Column) -> Column:
        theirs = plain(a["given"])
        short = any_of([F.exists(F.split(g, " "), lambda w: F.length(w) == 1) for g in (theirs, wanted_given)])
        by_name = (plain(a["family"]) == wanted_family) & ((wanted_given == "") | (theirs == wanted_given) | (short & initials(theirs).startswith(F.left(initials(wanted_given), F.length(initials(theirs)))) & (theirs != "")))
        if affiliation:
            by_name = by_name & F.exists(F.split(a["places"], "\n"), lambda place: F.contains(plain(place), wanted_place))
        known = orcid(a["orcid"])
        return F.when((known != "") & (orcid(F.lit(own_orcid)) != ""), known == orcid(F.lit(own_orcid))).otherwise(by_name)

    return F.exists(people, same)
