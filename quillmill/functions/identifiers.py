"""Identifiers, dates and names of papers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_column, has_value

#: Months by their English abbreviation.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Id columns in the order in which they name a paper, with the prefix of the name.
ID_ORDER = (("pmid", "pmid"), ("arxiv_id", "arxiv"), ("medrxiv_doi", "medrxiv"), ("biorxiv_doi", "biorxiv"), ("chemrxiv_doi", "chemrxiv"), ("core_id", "core"))


def match_doi(value: Column | str) -> Column:
    """The lower-case bare DOI that matching uses: one ``doi:`` and one resolver prefix go, then final dots."""
    bare = F.regexp_replace(F.trim(F.coalesce(as_column(value).cast("string"), F.lit(""))), r"(?is)^doi:", "")
    bare = F.trim(F.regexp_replace(bare, r"(?is)^https://doi\.org/", ""))
    return F.lower(F.regexp_replace(bare, r"\.+$", ""))


def title_key(value: Column | str) -> Column:
    """Lower-case words of a title (Unicode letters, digits and marks), joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(as_column(value).cast("string"), F.lit(""))), r"(?U)\W+", " "))


def first_year(value: Column | str) -> Column:
    """The first four digits in a row, wherever they are, as text; empty if there are none."""
    return F.regexp_extract(F.coalesce(as_column(value).cast("string"), F.lit("")), r"\d{4}", 0)


def publication_year(value: Column | str) -> Column:
    """The first number of exactly four digits, from 1000 to 2999, as an int or null."""
    found = F.regexp_extract(F.coalesce(as_column(value).cast("string"), F.lit("")), r"(?<!\d)([12]\d{3})(?!\d)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def fallback_id(title: Column, date: Column, authors: Column, doi: Column, **ids: Column) -> Column:
    """A stable name: by DOI, else by the first other id, else by a hash of title, date and authors."""
    named = [F.when(match_doi(doi) != "", F.concat(F.lit("doi:"), match_doi(doi)))]
    named += [F.when(has_value(ids[c]), F.concat(F.lit(f"{p}:"), ids[c].cast("string"))) for c, p in ID_ORDER if c in ids]
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (title, date, authors)))
    return F.coalesce(*named, F.concat(F.lit("paper:"), F.sha1(text)))


def pmid(value: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(as_column(value).cast("string"), F.lit("")), r"\d+", 0)


def pmcid(value: Column | str) -> Column:
    digits = pmid(value)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits)).otherwise("")


def arxiv_id(value: Column | str) -> Column:
    """New (``2101.01234``) or old (``math/0101001``) arXiv id without prefix, URL or version."""
    bare = F.regexp_replace(F.trim(F.coalesce(as_column(value).cast("string"), F.lit(""))), r"(?i)^(https?://(www\.|export\.)?arxiv\.org/(abs|pdf)/|arxiv:\s*)", "")
    new = F.regexp_extract(bare, r"^(\d{4}\.\d{4,5})(v\d+)?(\.pdf)?$", 1)
    old = F.regexp_extract(bare, r"(?i)^([a-z-]+)(\.[a-z]{2})?/(\d{7})(v\d+)?(\.pdf)?$", 0)
    group = lambda i: F.regexp_extract(bare, r"(?i)^([a-z-]+)(\.[a-z]{2})?/(\d{7})(v\d+)?(\.pdf)?$", i)
    return F.when(new != "", new).when(old != "", F.concat(F.lower(group(1)), F.upper(group(2)), F.lit("/"), group(3))).otherwise("")


def arxiv_version(value: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(as_column(value).cast("string"), F.lit("")), r"v(\d+)(\.pdf)?$", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(0))


def preprint_stem(doi: Column | str) -> Column:
    """A preprint DOI without its version (``v2`` or ``/v2`` or ``-v2`` at the end)."""
    return F.regexp_replace(match_doi(doi), r"[-/.]?v\d+$", "")


def preprint_version(doi: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(match_doi(doi), r"v(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def short_openalex_id(value: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.coalesce(as_column(value), F.lit("")), "/+$", ""), "/"), -1)


def orcid(value: Column | str) -> Column:
    """The bare ORCID if its check digit (mod 11-2) is right, else empty."""
    bare = F.upper(F.regexp_extract(F.coalesce(as_column(value), F.lit("")), r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1))
    digits = F.replace(bare, F.lit("-"), F.lit(""))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda s, i: (s + F.substr(digits, i, F.lit(1)).cast("int")) * 2)
    check = (12 - total % 11) % 11
    last = F.when(check == 10, "X").otherwise(check.cast("string"))
    return F.when((bare != "") & (last == F.right(bare, F.lit(1))), bare).otherwise("")


def month_number(value: Column | str) -> Column:
    """1 to 12 from a number or the start of an English month name, else null."""
    text = F.lower(F.trim(as_column(value).cast("string")))
    named = F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.when(text.rlike(r"^\d{1,2}$"), text.cast("int")), F.element_at(named, F.left(text, F.lit(3))))


def date_text(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``, as far as parts are known."""
    parts = [F.when(year.isNotNull(), F.lpad(year.cast("string"), 4, "0"))]
    for above, part in ((year, month), (month, day)):
        if part is not None:
            parts.append(F.when(year.isNotNull() & above.isNotNull() & part.isNotNull(), F.lpad(part.cast("string"), 2, "0")))
    return F.concat_ws("-", *parts)


def date_parts_text(parts: Column | str) -> Column:
    """The date of an ``array<array<int>>`` whose first element holds year, month and day."""
    first = F.get(as_column(parts), F.lit(0))
    return date_text(*(F.get(first, F.lit(i)) for i in range(3)))


def given_family(name: Column | str) -> Column:
    """``Family, Given`` as ``Given Family``; a name without a comma stays as it is."""
    text = F.trim(as_column(name))
    return F.when(F.instr(text, ",") > 0, F.trim(F.concat_ws(" ", F.trim(F.substring_index(text, ",", -1)), F.trim(F.substring_index(text, ",", 1))))).otherwise(text)


def author_list(names: Column | str) -> Column:
    """``;``-separated ``Family, Given`` names as ``; ``-separated plain names."""
    split = F.filter(F.transform(F.split(F.coalesce(as_column(names), F.lit("")), ";"), given_family), lambda n: n != "")
    return F.array_join(split, "; ")


def journal_name(reference: Column | str) -> Column:
    """The words of a journal reference before the first that starts with a digit or a parenthesis."""
    return F.trim(F.regexp_extract(F.coalesce(as_column(reference), F.lit("")), r"^(.*?)(?=\s[\d(]|$)", 1))


def position_label(position: Column, count: Column) -> Column:
    """``first``, ``last`` or ``middle`` from a position that starts at 1."""
    return F.when(position == 1, "first").when(position == count, "last").otherwise("middle")


