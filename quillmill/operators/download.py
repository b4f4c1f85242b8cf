"""Choosing each paper's abstract, text and PDF among sources, over snapshots or live callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import any_of, has_value

ROLES = ("abstract", "text", "pdf")


def is_pdf(content: Column, content_type: Column | None = None) -> Column:
    magic = F.hex(F.substring(content, 1, 4)) == "25504446"
    return magic if content_type is None else magic | F.lower(content_type).contains("application/pdf")


def reachable(source: str) -> Column:
    """Whether a source can be asked about a paper."""
    by = {"openalex": ("doi", "openalex_id"), "unpaywall": ("doi",), "elsevier": ("elsevier_link",), "pubmed": ("pmid", "pmcid"), "arxiv": ("arxiv_id",), "core": ("core_id",)}
    return any_of([has_value(c) for c in by.get(source, (f"{source}_doi",))])


def pick_content(papers: DataFrame, role: str, sources: list[str], *, key: str = "paper_id") -> DataFrame:
    """The first source, in order, with content of the role: ``content``, ``source``, ``status`` and ``last_error``.

    Snapshot columns are ``<source>_<role>`` and, if any, ``<source>_error``.
    """
    usable = {}
    for s in sources:
        c = F.col(f"{s}_{role}")
        usable[s] = F.when(is_pdf(c), c) if role == "pdf" else F.when(has_value(c), c)
    content = F.coalesce(*usable.values())
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(s)) for s, c in usable.items()))
    errors = [F.when(usable[s].isNull() & has_value(f"{s}_error"), F.concat(F.lit(f"{s}: "), F.col(f"{s}_error"))) for s in sources if f"{s}_error" in papers.columns]
    failed = F.array_join(F.array_compact(F.array(*errors)), "; ") if errors else F.lit("")
    status = F.when(content.isNotNull(), "succeeded").otherwise("failed")
    return papers.select(key, content.alias("content"), F.coalesce(source, F.lit("")).alias("source"), status.alias("status"), F.when(content.isNull(), failed).otherwise("").alias("last_error"))


def download(papers: DataFrame, role: str, loaders: dict[str, Callable[[dict], bytes | str | None]], *, key: str = "paper_id") -> DataFrame:
    """The same with callables, asked on executors one after another until one gives content."""
    kind = papers.schema[key].dataType.simpleString()

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found, source, errors = None, "", []
                for name, load in loaders.items():
                    try:
                        got = load(row)
                        got = got.encode() if isinstance(got, str) else got
                        if got and (role != "pdf" or got[:4] == b"%PDF"):
                            found, source = got, name
                            break
                    except Exception as e:  # one source's failure leaves the others
                        errors.append(f"{name}: {e}")
                out.append((row[key], found, source, "succeeded" if found else "failed", "" if found else "; ".join(errors)))
            yield pd.DataFrame(out, columns=[key, "content", "source", "status", "last_error"])

    return papers.mapInPandas(fetch, f"{key} {kind}, content binary, source string, status string, last_error string")
