"""Sources, what each can do, and the order in which each capability asks them."""

from __future__ import annotations

from dataclasses import dataclass

CAPABILITIES = ("search", "enrich", "abstract", "text", "pdf")
#: Sources in the order in which each capability asks them.
ORDERS = {
    "search": ("elsevier", "core", "openalex", "pubmed", "arxiv", "medrxiv", "biorxiv", "chemrxiv"),
    "enrich": ("crossref", "openalex", "pubmed", "arxiv", "medrxiv", "biorxiv", "chemrxiv"),
    "abstract": ("openalex", "pubmed", "arxiv", "medrxiv", "biorxiv", "chemrxiv", "core", "elsevier"),
    "text": ("pubmed", "elsevier", "core", "biorxiv"),
    "pdf": ("openalex", "unpaywall", "arxiv", "medrxiv", "biorxiv", "chemrxiv", "pubmed", "core", "elsevier"),
}


@dataclass(frozen=True)
class Source:
    name: str
    capabilities: frozenset[str]


def sources() -> dict[str, Source]:
    names = dict.fromkeys(n for order in ORDERS.values() for n in order)
    return {n: Source(n, frozenset(c for c in CAPABILITIES if n in ORDERS[c])) for n in names}


def resolve_names(capability: str, wanted: list[str] | None = None) -> list[str]:
    """The sources to ask, in the capability's order; unknown or unable ones raise."""
    if capability not in ORDERS:
        raise ValueError(f"capabilities are {', '.join(CAPABILITIES)}")
    if not wanted or wanted == ["all"]:
        return list(ORDERS[capability])
    for n in wanted:
        if n not in sources():
            raise ValueError(f"no source {n!r}")
        if n not in ORDERS[capability]:
            raise ValueError(f"{n} can't {capability}")
    return [n for n in ORDERS[capability] if n in wanted]
