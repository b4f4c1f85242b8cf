"""Entity resolution: which rows are the same paper, and what the merged paper keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import first_year, match_doi, title_key
from ..functions.nulls import has_value, nz
from ..functions.textops import merge_lists
from .corpus import STATUSES, is_integer
from .graph import components

#: Columns whose equality makes two rows the same paper, besides DOI and title with year.
KEYS = ("paper_id", "core_id", "pmid", "pmcid", "arxiv_id", "medrxiv_doi", "biorxiv_doi", "chemrxiv_doi")


def block_keys(columns: list[str]) -> Column:
    """All keys of a row, as texts that say what kind they are of."""
    out = [F.when(match_doi("doi") != "", F.concat(F.lit("doi="), match_doi("doi")))] if "doi" in columns else []
    out += [F.when(has_value(c), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in KEYS if c in columns]
    if {"title", "publication_date"} <= set(columns):
        title, year = title_key("title"), first_year("publication_date")
        out.append(F.when((title != "") & (year != ""), F.concat(F.lit("title="), title, F.lit("|"), year)))
    return F.array_compact(F.array(*out))


def matches(left: DataFrame, right: DataFrame, id_column: str = "ingest_seq") -> DataFrame:
    """``(left_id, right_id)`` of rows that share a key: one equi-join on exploded keys."""
    a = left.select(F.col(id_column).alias("left_id"), F.explode(block_keys(left.columns)).alias("key"))
    b = right.select(F.col(id_column).alias("right_id"), F.explode(block_keys(right.columns)).alias("key"))
    return a.join(b, "key").select("left_id", "right_id").distinct()


def first_match(stored: DataFrame, incoming: DataFrame, id_column: str = "ingest_seq") -> DataFrame:
    """Each incoming row's earliest match among the stored ones: ``(incoming_id, stored_id or null)``.

    The smallest id of each key is found first, so a key that very many stored
    rows share sends one row to the join.
    """
    b = stored.select(F.col(id_column).alias("id"), F.explode(block_keys(stored.columns)).alias("key")).groupBy("key").agg(F.min("id").alias("id"))
    a = incoming.select(F.col(id_column).alias("incoming_id"), F.explode_outer(block_keys(incoming.columns)).alias("key"))
    return a.join(b, "key", "left").groupBy("incoming_id").agg(F.min("id").alias("stored_id"))


def resolve(rows: DataFrame, id_column: str = "ingest_seq") -> DataFrame:
    """``rows`` with ``entity``, the smallest id among all rows that chains of shared keys connect.

    Every row is linked with the first row of each of its keys, which gives
    the same components as linking all pairs of a key.
    """
    keyed = rows.select(F.col(id_column).alias("id"), F.explode(block_keys(rows.columns)).alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("first"))
    edges = keyed.join(first, "key").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = components(edges).withColumnRenamed("id", id_column)
    return rows.join(found, id_column, "left").withColumn("entity", F.coalesce("component", id_column)).drop("component")


def merge_entities(resolved: DataFrame, id_column: str = "ingest_seq") -> DataFrame:
    """One row per entity, with the rules by which a stored paper takes up later rows.

    Texts: the first that isn't missing, in order of arrival. Statuses: the
    first beyond pending. Integers: the first other than 0. Sources: all, in
    order of first appearance. The merge is a few ordered minima, so a large
    entity is reduced before the shuffle; only sources are gathered, distinct.
    """
    own = [c for c in resolved.columns if c not in (id_column, "entity", "sources")]

    def first(condition: Column, name: str) -> Column:
        return F.min_by(F.when(condition, F.col(name)), F.when(condition, F.col(id_column)))

    out = []
    for c in own:
        if c == "paper_id":
            out.append(F.min_by(c, id_column).alias(c))
        elif c in STATUSES:
            value = first(has_value(c) & (F.col(c) != "pending"), c)
            out.append(F.coalesce(value, F.min_by(c, id_column)).alias(c))
        elif is_integer(c):
            out.append(F.coalesce(first(F.coalesce(F.col(c), F.lit(0)) != 0, c), F.min_by(c, id_column)).alias(c))
        else:
            out.append(F.coalesce(first(has_value(c), c), F.min_by(c, id_column)).alias(c))
    if "sources" not in resolved.columns:
        return resolved.groupBy("entity").agg(F.count("*").alias("merged_rows"), *out)
    # the first row that names each source: distinct before anything is gathered
    parts = resolved.select("entity", id_column, F.posexplode(F.split(F.coalesce("sources", F.lit("")), ";")).alias("pos", "part"))
    named = parts.withColumn("part", F.trim("part")).where("part <> ''").groupBy("entity", "part").agg(F.min(F.struct(id_column, "pos")).alias("at"))
    sources = named.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]), ";").alias("sources"))
    merged = resolved.groupBy("entity").agg(F.count("*").alias("merged_rows"), *out)
    return merged.join(sources, "entity", "left").withColumn("sources", F.coalesce("sources", F.lit("")))


def merge_in_order(rows: list[dict], incoming: list[dict]) -> list[dict]:
    """A small batch, row by row: each row joins the first stored paper it matches, as it is by then.

    Driver-side and quadratic, for batches of a few thousand rows whose order
    of arrival must decide; :func:`resolve` is the distributed way.
    """
    import re

    def text(v) -> str:
        return "" if v is None or v != v else str(v).strip()

    def keys(r: dict) -> set[str]:
        doi = re.sub(r"\.+$", "", re.sub(r"(?i)^https://doi\.org/", "", re.sub(r"(?i)^doi:", "", text(r.get("doi")))).strip()).lower()
        found = {f"doi={doi}"} if doi else set()
        found |= {f"{c}={text(r[c])}" for c in KEYS if text(r.get(c))}
        title, year = re.sub(r"\W+", " ", text(r.get("title")).lower()).strip(), re.search(r"\d{4}", text(r.get("publication_date")))
        return found | ({f"title={title}|{year.group()}"} if title and year else set())

    out = [dict(r) for r in rows]
    for new in incoming:
        old = next((o for o in out if keys(o) & keys(new)), None)
        if old is None:
            out.append(dict(new))
            continue
        for c, v in new.items():
            if c == "paper_id" or not text(v):
                continue
            if c == "sources":
                parts = [p.strip() for s in (old.get(c), v) for p in text(s).split(";")]
                old[c] = ";".join(dict.fromkeys(p for p in parts if p))
            elif is_integer(c):
                old[c] = old.get(c) or int(v)
            elif not text(old.get(c)) or (c in STATUSES and old[c] == "pending"):
                old[c] = v
    return out


def latest_versions(records: DataFrame, key: str, *, rank: str = "version", seq: str = "seq", date: str | None = "publication_date") -> DataFrame:
    """One row per preprint: each column's value of the highest version that has one; ties go to later arrivals.

    The date is the earliest. For three or more sparse versions out of order
    this is the value that a newest-first reading would show.
    """
    order = F.struct(F.coalesce(F.col(rank).cast("long"), F.lit(0)), F.col(seq))
    out = []
    for c in records.columns:
        if c in (key, seq):
            continue
        if c == date:
            out.append(F.coalesce(F.min(nz(c)), F.lit("")).alias(c))
        else:
            given = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
            out.append(F.max_by(F.when(given, F.col(c)), F.when(given, order)).alias(c))
    return records.where(has_value(key)).groupBy(key).agg(*out)


def link_references(references: DataFrame, papers: DataFrame) -> DataFrame:
    """Set ``referenced_paper_id`` where the referenced DOI is a paper's; the first paper of a DOI counts."""
    known = papers.where(has_value("doi")).groupBy(match_doi("doi").alias("__doi")).agg(F.min_by("paper_id", "ingest_seq").alias("__paper"))
    found = references.join(known, (match_doi("referenced_doi") == F.col("__doi")) & has_value("referenced_doi"), "left")
    return found.withColumn("referenced_paper_id", F.coalesce("__paper", F.lit(""))).drop("__doi", "__paper")


def replace_children(stored: DataFrame, added: DataFrame, scope: tuple[str, ...] = ("paper_id", "source")) -> DataFrame:
    """Child rows with those of each scope in ``added`` replaced by them."""
    return stored.join(added.select(*scope).distinct(), list(scope), "left_anti").unionByName(added, allowMissingColumns=True)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Search results of several sources, in order of source, with their arrival order."""
    rows = [f.withColumn("__source", F.lit(i)) for i, f in enumerate(frames.values())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).drop("__source")


__all__ = ["block_keys", "first_match", "latest_versions", "link_references", "matches", "merge_entities", "merge_in_order", "merge_lists", "replace_children", "resolve", "union_sources"]
