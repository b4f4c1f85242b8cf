"""Papers and their texts from folders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textops import extract_dois, extract_dois_each, trim_references


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, content, sha256`` of the files, in any order; the path orders them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, full_text`` of the ``.txt`` files below a folder, whole."""
    return read_binary(spark, path, "*.txt").select("path", F.decode("content", "UTF-8").alias("full_text"))


def pypdf_pages(content: bytes) -> list[str]:
    """Page texts by pypdf, which is an optional dependency."""
    import io

    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDFs needs pypdf, or another parser given as `pages`") from e
    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def pdf_papers(files: DataFrame, pages: Callable[[bytes], list[str]] = pypdf_pages) -> DataFrame:
    """``path, sha256, full_text, doi, status, last_error``: page texts without separator, and the likeliest DOI."""

    def read(batches):
        for batch in batches:
            out = []
            for path, sha, content in zip(batch["path"], batch["sha256"], batch["content"]):
                try:
                    out.append((path, sha, "".join(pages(content)), ""))
                except Exception as e:  # a damaged file leaves the others
                    out.append((path, sha, "", str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "sha256", "text", "last_error"])

    rows = files.select("path", "sha256", "content").mapInPandas(read, "path string, sha256 string, text string, last_error string")
    doi = F.coalesce(F.get(extract_dois("text"), F.lit(0)), F.lit(""))
    status = F.when(F.col("last_error") != "", "failed").when(F.col("doi") != "", "doi_found").otherwise("imported")
    return rows.withColumn("doi", doi).select("path", "sha256", trim_references("text").alias("full_text"), "doi", status.alias("status"), "last_error")


def read_document(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] = pypdf_pages) -> DataFrame:
    """``path, full_text`` of the ``.txt`` files (as they are) and ``.pdf`` files (without references) below a folder."""
    texts = read_texts(spark, path)
    return texts.unionByName(pdf_papers(read_binary(spark, path), pages).where("status <> 'failed'").select("path", "full_text"))


#: Keys of a PDF's information that name its DOI, in order, and the one that names its journal's.
DOI_KEYS, JOURNAL_KEY = ("/WPS-ARTICLEDOI", "/prism:doi", "/doi", "/DOI", "/dc:identifier", "/Subject"), "journaldoi"


def doi_candidates(rows: DataFrame, info: str = "info", text: str = "full_text") -> DataFrame:
    """Add ``candidates``: DOIs of a PDF's information (``map<string, string>``), preferred keys first, then of its text."""
    entries = F.map_entries(F.coalesce(F.col(info), F.create_map().cast("map<string,string>")))
    preferred = F.transform(F.array(*map(F.lit, DOI_KEYS)), lambda k: F.element_at(F.col(info), k))
    others = F.transform(F.filter(entries, lambda e: ~F.contains(F.lower(e["key"]), F.lit(JOURNAL_KEY))), lambda e: e["value"])
    # the order of keys decides before frequency does, so every value is searched by itself
    values = F.concat(F.coalesce(F.array_compact(preferred), F.array().cast("array<string>")), others, F.array(F.coalesce(F.col(text), F.lit(""))))
    return rows.withColumn("__values", values).withColumn("candidates", F.array_distinct(F.flatten(extract_dois_each("__values")))).drop("__values")
