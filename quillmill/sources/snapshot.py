"""A Spark data source over recorded provider pages, read like a paged service.

``spark.read.format("provider_pages").option("path", folder)`` reads files
``page-<n>.json``, each a JSON list of records (or an object that holds one
under ``records``), one partition a page. Rows are ``(page, position, record)``
with the record as JSON text, for ``from_json`` with a declared schema. A page
that can't be read is tried again; then the job fails.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Page(InputPartition):
    number: int
    path: str


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.attempts, self.records = options["path"], int(options.get("attempts", 4)), options.get("records", "records")

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if re.match(r"[a-z0-9]+:", self.path) else "file://" + self.path)

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        store, base = self._files()
        names = ((re.fullmatch(r"page-(\d+)\.json", f.base_name), f.path) for f in store.get_file_info(fs.FileSelector(base)))
        return sorted((Page(int(m.group(1)), p) for m, p in names if m), key=lambda p: p.number)

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no pages
            return
        store, _ = self._files()
        for attempt in range(self.attempts):
            try:
                with store.open_input_stream(partition.path) as f:
                    body = json.loads(f.read())
                break
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)
        rows = body if isinstance(body, list) else body.get(self.records) or []
        yield pa.RecordBatch.from_pydict({"page": pa.array([partition.number] * len(rows), pa.int64()), "position": pa.array(range(len(rows)), pa.int64()), "record": pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())})


class ProviderPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return "page long, position long, record string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read_pages(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Records of all pages with a declared schema, and ``ingest_seq`` in order of page and position."""
    spark.dataSource.register(ProviderPages)
    rows = spark.read.format("provider_pages").option("path", path).options(**options).load()
    parsed = rows.select((F.col("page") * 1_000_000 + F.col("position")).alias("ingest_seq"), F.from_json("record", schema).alias("r"))
    return parsed.select("ingest_seq", "r.*")
