"""Harvested metadata pages: a parser, and a data source whose offset is the resumption token.

The source reads pages from a folder (page-<token>.xml, the first one page-start.xml) or from any function that
gives the page of a token, so a network client can be plugged in; Spark's checkpoint holds the token, a page is read
again after a failure and repeated ids are left to keep-last.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FIELDS = ("id", "created", "updated", "title", "abstract", "categories", "doi", "license")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
# Name spaces of the protocol and of the records.
OAI, ARXIV = "{http://www.openarchives.org/OAI/2.0/}", "{http://arxiv.org/OAI/arXiv/}"


def parse(page: str | bytes) -> tuple[list[tuple], str | None]:
    """(rows in the order of FIELDS, next token). Deleted records are skipped, no match is an empty page, other errors raise."""
    root = ET.fromstring(page)
    if (error := root.find(f"{OAI}error")) is not None:
        if error.get("code") == "noRecordsMatch":
            return [], None
        raise ValueError(f"{error.get('code')}: {error.text}")
    rows = []
    for meta in root.iter(f"{ARXIV}arXiv"):
        text = {f: ((meta.findtext(f"{ARXIV}{f}") or "").strip()) for f in FIELDS}
        rows.append(tuple(" ".join(text[f].split()) if f in ("title", "abstract") else text[f] for f in FIELDS))
    token = (root.findtext(f".//{OAI}resumptionToken") or "").strip()
    return rows, token or None


def parsed(pages: DataFrame, column: str = "page") -> DataFrame:
    """The records of a column of pages."""
    rows = F.udf(lambda page: parse(page)[0] if page else [], f"array<struct<{SCHEMA.replace(' string', ':string')}>>", useArrow=True)
    return pages.select(F.explode(rows(column)).alias("r")).select("r.*")


def patient(fetch: Callable[[str], str], token: str, tries: int = 5, wait: float = 1.0) -> str:
    """fetch(token), repeated after growing waits; the last failure is raised."""
    for k in range(tries):
        try:
            return fetch(token)
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError("unreachable")


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def page(self, token: str) -> str:
        return Path(self.folder, f"page-{token}.xml").read_text()

    def initialOffset(self) -> dict:
        return {"token": "start"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["token"] is None:
            return iter([]), start
        rows, token = parse(patient(self.page, start["token"]))
        return iter(rows), {"token": token}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["token"] is not None and start != end:
            rows, token = parse(patient(self.page, start["token"]))
            yield from rows
            start = {"token": token}

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("page-*.xml"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from parse(Path(partition.value).read_text())[0]


class OaiPages(DataSource):
    """spark.dataSource.register(OaiPages); spark.read or readStream .format("oai_pages").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "oai_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"])
