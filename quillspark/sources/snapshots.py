"""A data source over a folder of stored pages: JSON lines, one object for each page as it was fetched."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "page_id long, url string, html string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One partition for each file. A filter on page_id (one or some) is checked before a page becomes a row."""

    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("page_id",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = some if self.wanted is None else self.wanted & some
            else:
                yield f

    def partitions(self) -> list[_File]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name.endswith(".json")]

    def read(self, partition: _File) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(partition.path, compression=None) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from filter(None, map(self._row, lines))
            if row := self._row(rest):
                yield row

    def _row(self, line: bytes) -> tuple | None:
        if not line.strip():
            return None
        page = json.loads(line)
        if self.wanted is not None and page.get("page_id") not in self.wanted:
            return None
        return page.get("page_id"), page.get("url"), page.get("html")


class PageSnapshots(DataSource):
    """spark.read.format("page_snapshots").load(folder): page_id, url and html of each stored page; a field that is missing is null."""

    @classmethod
    def name(cls) -> str:
        return "page_snapshots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSnapshots)
