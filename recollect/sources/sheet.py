"""A sheet as a Python data source: rows of values in appended files, read by column, written all or nothing.

``spark.read.format("sheet").option("path", folder).option("range", "Leads!B:D")`` gives the columns of an A1 range (all of the sheet's without one) as
strings; the option ``equals`` (``B=some value``) leaves out other rows where they are read. (Filters are not pushed down by Spark: version 4.1 keeps what one query pushed for the next
query of the same DataFrame, which then lacks rows.) A sheet is a folder that all executors share; a file there is one append, a JSON array of values a
line. A write stages a file a task and names them at its commit, so an append that fails leaves nothing.

Short rows are null at the end; blank cells are empty strings, as in a sheet. Columns are named A, B and so on, or by the option ``header`` (names with commas, from column A on).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

RANGE = re.compile(r"^(?:[^!]*!)?([A-Z]+)\d*(?::([A-Z]+)\d*)?$")


def number(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - ord("A") + 1
    return n - 1


def letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(ord("A") + k) + out
    return out


def columns_of(range_: str) -> range:
    """Column numbers of an A1 range, whatever sheet and rows it names."""
    m = RANGE.match(range_.strip().upper() if "!" not in range_ else range_.split("!", 1)[0] + "!" + range_.split("!", 1)[1].strip().upper())
    if not m:
        raise ValueError(f"no column range: {range_!r}")
    first, last = number(m[1]), number(m[2] or m[1])
    return range(min(first, last), max(first, last) + 1)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    staged: str | None


class Sheet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _columns(self) -> list[int]:
        names = self.options.get("header", "")
        width = len(names.split(",")) if names else int(self.options.get("width", "26"))
        return list(columns_of(self.options["range"]) if self.options.get("range") else range(width))

    def schema(self) -> StructType:
        names = [x.strip() for x in self.options.get("header", "").split(",") if x.strip()]
        return StructType([StructField(names[k] if k < len(names) else letters(k), StringType()) for k in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        column, given, value = self.options.get("equals", "").partition("=")
        places = dict(zip(self.schema().names, self._columns(), strict=True))
        return SheetReader(self.options["path"], [places[c] for c in schema.names], (number(column.strip().upper()), value) if given else None)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a sheet can only be appended to")
        return SheetWriter(self.options["path"])


class SheetReader(DataSourceReader):
    def __init__(self, path: str, take: list[int], wanted: tuple[int, str] | None):
        self.path, self.take, self.wanted = path, take, wanted

    def partitions(self) -> list[InputPartition]:
        return [File(f"{self.path}/{f}") for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")] if os.path.isdir(self.path) else []

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # a sheet without files
            return
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                if self.wanted is None or self.wanted[0] < len(row) and row[self.wanted[0]] == self.wanted[1]:
                    yield tuple(row[k] if k < len(row) else None for k in self.take)


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        os.makedirs(f"{self.path}/_staged", exist_ok=True)
        staged, n = f"{self.path}/_staged/{self.job}-{uuid.uuid4().hex}", 0
        try:
            with open(staged, "w", encoding="utf-8") as out:
                for r in rows:
                    out.write(json.dumps([("" if v is None else str(v)) for v in r], ensure_ascii=False) + "\n")
                    n += 1
        except BaseException:
            os.remove(staged)
            raise
        if not n:
            os.remove(staged)
        return Written(staged if n else None)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m and m.staged:
                os.replace(m.staged, f"{self.path}/{os.path.basename(m.staged)}.jsonl")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """What tasks of this job staged that no commit named."""
        folder = f"{self.path}/_staged"
        for f in os.listdir(folder) if os.path.isdir(folder) else []:
            if f.startswith(self.job):
                os.remove(f"{folder}/{f}")


def use_sheets(spark: SparkSession) -> None:
    """Register the format."""
    spark.dataSource.register(Sheet)
