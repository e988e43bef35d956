"""SRC-4 as a data source: any number of text files, each with its own separator and header, in one scan."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "text_tables"
SCHEMA = "file string, line long, table boolean, fields map<string,string>"
#: Small files share a task up to this many bytes; rows travel in batches of ROWS.
PACK_BYTES, ROWS = 64 << 20, 5_000
CONTENT = "Content"


def separator(line: str) -> str | None:
    """Tab or comma, the commoner one; None if the line has neither."""
    return None if "," not in line and "\t" not in line else "\t" if line.count("\t") > line.count(",") else ","


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get `_1`, `_2`, ... so that each names one column."""
    out: list[str] = []
    for name in names:
        new, k = name, 0
        while new in out:
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def table_rows(lines: Iterator[str], sep: str) -> Iterator[list[tuple[str, str]]]:
    """Records after the header as (name, text); blank lines are skipped, missing cells empty, further cells dropped."""
    csv.field_size_limit(sys.maxsize)
    records = (r for r in csv.reader(lines, delimiter=sep) if len(r) > 1 or r and r[0].strip())
    names = unique_names(next(records))
    for record in records:
        yield list(zip(names, record + [""] * (len(names) - len(record))))


def file_rows(text: io.TextIOBase) -> tuple[bool, Iterator[list[tuple[str, str]]]]:
    """Whether the file is a table, decided by its first non-blank line, and its rows."""
    first = next((line for line in text if line.strip()), "")
    lines, sep = chain([first], text), separator(first)
    if sep:
        return True, table_rows(lines, sep)
    return False, ([(CONTENT, line.rstrip("\r\n"))] for line in lines if line.strip())


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def missing(paths: list[str]) -> list[str]:
    """The paths at which there is nothing."""
    found = lambda system, inner: system.get_file_info(inner).type != pafs.FileType.NotFound
    return [p for p in paths if not found(*_place(p))]


def files_of(paths: list[str]) -> list[tuple[str, int]]:
    """(path with the scheme it was given, bytes) of all visible files at or under the paths, by name."""
    found = []
    for path in paths:
        system, inner = _place(path)
        info = system.get_file_info(inner)
        head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        inside = [info] if info.is_file else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        hidden = lambda f: any(p[:1] in "._" for p in f.path[len(inner):].split("/") if p)
        found += [(head + f.path, f.size) for f in inside if f.is_file and (info.is_file or not hidden(f))]
    return sorted(found)


def packed(files: list[tuple[str, int]], size: int = PACK_BYTES) -> list[list[str]]:
    """Groups of files of about `size` bytes; a file is never cut, since a quoted cell may hold line ends."""
    groups: list[list[str]] = []
    held = 0
    for path, n in files:
        if not groups or held and held + n > size:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += n + 1
    return groups


def batches(files: list[str], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the files as record batches; a file is streamed."""
    schema = pa.schema([("file", pa.string()), ("line", pa.int64()), ("table", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))])
    held: list[tuple] = []
    for path in files:
        system, inner = _place(path)
        with io.TextIOWrapper(system.open_input_stream(inner), encoding="utf-8-sig", errors="replace", newline="") as text:
            table, found = file_rows(text)
            for n, fields in enumerate(found, 1):
                held.append((path, n, table, fields))
                if len(held) == rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")

    def partitions(self) -> list[Files]:
        return [Files(tuple(g)) for g in packed(files_of(self.paths))] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(list(partition.paths))


class TextTables(DataSource):
    """Rows (file, line from 1, whether the file is a table, fields): a partition is a group of whole files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text files at `path` (a file, a folder, or a list of them) as one scan."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module
    spark.dataSource.register(TextTables)
    return spark.read.format(FORMAT).option("paths", path if isinstance(path, str) else "\n".join(path)).load()
