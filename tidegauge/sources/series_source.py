"""A Python Data Source: folders of wide CSV files, read and written as series, in batches and as streams.

A file has times in its first column and a series in each of the others, named by the header. Register
:class:`SeriesSource` once, then ``spark.read.format("series").load(folder)`` gives
``series_id, ts, value``. A file is read in parts of ``part_bytes``, each a
partition. A filter on ``series_id`` (with ``spark.sql.python.filterPushdown.enabled``) leaves out columns,
and files that have none of those asked for. Paths are local or any URI that Arrow's
file systems know.

Defined results: an empty cell, and one that isn't a number, is a null value; a line without a readable time is left out; lines end with a line feed and cells hold none.
A stream reads each file once, by modification time and name; files are meant to be complete when they appear.
Writing makes a file for each task, visible when the whole job has been committed; rows of a time
that several tasks write are several lines.
"""

from __future__ import annotations

import csv
import datetime
import io
import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "series_id string, ts timestamp, value double"
PART_BYTES = 32 << 20


def _files(path: str):  # noqa: ANN202
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


def _listed(path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modified) of the CSV files, in the order of their modification."""
    from pyarrow import fs

    system, root = _files(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    files = [(f.path, f.size, f.mtime_ns or 0) for f in found if f.is_file and f.base_name.endswith(".csv") and not f.base_name.startswith((".", "_"))]
    return sorted(files, key=lambda f: (f[2], f[0]))


@dataclass
class Part(InputPartition):
    """The lines that begin in a range of a file, and the columns that are wanted of it."""

    path: str
    file: str
    begin: int
    end: int
    names: list[str]
    wanted: list[int]


def _header(path: str, file: str) -> tuple[list[str], int]:
    system, _ = _files(path)
    with system.open_input_file(file) as f:
        head = b""
        while b"\n" not in head and (more := f.read(1 << 16)):
            head += more
    line = head.split(b"\n", 1)[0]
    return next(csv.reader([line.decode().rstrip("\r")]), []), len(line) + 1


def _parts(path: str, files: Iterable[tuple[str, int, int]], keep: set[str] | None, size: int) -> list[Part]:
    out = []
    for file, n, _ in files:
        names, begin = _header(path, file)
        wanted = [i for i, name in enumerate(names) if i and (keep is None or name in keep)]
        if wanted:
            out += [Part(path, file, max(at, begin), min(at + size, n), names, wanted) for at in range(0, n, size) if min(at + size, n) > begin]
    return out


def _time(cell: str) -> datetime.datetime | None:
    try:
        t = datetime.datetime.fromisoformat(cell.strip())
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)


def _number(cell: str) -> float | None:
    try:
        v = float(cell)
    except ValueError:
        return None
    return None if math.isnan(v) else v


def _lines(part: Part) -> Iterator[bytes]:
    """The lines that begin within the part; the last may end beyond it."""
    system, _ = _files(part.path)
    with system.open_input_file(part.file) as f:
        f.seek(part.begin - 1)
        at, rest = part.begin - 1, b""
        skip = True  # up to the line feed before the first line that begins here
        while more := f.read(1 << 20):
            rest += more
            *done, rest = rest.split(b"\n")
            for line in done:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begin >= part.end:
                    return
                yield line
        if rest and not skip and at < part.end:
            yield rest


def _rows(part: Part) -> Iterator[tuple]:
    for line in _lines(part):
        cells = next(csv.reader([line.decode().rstrip("\r")]), [])
        ts = _time(cells[0]) if cells else None
        if ts is not None:
            for i in part.wanted:
                yield part.names[i], ts, _number(cells[i]) if i < len(cells) else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.keep = options["path"], int(options.get("part_bytes", PART_BYTES)), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("series_id",):
                self.keep = names if self.keep is None else self.keep & names
            else:
                yield f

    def partitions(self) -> list[Part]:
        return _parts(self.path, _listed(self.path), self.keep, self.size)

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("part_bytes", PART_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"modified": -1, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.path)
        return {"modified": files[-1][2], "name": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        low, high = (start["modified"], start["name"]), (end["modified"], end["name"])
        return _parts(self.path, [f for f in _listed(self.path) if low < (f[2], f[0]) <= high], None, self.size)

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    hidden: str | None
    final: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        rows: dict = defaultdict(dict)
        for r in iterator:
            if r["ts"] is not None and r["series_id"] is not None:
                rows[r["ts"]][r["series_id"]] = r["value"]
        name = uuid.uuid4().hex
        if not rows:
            return _Written(None, name)
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        names = sorted({n for cells in rows.values() for n in cells})
        hidden = f"{root}/.{self.job}-{name}.tmp"
        with system.open_output_stream(hidden) as f:
            for cells in (["ts", *names], *([_spelled(ts), *("" if (v := at.get(n)) is None else repr(v) for n in names)] for ts, at in sorted(rows.items()))):
                line = io.StringIO()
                csv.writer(line, lineterminator="\n").writerow(cells)
                f.write(line.getvalue().encode())
        return _Written(hidden, f"{root}/part-{self.job}-{name}.csv")

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = _files(self.path)
        if self.overwrite:
            for file, _, _ in _listed(self.path):
                system.delete_file(file)
        for m in messages:
            if m is not None and m.hidden:
                system.move(m.hidden, m.final)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _files(self.path)
        for m in messages:
            if m is not None and m.hidden:
                system.delete_file(m.hidden)


def _spelled(ts: datetime.datetime) -> str:
    return (ts.astimezone(datetime.timezone.utc) if ts.tzinfo else ts).replace(tzinfo=None).isoformat(sep=" ")


class SeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark) -> None:  # noqa: ANN001
    spark.dataSource.register(SeriesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

