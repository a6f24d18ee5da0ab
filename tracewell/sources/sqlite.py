"""SQLite message databases as a Spark data source: ``spark.read.format("sqlite_dir").option("path", folder)``.

Files ending ``.db`` in the folder, by name; every table that isn't SQLite's own.  All columns are text.  A partition is one
range of row ids of one table, so a large table is read by several tasks, in bounded fetches.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(folder: str) -> list[tuple[str, str]]:
    """(file, table) in reading order."""
    out = []
    for p in sorted(x for x in Path(folder).iterdir() if x.is_file() and x.name.endswith(".db")):
        with _open(str(p)) as db:
            names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by rowid")]
        out += [(str(p), n) for n in names if not n.startswith("sqlite_")]
    return out


def header(folder: str) -> list[str]:
    """Columns of the first table; none if there is no table."""
    for path, name in tables(folder):
        with _open(path) as db:
            return [c[0] for c in db.execute(f"select * from {_quoted(name)} limit 0").description]
    return []


class _Part(InputPartition):
    def __init__(self, path: str, name: str, first: int, last: int | None, seq: int):
        self.path, self.name, self.first, self.last, self.seq = path, name, first, last, seq


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.folder = options["path"]
        self.batch = int(options.get("batchsize", 100_000))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.names = [f.name for f in schema.fields]
        self.width = len(header(self.folder))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for seq, (path, name) in enumerate(tables(self.folder)):
            with _open(path) as db:
                try:
                    low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(name)}").fetchone()
                except sqlite3.OperationalError:  # a table without row ids
                    out.append(_Part(path, name, 0, None, seq))
                    continue
            if low is not None:
                out += [_Part(path, name, a, min(a + self.batch - 1, high), seq) for a in range(low, high + 1, self.batch)]
        return out or [_Part("", "", 0, None, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.path:
            return
        with _open(part.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            if part.last is None:
                rows = db.execute(f"select * from {_quoted(part.name)}")
            else:
                rows = db.execute(f"select * from {_quoted(part.name)} where rowid between ? and ? order by rowid", (part.first, part.last))
            if self.strict and len(rows.description) != self.width:
                raise ValueError(f"{part.name} of {part.path} has {len(rows.description)} columns under a header of {self.width}")
            no = part.first
            while some := rows.fetchmany(10_000):
                for r in some:
                    cells = [None if v is None else v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in r]
                    cells = (cells + [None] * self.width)[: self.width]
                    # order over the whole input: table by table, row by row
                    yield (Path(part.path).name, part.name, (part.seq << 40) + no, *cells)
                    no += 1


class SqliteDirectory(DataSource):
    """Columns: ``_db``, ``_table``, ``_seq`` (order over all tables), and the first table's columns by position."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_dir"

    def schema(self) -> StructType:
        own = [StructField("_db", StringType()), StructField("_table", StringType()), StructField("_seq", LongType())]
        return StructType(own + [StructField(c, StringType()) for c in header(self.options["path"])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_sqlite_dir(spark: SparkSession, folder: str, batch_size: int = 100_000, strict: bool = False):
    """All rows of all tables of a folder's databases.  ``strict`` raises where a table's width differs from the first's."""
    spark.dataSource.register(SqliteDirectory)
    return spark.read.format("sqlite_dir").options(path=folder, batchsize=batch_size, strict=strict).load()
