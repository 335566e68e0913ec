"""A CSV sink whose bytes don't depend on how the rows are dealt: ordered parts, written by all tasks, published at once.

Each task writes one part to a folder beside the target and reports its rows and bytes. Only if all
tasks are through, the parts of those that count (not of attempts that were given up) become the target, by
one rename. Their names sort as their rows do: the parts in a row are one CSV file.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Characters that a task holds before it writes them.
_BUFFER = 1 << 20
MANIFEST = "manifest.json"


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _exists(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


def _remove(files, path: str) -> None:
    if _exists(files, path):
        files.delete_dir(path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    size: int


class OrderedCsvWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"].rstrip("/"), columns, overwrite
        on = lambda name: options.get(name, "false").lower() == "true"
        self.bom, self.end, self.refuse_empty = on("bom"), "\r\n" if on("crlf") else "\n", on("refuseempty")
        self.staging = f"{self.path}.writing-{uuid.uuid4().hex}"

    def _line(self, values) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator=self.end).writerow(values)
        return out.getvalue()

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        files, staging = filesystem(self.staging)
        files.create_dir(staging, recursive=True)
        partition, n, size = TaskContext.get().partitionId(), 0, 0
        name = f"{partition}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{staging}/{name}") as stream:
            held = io.StringIO()
            out = csv.writer(held, lineterminator=self.end)

            def flush() -> int:
                data = held.getvalue().encode()
                stream.write(data)
                held.seek(0)
                held.truncate()
                return len(data)

            for row in iterator:
                out.writerow(["" if v is None else v for v in row])
                n += 1
                if held.tell() > _BUFFER:
                    size += flush()
            size += flush()
        return Part(partition, name, n, size)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        files, staging = filesystem(self.staging)
        _, target = filesystem(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        try:
            if self.refuse_empty and not parts:
                raise ValueError("there is nothing to write")
            if _exists(files, target) and not self.overwrite:
                raise FileExistsError(f"{self.path} exists")
            files.create_dir(staging, recursive=True)
            head = ("﻿" if self.bom else "") + self._line(self.columns)
            listed = [{"name": f"{0:08d}.csv", "rows": 0, "first_row": 0, "first_byte": 0, "bytes": len(head.encode())}]
            with files.open_output_stream(f"{staging}/{listed[0]['name']}") as stream:
                stream.write(head.encode())
            row, byte = 0, len(head.encode())
            for k, m in enumerate(parts, 1):
                listed.append({"name": f"{k:08d}.csv", "rows": m.rows, "first_row": row, "first_byte": byte, "bytes": m.size})
                files.move(f"{staging}/{m.name}", f"{staging}/{listed[-1]['name']}")
                row, byte = row + m.rows, byte + m.size
            with files.open_output_stream(f"{staging}/{MANIFEST}") as stream:
                stream.write(json.dumps({"rows": row, "bytes": byte, "parts": listed}, indent=1).encode())
            # What given-up attempts have left.
            names = {x["name"] for x in listed} | {MANIFEST}
            for info in files.get_file_info(fs.FileSelector(staging)):
                if info.base_name not in names:
                    files.delete_file(info.path)
            old = f"{target}.old-{uuid.uuid4().hex}"
            if had := _exists(files, target):
                files.move(target, old)
            files.move(staging, target)
            if had:
                files.delete_dir(old)
        except BaseException:
            _remove(files, staging)
            raise

    def abort(self, messages: list[Part | None]) -> None:
        _remove(*filesystem(self.staging))


class OrderedCsv(DataSource):
    """Options: path (a folder that all executors see, or a URI), bom, crlf, refuseEmpty. Partitions are written in their order."""

    @classmethod
    def name(cls) -> str:
        return "orderedcsv"

    def schema(self) -> str:
        raise NotImplementedError("a sink only")

    def writer(self, schema: StructType, overwrite: bool) -> OrderedCsvWriter:
        return OrderedCsvWriter(dict(self.options), schema.fieldNames(), overwrite)


def write_parts(df: DataFrame, path: str, order: list | None = None, overwrite: bool = False, bom: bool = False, crlf: bool = False, refuse_empty: bool = False) -> dict:
    """df in the given total order (or as it lies) as a folder of CSV parts, and its manifest: rows, bytes and where each part begins.

    An existing target is an error, unless overwrite is set; then it is replaced when all is written. A failure leaves nothing.
    """
    spark = df.sparkSession
    spark.dataSource.register(OrderedCsv)
    if order:
        keys = [c if isinstance(c, Column) else F.col(c) for c in order]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    flag = lambda x: str(x).lower()
    out = df.write.format("orderedcsv").option("path", path).option("bom", flag(bom)).option("crlf", flag(crlf)).option("refuseEmpty", flag(refuse_empty))
    out.mode("overwrite" if overwrite else "append").save()
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> dict:
    files, at = filesystem(path)
    with files.open_input_stream(f"{at}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def join_parts(path: str, target: str) -> int:
    """The parts of a folder as one local file, copied as bytes, some at a time; returns the number of rows."""
    files, at = filesystem(path)
    with files.open_input_stream(f"{at}/{MANIFEST}") as stream:
        listed = json.loads(stream.read())
    with open(target, "wb") as out:
        for part in listed["parts"]:
            with files.open_input_stream(f"{at}/{part['name']}") as stream:
                while data := stream.read(_BUFFER):
                    out.write(data)
    return listed["rows"]
