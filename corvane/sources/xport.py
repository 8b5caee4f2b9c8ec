"""Transport files as a data source: spark.read.format("xport") and df.write.format("xport").

Observations have one width, so a file is read in ranges of observations, each a partition; the head alone says what columns there are. A
writing task streams its rows into a file of its own, with texts of one declared width, and files appear when all tasks are done. Paths
are those that pyarrow's file systems open: local and shared folders, and URIs such as hdfs or s3. Files of a store that only Spark opens go through
spark.read.format("binaryFile") and `transport_rows`.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corvane.sources import transport as X

#: Bytes of observations of a partition, and the width that texts are written with.
SPLIT_BYTES, TEXT_WIDTH = 32 << 20, X.LONGEST
#: Observations that are decoded at once.
BATCH = 8_192
_VARIABLE = ">hhhh8s40s8shhh2s8shhl52s"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Files of a folder, without hidden ones and what writers have not finished, or the file itself."""
    store, inner = _opened(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    base = path.rstrip("/")
    inside = [(f.path[len(inner.rstrip("/")) :], f) for f in found]
    return sorted(base + name for name, f in inside if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in name.strip("/").split("/")))


@dataclass
class Layout:
    """Where a file's observations begin and end, their width, and its variables: name, whether a number, width, place."""

    start: int
    end: int
    width: int
    variables: list[tuple[str, bool, int, int]]


def layout(path: str) -> Layout:
    store, inner = _opened(path)
    size = store.get_file_info(inner).size
    with store.open_input_file(inner) as f:
        head = f.read_at(min(size, 10 * X.RECORD), 0)
        at = head.index(X.head("NAMESTR ")[:48])
        count = int(head[at + 54 : at + 58])
        at += X.RECORD
        described = f.read_at(count * X.VARIABLE, at)
        variables = []
        for i in range(count):
            kind, _, width, _, name, *rest = struct.unpack(_VARIABLE, described[i * X.VARIABLE : (i + 1) * X.VARIABLE])
            variables.append((name.decode().rstrip(), kind == 1, width, rest[-2]))
        start = at + -(-count * X.VARIABLE // X.RECORD) * X.RECORD + X.RECORD
        width = sum(v[2] for v in variables)
        end = start + (size - start) // width * width if width else start
        # blanks fill up the last record only
        while end - width > size - X.RECORD and end > start and not f.read_at(width, end - width).strip(b" "):
            end -= width
    return Layout(start, end, width, variables)


def numbers(raw: np.ndarray) -> pa.Array:
    """Rows of up to 8 bytes of hexadecimal floating point, padded on the right; a sign of missing is null."""
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, : raw.shape[1]] = raw
    fraction = whole.astype(np.uint64)
    mantissa = np.zeros(len(raw), np.uint64)
    for i in range(1, 8):
        mantissa = (mantissa << np.uint64(8)) | fraction[:, i]
    missing = (mantissa == 0) & (whole[:, 0] != 0)
    power = 4 * ((whole[:, 0] & 0x7F).astype(np.int32) - 64) - 56
    x = np.ldexp(mantissa.astype(np.float64), power)
    return pa.array(np.where(whole[:, 0] & 0x80, -x, x), mask=missing)


def texts(raw: np.ndarray) -> pa.Array:
    return pa.array([bytes(r).decode("utf-8", "replace").rstrip() for r in raw], pa.string())


@dataclass
class Range(InputPartition):
    """Observations of a file."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class TransportReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.fields = [(f.name, isinstance(f.dataType, T.NumericType)) for f in schema]
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            own = layout(path)
            step = max(1, self.split // max(1, own.width)) * max(1, own.width)
            out += [Range(path, at, min(at + step, own.end)) for at in range(own.start, own.end, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        own = layout(partition.path)
        variables = {n: (number, w, p) for n, number, w, p in own.variables}
        store, inner = _opened(partition.path)
        with store.open_input_file(inner) as f:
            for at in range(partition.start, partition.end, BATCH * own.width):
                data = f.read_at(min(BATCH * own.width, partition.end - at), at)
                rows = np.frombuffer(data, np.uint8).reshape(-1, own.width)
                columns = []
                for name, wanted in self.fields:
                    number, w, p = variables.get(name, (wanted, 0, 0))
                    if not w:
                        columns.append(pa.nulls(len(rows), pa.float64() if wanted else pa.string()))
                        continue
                    values = (numbers if number else texts)(rows[:, p : p + w])
                    columns.append(values.cast(pa.float64() if wanted else pa.string()) if number != wanted else values)
                yield pa.RecordBatch.from_arrays(columns, [n for n, _ in self.fields])


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class TransportWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.fields = [(f.name, isinstance(f.dataType, T.NumericType)) for f in schema]
        for name, _ in self.fields:
            if len(name.encode()) > 8:
                raise ValueError(f"{name} is longer than the 8 bytes that a name may have")
        self.path, self.overwrite = options["path"], overwrite
        self.name, self.label, self.width = options.get("dataset", "DATA"), options.get("label", ""), int(options.get("textwidth", TEXT_WIDTH))
        # files lie in a hidden folder until all of them are there
        self.waiting = f"{self.path.rstrip('/')}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _opened(self.waiting)
        name, out, size = f"part-{uuid.uuid4().hex}.xpt", None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}")
                out.write(self._head())
            values = [[None if v is None else float(v) for v in batch.column(i).to_pylist()] if number else batch.column(i).cast(pa.string()).to_pylist() for i, (_, number) in enumerate(self.fields)]
            body = b"".join(b"".join(X.hex_float(v) if number else X.text(v, self.width) for v, (_, number) in zip(r, self.fields)) for r in zip(*values))
            out.write(body)
            size += len(body)
        if out is None:
            return Written(None)
        out.write(b" " * (-size % X.RECORD))
        out.close()
        return Written(name)

    def _head(self) -> bytes:
        # a row of the full width sets the widths; its observation is cut off again
        one = X.file_of(self.name, self.label, self.fields, [tuple(0.0 if number else "x" * self.width for _, number in self.fields)])
        return one[: one.index(X.head("OBS     ")) + X.RECORD]

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        _, waiting = _opened(self.waiting)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.type == fs.FileType.File and f.path.endswith(".xpt"):
                    store.delete_file(f.path)
        store.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{waiting}/{m.name}", f"{folder}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, waiting = _opened(self.waiting)
        if store.get_file_info(waiting).type == fs.FileType.Directory:
            store.delete_dir(waiting)


class TransportSource(DataSource):
    """Options: path; splitBytes of a partition; to write: dataset, label, textWidth."""

    @classmethod
    def name(cls) -> str:
        return "xport"

    def schema(self) -> T.StructType:
        """The variables of all files, in the order in which they are first met."""
        out: dict[str, T.StructField] = {}
        for path in _files(self.options["path"]):
            for n, number, _, _ in layout(path).variables:
                out.setdefault(n, T.StructField(n, T.DoubleType() if number else T.StringType()))
        return T.StructType(list(out.values()))

    def reader(self, schema: T.StructType) -> TransportReader:
        return TransportReader(schema, self._options())

    def writer(self, schema: T.StructType, overwrite: bool) -> TransportWriter:
        return TransportWriter(schema, self._options(), overwrite)

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(TransportSource)
