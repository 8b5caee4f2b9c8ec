"""SAS transport files, version 5 (the public TS-140 layout): a file of one dataset for each study, and their rows back.

Records of 80 bytes: library, member and descriptor heads, a description of 140 bytes for each variable, then the observations, whose
numbers are 8-byte hexadecimal floating point and whose texts are blank-padded. Names have 8 bytes, labels 40, texts 200 at most.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD, VARIABLE, LONGEST = 80, 140, 200
#: Rows that are Python objects at once.
ROWS = 8_192
#: Bytes that a value of a column may have.
LARGEST = 2**31 - 1
MISSING = b"." + b"\0" * 7
#: Fixed value: the date in the heads, so that equal datasets give equal files.
WRITTEN = b"01JAN24:00:00:00"


def head(kind: str, counts: str = "0" * 30) -> bytes:
    return f"HEADER RECORD*******{kind:<8}HEADER RECORD!!!!!!!{counts:<30}  ".encode("ascii")


def text(value: str | None, width: int) -> bytes:
    """Blank-padded bytes; a letter that does not fit whole is left out."""
    raw = (value or "").encode("utf-8")[:width].decode("utf-8", "ignore").encode("utf-8")
    return raw.ljust(width)


def hex_float(x: float | None) -> bytes:
    """A sign bit, seven bits of a power of 16 and a 56-bit fraction; null and what is no number are missing."""
    if x is None or not math.isfinite(x):
        return MISSING
    if x == 0:
        return b"\0" * 8
    fraction, power = math.frexp(abs(x))
    sixteens = -(-power // 4)
    whole = int(math.ldexp(fraction, 56 + power - 4 * sixteens))
    if not 0 <= sixteens + 64 < 128:
        raise ValueError(f"{x} is out of the format's range")
    return bytes([(0x80 if x < 0 else 0) | (sixteens + 64)]) + whole.to_bytes(7, "big")


def from_hex_float(raw: bytes) -> float | None:
    if raw[1:] == b"\0" * 7 and raw[:1] != b"\0":
        return None
    x = math.ldexp(int.from_bytes(raw[1:], "big"), 4 * ((raw[0] & 0x7F) - 64) - 56)
    return -x if raw[0] & 0x80 else x


def padded(raw: bytes) -> bytes:
    return raw.ljust(-(-len(raw) // RECORD) * RECORD)


def file_of(name: str, label: str, columns: list[tuple[str, bool]], rows: list[tuple]) -> bytes:
    """A transport file; columns: name and whether it is a number."""
    widths = [8 if number else max(1, min(LONGEST, max((len((r[i] or "").encode()) for r in rows), default=1))) for i, (_, number) in enumerate(columns)]
    return bytes(file_of_parts(name, label, columns, widths, [rows]))


def file_of_parts(name: str, label: str, columns: list[tuple[str, bool]], widths: list[int], parts: Iterable[list[tuple]]) -> bytearray:
    """A transport file of rows that come in parts, of which one is held at a time; widths: bytes of each column."""
    system = text("SAS", 8) + text("9.4", 8) + text("", 8) + b" " * 24
    out = head("LIBRARY ") + text("SAS", 8) + text("SAS", 8) + text("SASLIB", 8) + system[8:] + WRITTEN + WRITTEN.ljust(RECORD)
    out += head("MEMBER  ", "0" * 17 + "1600000000140") + head("DSCRPTR ")
    out += text("SAS", 8) + text(name, 8) + text("SASDATA", 8) + system[8:] + WRITTEN + WRITTEN + b" " * 16 + text(label, 40) + text("", 8)
    out += head("NAMESTR ", f"000000{len(columns):04d}" + "0" * 20)
    described, at = b"", 0
    for i, ((column, number), width) in enumerate(zip(columns, widths), 1):
        described += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 1 if number else 2, 0, width, i, text(column, 8), text(column, 40), text("", 8), 0, 0, 0, b"", text("", 8), 0, 0, at, b"")
        at += width
    out += padded(described) + head("OBS     ")
    file = bytearray(out)
    for rows in parts:
        file += b"".join(b"".join(hex_float(v) if number else text(v, width) for v, (_, number), width in zip(r, columns, widths)) for r in rows)
    # the heads are whole records, so the observations are filled up with the file
    file += b" " * (-len(file) % RECORD)
    return file


def held(content: bytes | bytearray, most: int = LARGEST) -> bytes | bytearray:
    """The content, if a column can hold it."""
    if len(content) > most:
        raise ValueError(f"a file of {len(content)} bytes is no value of a column; write with the xport format")
    return content


def rows_of(data: bytes) -> Iterator[dict]:
    """Observations by variable; a number that is missing is None, a blank text is ''."""
    start = data.index(head("NAMESTR ")[:48])
    count = int(data[start + 54 : start + 58])
    at = start + RECORD
    variables = []
    for i in range(count):
        kind, _, width, _, name, *_rest = struct.unpack(">hhhh8s40s8shhh2s8shhl52s", data[at + i * VARIABLE : at + (i + 1) * VARIABLE])
        variables.append((name.decode().rstrip(), kind == 1, width, _rest[-2]))
    at += -(-count * VARIABLE // RECORD) * RECORD + RECORD
    size = sum(v[2] for v in variables)
    ends = at + (len(data) - at) // size * size if size else at
    # blanks fill up the last record only
    while ends - size > len(data) - RECORD and not data[ends - size : ends].strip(b" "):
        ends -= size
    for start in range(at, ends, size or 1):
        own = data[start : start + size]
        yield {n: from_hex_float(own[p : p + 8]) if number else own[p : p + w].decode().rstrip() for n, number, w, p in variables}


def transport_files(rows: DataFrame, study: str, name: str, order: list[str], label: str = "") -> DataFrame:
    """study, content: one file of each study's rows, in order. A study's dataset is one file, so it is built in one task; beyond LARGEST it raises."""
    fields = rows.schema.fields
    number = {f.name: isinstance(f.dataType, T.NumericType) for f in fields}
    kind = rows.schema[study].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        own = group.sort_by([(c, "ascending") for c in order])
        columns = [(f.name, number[f.name]) for f in fields]
        longest = lambda c: pc.max(pc.binary_length(own.column(c).cast(pa.large_string()))).as_py() or 1
        widths = [8 if number[f.name] else max(1, min(LONGEST, longest(f.name))) for f in fields]

        def parts() -> Iterator[list[tuple]]:
            for start in range(0, len(own), ROWS):
                part = own.slice(start, ROWS)
                yield list(zip(*([None if v is None else float(v) for v in part.column(f.name).to_pylist()] if number[f.name] else part.column(f.name).to_pylist() for f in fields)))

        content = held(file_of_parts(name, label, columns, widths, parts()))
        return pa.table({"study": own.column(study)[:1], "content": pa.array([content], pa.binary())})

    return rows.groupBy(study).applyInArrow(build, f"study {kind}, content binary")


def transport_rows(files: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """The rows of transport files under a schema of strings and doubles; variables that a file lacks are null."""
    types = T.StructType.fromDDL(schema).fields
    arrow = [pa.float64() if isinstance(f.dataType, T.NumericType) else pa.string() for f in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(content):
                rows = rows_of(data.as_py())
                while found := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in found], t) for f, t in zip(types, arrow)], [f.name for f in types])

    out = ", ".join(f"`{f.name}` {'double' if t == pa.float64() else 'string'}" for f, t in zip(types, arrow))
    return files.select(F.col(content)).mapInArrow(run, out)
