"""Shared helpers: lineage cuts, size-checked joins and a vectorised text kernel."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table of ids may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Text bytes that one vectorised step works on, so that its arrays stay small.
CHUNK_BYTES = 1 << 20

#: Bytes of a batch of whole texts on its way to Python, in both the executor's and the worker's memory.
BATCH_BYTES = 4 << 20

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on one machine, where none is named, is a temporary one set; on a cluster that raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the folder of spark.checkpoint.dir, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, taken: list[str]) -> str:
    """The name, or the first of its numbered forms that is not taken."""
    low = {c.lower() for c in taken}
    return next(n for i in range(len(taken) + 1) if (n := f"{name}{i or ''}").lower() not in low)


def with_own_names(run: Callable) -> Callable:
    """For operators whose inner columns begin with two underscores: a table's columns that do so too are renamed on the way in and back
    on the way out, also where a parameter names one."""

    @functools.wraps(run)
    def renamed(docs: DataFrame, *args, **named):
        names: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                names[c] = fresh("column", [*docs.columns, *names.values()])
        if not names:
            return run(docs, *args, **named)

        def inner(v):
            if isinstance(v, (list, tuple)):
                return type(v)(inner(x) for x in v)
            return names.get(v, v) if isinstance(v, str) else v

        out = run(docs.withColumnsRenamed(names), *map(inner, args), **{k: inner(v) for k, v in named.items()})
        return out.withColumnsRenamed({n: c for c, n in names.items()})

    return renamed


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_by_size(df: DataFrame, ids: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Left semi join that broadcasts the ids only while their counted rows are few."""
    n = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, on, "left_semi")


def join_by_size(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is broadcast only while its counted rows are few."""
    return df.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def utf8(text: Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def release() -> None:
    """Give memory that a task has freed back to the system, since workers live on and others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


#: How to give up what a module's workers keep between tasks, such as a vocabulary.
_KEPT: dict[str, Callable[[], None]] = {}


def kept_between_tasks(module: str, forget: Callable[[], None]) -> None:
    _KEPT[module] = forget


def forget_others(module: str) -> None:
    """Before a task of one operator, what the worker still keeps for the others goes."""
    for name, forget in _KEPT.items():
        if name != module:
            forget()


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow of rows with whole texts, whose batches are kept small for the rest of the session: rows may be long."""
    conf = df.sparkSession.conf
    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(at).rstrip("b")) <= BATCH_BYTES:
        conf.set(at, f"{BATCH_BYTES}b")

    module = run.__module__

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(module)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice batches by rows so that the text of a slice is about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, and where each group starts, from batches sorted by `by`. A group may span batches."""
    held: list[pa.Table] = []

    def cut_up(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in by:
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return table, np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        first, last = ([table.column(c)[i] for c in by] for i in (0, -1))
        if held and [held[-1].column(c)[-1] for c in by] == first == last:
            held.append(table)
            continue
        table, starts = cut_up(pa.concat_tables([*held, table]))
        held = [table.slice(starts[-1])]
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
    if held:
        yield cut_up(pa.concat_tables(held).combine_chunks())


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string array and its len + 1 offsets; nulls are empty."""
    values = values.cast(pa.large_string() if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pa.large_binary())
    if values.null_count:
        values = values.fill_null("" if pa.types.is_large_string(values.type) else b"")
    _, offsets, data = values.buffers()
    offs = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_table(pattern: str) -> np.ndarray:
    """Which bytes belong to words: `space` splits at ASCII white space, `alnum` keeps letters, digits and all bytes over 127."""
    table = np.ones(256, bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            table[a:b] = True
    return table


class Words:
    """Words of a chunk of texts: 64-bit hashes, byte ranges and the word offsets of each text."""

    def __init__(self, values: pa.Array, table: np.ndarray):
        data, self.offsets = text_bytes(values)
        inside = table[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        length = self.ends - self.starts
        if not len(length):
            self.hashes = np.zeros(0, np.uint64)
            return
        at = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(at[-1]) - np.repeat(at[:-1], length)
        coded = _BYTE_CODE[_ASCII_LOWER[data[inside]]] * powers(int(length.max()))[place]
        self.hashes = mix(np.add.reduceat(coded, at[:-1]) + length.astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words and, for each text, the offsets into them."""
        n = np.diff(self.bounds)
        count = np.maximum(n - k + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(count)))
        total = len(self.hashes) - k + 1
        if total <= 0:
            return np.zeros(0, np.uint64), offsets
        h = np.zeros(total, np.uint64)
        for j, p in enumerate(powers(k, 0xA0761D6478BD642F)):
            h += self.hashes[j : j + total] * p
        keep = np.arange(offsets[-1]) + np.repeat(self.bounds[:-1] - offsets[:-1], count)
        return mix(h[keep] + np.uint64(k)), offsets


def store(df: DataFrame) -> DataFrame:
    """Write a larger intermediate result as a Parquet table in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
