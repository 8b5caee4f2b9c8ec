"""Removal of long repeated byte strings by sorting sampled suffixes.

A byte is removed if a string of `length` bytes that covers it starts anywhere else too. The classic way sorts
suffixes at the positions of a periodic difference cover, names them, recurses on the names, merges the other suffixes
and compares neighbours. Here the cover is content-defined (a synchronizing set): a position is sampled if
the hash of the bytes before it says so. Equal strings are then sampled at equal places, so a suffix needs comparing only
with suffixes at the same offset from the same sample, and whole ranges of suffixes merge as one:

1. Each sample takes the suffixes before it, in ranges of offsets. A range has two names, of the bytes that all its
   `length`-prefixes share (core) and of all bytes that they touch (union), by two independent hashes.
2. Ranges are sorted by core and union. A core without an equal neighbour: none of its suffixes repeats. Unions with an equal
   neighbour: all of them repeat. One range of each union goes on where a core has several unions. Copies of a range within a
   chunk of texts are known to repeat and stay behind; cores that a sample of the texts holds often are dealt out by their unions, since
   they are known to have equal neighbours. The sample decides on nothing else.
3. Recursion on these with narrower ranges, down to single suffixes, whose core and union are the prefix itself.

Suffixes without a sample in their prefix are named one by one. Equal texts are one text with a count.

Null texts are empty. Texts shorter than `length` lose nothing, but for none that is repeated. Ids may be null or repeat: results depend
on the text alone, and rows with equal texts lose all of it if it has `length` bytes. Texts of any length are read whole; a chunk holds one
long text alone. An empty table gives no rows. Ranges are equal if two 64-bit hashes are. Columns of the input but id and text are not
read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, chunks, cut, join_by_size, mapped, mix, powers, semi_by_size, store, text_bytes

LENGTH = 400
#: Bytes that decide on a sample, and one in how many positions is one.
CONTEXT, ONE_IN = 16, 64
#: Widths of ranges, each a multiple of the next; the last is 1.
WIDTHS = (48, 8, 1)
#: Share of texts that is looked through for frequent cores, how often one must be found, and how many are told apart at most.
SAMPLE, OFTEN, MOST_OFTEN = 0.01, 30, 50_000
#: Bases of the hashes of cores and of unions.
_BASES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
_CODE = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Hashed:
    """Hashes of any byte range of a chunk."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        if len(Hashed._tables.get(base, ((),))[0]) <= len(data):
            n = max(1 << 21, len(data)) + 1
            Hashed._tables[base] = powers(n, base), powers(n, pow(base, -1, 1 << 64))
        up, self.down = Hashed._tables[base]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each interval and every whole number in it."""
    count = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def samples(h: Hashed, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, sample, and the least and greatest offset of the suffixes that it takes; lone suffixes as samples of offset 0."""
    n = len(h.sums) - 1
    at = np.arange(CONTEXT, n + 1)
    at = at[h.of(at - CONTEXT, at) % np.uint64(ONE_IN) == 0]
    text = np.searchsorted(ends, at, "left")  # a sample may stand at a text's end
    text = np.minimum(text, len(ends) - 1)
    inside = at - starts[text] >= CONTEXT
    at, text = at[inside], text[inside]
    before = np.full(len(at), -1)
    same = np.flatnonzero(text[1:] == text[:-1]) + 1
    before[same] = at[same - 1]
    low = np.where(before >= 0, before - CONTEXT + 1, starts[text])  # first suffix after the sample before
    high = np.minimum(at - CONTEXT, ends[text] - length)
    lone_low, lone_high, lone_text = [low], [np.minimum(high, at - length - 1)], [text]
    # suffixes after a text's last sample
    last = np.full(len(ends), -1)
    last[text] = at
    rest = np.where(last >= 0, last - CONTEXT + 1, starts)
    lone_low.append(np.maximum(rest, starts))
    lone_high.append(ends - length)
    lone_text.append(np.arange(len(ends)))
    low = np.maximum(low, at - length)
    ok = high >= low
    owner, lone = expand(np.concatenate(lone_low), np.concatenate(lone_high))
    lone_of = np.concatenate(lone_text)[owner]
    zero = np.zeros(len(lone), np.int64)
    return np.concatenate([text[ok], lone_of]), np.concatenate([at[ok], lone]), np.concatenate([(at - high)[ok], zero]), np.concatenate([(at - low)[ok], zero])


def names(h: Hashed, g: Hashed, at: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """Index of the range, its parts' offsets a to b, and core and union names. The grid of parts is that of CONTEXT + width * k."""
    owner, k = expand((a - CONTEXT) // width, (b - CONTEXT) // width)
    low = CONTEXT + width * k
    high = low + width - 1
    p, a, b = at[owner], np.maximum(a[owner], low), np.minimum(b[owner], high)
    lone = (a == 0) & (b == 0)
    core_a, core_b = np.where(lone, p, p - low), np.where(lone, p + length, p + length - high)
    core = mix(h.of(core_a, core_b) + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    union = mix(g.of(p - b, p + length - a) ^ ((a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)))
    return owner, a, b, core, union


def copies(core: np.ndarray, union: np.ndarray) -> np.ndarray:
    """0 for a range that a chunk holds once, 1 for the first of several equal ones, 2 for the others."""
    order = np.lexsort((union, core))
    same = np.zeros(len(core) + 1, bool)
    same[1:-1] = (core[order][1:] == core[order][:-1]) & (union[order][1:] == union[order][:-1])
    out = np.zeros(len(core), np.int16)
    out[order] = np.where(same[:-1], 2, same[1:].astype(np.int16))
    return out


def _named(texts: DataFrame, width: int, length: int) -> DataFrame:
    """core, name, key, at, a, b, copy of texts (key, text) or of given ranges of theirs (key, text, ranges)."""
    given = "ranges" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            data, offs = text_bytes(batch.column("text"))
            starts, ends = offs[:-1], offs[1:]
            h, g = Hashed(data), Hashed(data, _BASES[1])
            if given:
                r = batch.column("ranges")
                text = np.repeat(np.arange(batch.num_rows), r.value_lengths().fill_null(0).to_numpy())
                flat = r.flatten()
                at, a, b = (flat.field(f).to_numpy().astype(np.int64) for f in ("at", "a", "b"))
                at = at + starts[text]
            else:
                text, at, a, b = samples(h, starts, ends, length)
            owner, low, high, core, union = names(h, g, at, a, b, width, length)
            keys = batch.column("key").take(pa.array(text[owner]))
            columns = [pa.array(core.view(np.int64)), pa.array(union.view(np.int64)), keys, pa.array((at - starts[text])[owner]), *(pa.array(x.astype(np.int16)) for x in (low, high, copies(core, union)))]
            yield pa.RecordBatch.from_arrays(columns, ["core", "name", "key", "at", "a", "b", "copy"])

    return mapped(texts, run, "core long, name long, key long, at long, a short, b short, copy short")


def _often(texts: DataFrame, width: int, length: int) -> DataFrame:
    """Cores that a sample of the texts has often, so that they surely have equal neighbours."""
    seen = _named(texts.sample(SAMPLE, 11), width, length).groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return cut(seen.orderBy(F.desc("n")).limit(MOST_OFTEN).select("core", F.lit(True).alias("often")))


def _compared(rows: DataFrame, often: DataFrame) -> DataFrame:
    """Ranges whose core has an equal neighbour: whether the union has one too, and whether it goes on for its name."""
    again = F.col("copy") == 2
    rows = rows.join(F.broadcast(often), "core", "left")
    # a copy meets no one; ranges of a frequent core meet those of their own union
    rows = rows.withColumn("side", F.when(again, F.xxhash64("key", "at", "a")).when(F.col("often"), F.col("name")).otherwise(F.lit(0).cast("long")))
    core, name = Window.partitionBy("core", "side"), Window.partitionBy("core", "side", "name")
    rows = rows.select("*", F.count("*").over(name).alias("n"), F.min(F.struct("key", "at")).over(name).alias("first"), F.count("*").over(core).alias("all"))
    several = F.coalesce("often", F.lit(False)) | (F.col("n") < F.col("all"))
    rows = rows.where("all > 1 OR often OR copy > 0")
    leads = (F.col("first.key") == F.col("key")) & (F.col("first.at") == F.col("at"))
    return rows.select("key", "at", "a", "b", ((F.col("n") > 1) | (F.col("copy") > 0)).alias("repeats"), (several & leads & ~again).alias("goes_on"))


def repeated(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts (key, n) and the repeated starts (key, first, last) of those that occur once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    counts = cut(texts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")))
    long = counts.where(F.col("bytes") >= length)
    # one row of each distinct text that is long enough
    single = texts.where(F.octet_length("text") >= length)
    many = cut(long.where("n > 1").select("key"))
    one = docs.select(text.alias("text"), F.xxhash64(text).alias("key"))
    copies = semi_by_size(one, many, ["key"]).where(F.octet_length("text") >= length).groupBy("key").agg(F.first("text").alias("text"))
    n_many = many.count()
    rest = single.join(F.broadcast(many) if n_many <= BROADCAST_ROWS else many, "key", "left_anti")
    if n_many:
        copies = store(copies)
    distinct = rest.unionByName(copies.select("key", "text")) if n_many else rest
    found = None
    for width in WIDTHS:
        rows = store(_compared(_named(distinct, width, length), _often(distinct, width, length)))
        starts = rows.where("repeats").select("key", (F.col("at") - F.col("b")).alias("first"), (F.col("at") - F.col("a")).alias("last"))
        found = starts if found is None else found.unionByName(starts)
        on = rows.where("goes_on").groupBy("key").agg(F.collect_list(F.struct("at", "a", "b")).alias("ranges"))
        if width == 1:
            break
        on = store(on)
        if on.isEmpty():
            break
        distinct = join_by_size(distinct.select("key", "text"), on, ["key"], "inner", 100_000)
    return counts, found


def merge(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the intervals."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], last[order] + length
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return list(zip(a[at].tolist(), reach[np.append(at[1:], len(a)) - 1].tolist()))


def spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts (key, n) and key, spans: the maximal runs to remove from texts that occur once."""
    counts, found = repeated(docs, length, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.column("starts"):
                flat = r.values
                out.append([{"begin": a, "end": b} for a, b in merge(flat.field("first").to_numpy(), flat.field("last").to_numpy(), length)])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], ["key", "spans"])

    rows = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    return counts, store(rows.mapInArrow(run, "key long, spans array<struct<begin:long,end:long>>"))


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary): each text without its repeated strings."""
    return _applied(docs, length, id_col, text_col, "kept binary", lambda kept: kept)


def digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _applied(docs, length, id_col, text_col, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _applied(docs: DataFrame, length: int, id_col: str, text_col: str, field: str, make) -> DataFrame:
    counts, found = spans(docs, length, text_col)
    many = counts.where((F.col("n") > 1) & (F.col("bytes") >= length)).select("key", F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("bytes").cast("long").alias("end"))).alias("spans"))
    gone = cut(many.unionByName(found.join(many.select("key"), "key", "left_anti")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = join_by_size(docs.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("key")), gone, ["key"], "left").select(id_col, "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    name = field.split()[0]
    out_type = pa.binary() if field.endswith("binary") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offs = text_bytes(batch.column("text"))
            removed, n_spans, kept = [], [], []
            for a, b, cuts in zip(offs[:-1], offs[1:], batch.column("spans").to_pylist()):
                raw, at, parts = data[a:b].tobytes(), 0, []
                for s in cuts or ():
                    parts.append(raw[at : s["begin"]])
                    at = s["end"]
                parts.append(raw[at:])
                rest = b"".join(parts)
                removed.append(len(raw) - len(rest))
                n_spans.append(len(cuts or ()))
                kept.append(make(rest))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, out_type)], [id_col, "n_bytes", "n_removed", "n_spans", name])

    return mapped(rows, run, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, {field}")
