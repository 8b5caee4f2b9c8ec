"""Product codes of vectors, found by partial-distance search in whole numbers.

A vector's components become floor(scale * x) and are cut into equal parts. The codebook of a part position starts as that part of
the vectors of the smallest ids; each round assigns every part to its nearest entry and replaces each used entry by the mean of its
parts, rounded down. A pass over the vectors is a pass of tasks that each send one sum an entry and component, whatever their
rows; the driver holds codebooks only, whose size is entries x dimensions. Distances are whole numbers, so the
result does not depend on how the rows are dealt out.

The search takes a part's components in descending variance of the codebook. After the first one the entry that is ahead is
measured whole, which gives the best complete distance so far. Masks then drop, component by component, each entry whose
accumulated distance is strictly greater; so an entry at equal distance is never lost, and of equals the lowest index wins.

Rows whose vector is null, empty or has null, NaN or infinite components are dropped, as are vectors of another length than that of
the smallest id's (a length that does not divide into the parts raises). Components beyond LIMIT after scaling raise, since
their squares would not fit whole numbers of 64 bits. An id that repeats gives a row each time and one codebook entry, of
its least vector; a null id comes after all others. With fewer ids than entries codebooks are shorter. Equal labels share
their summed error, nulls too. An empty table gives no rows. Only id, vector and label are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import NumericType

from corvane.llm.common import BROADCAST_ROWS, mapped, store

#: Magnitude of a scaled component up to which all sums of squares fit 64 bits, for vectors of up to 2,048 components.
LIMIT = 1 << 24
#: Vectors that one vectorised step searches.
BLOCK = 4096


def order_of(book: np.ndarray) -> np.ndarray:
    """Components of a codebook (entries x components) by descending variance; of equals the first."""
    return np.argsort(-book.var(axis=0), kind="stable")


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index and squared distance of each row's nearest entry; of equals the lowest index."""
    n, order = len(rows), order_of(book)
    x, entries = rows[:, order], book[:, order]
    first = (x[:, :1] - entries[None, :, 0]) ** 2
    ahead = entries[first.argmin(axis=1)]
    best = ((x - ahead) ** 2).sum(axis=1)
    at = np.flatnonzero(first <= best[:, None])
    row, entry = np.divmod(at, len(book))
    total = first.ravel()[at]
    for d in range(1, x.shape[1]):
        total = total + (x[row, d] - entries[entry, d]) ** 2
        keep = total <= best[row]
        row, entry, total = row[keep], entry[keep], total[keep]
    # what is left is complete, in the order of rows and then of entries, and holds each row's nearest entry
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, starts) if n else total
    hits = np.flatnonzero(total == least[row])
    return entry[hits[np.searchsorted(row[hits], np.arange(n))]], least


def whole_numbers(values: pa.Array, dim: int, scale: int) -> np.ndarray:
    """A list array of complete vectors as a matrix of floor(scale * x)."""
    x = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT} after scaling")
    return x.astype(np.int64).reshape(-1, dim)


def complete(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """id, vector of the n smallest ids, ascending, null last; of an id's vectors the least. A task sends its n smallest ids only."""

    def place(i) -> tuple:
        return (1, 0) if i is None else (0, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set = set()
        for batch in batches:
            held = set(heapq.nsmallest(n, held.union(batch.column("id").to_pylist()), key=place))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(held, key=place), kind)], ["id"])

    kind = to_arrow_type(rows.schema["id"].dataType)
    ids = rows.select("id").mapInArrow(run, rows.select("id").schema).distinct().orderBy(F.asc_nulls_last("id")).limit(n)
    at = F.broadcast(ids.withColumnRenamed("id", "first"))
    return rows.join(at, F.col("id").eqNullSafe(F.col("first"))).groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("id"))


def _refined(rows: DataFrame, books: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """Codebooks (parts x entries x components) after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = whole_numbers(batch.column("vector").slice(start, BLOCK), dim, scale)
                for p in range(parts):
                    part = x[:, p * width : (p + 1) * width]
                    code, _ = nearest(part, books[p])
                    count[p] += np.bincount(code, minlength=entries)
                    for d in range(width):
                        # exact: a block's sum is far below 2 ** 53
                        total[p, :, d] += np.bincount(code, part[:, d], entries).astype(np.int64)
        slot = np.flatnonzero(count)
        for d in range(-1, width):
            values = count.ravel() if d < 0 else total[:, :, d].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(np.full(len(slot), d), pa.int64()), pa.array(values[slot], pa.int64())], ["slot", "d", "total"])

    sums = mapped(rows.select("vector"), run, "slot long, d long, total long").groupBy("slot", "d").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    found = {(r["slot"], r["d"]): int(r["total"]) for r in sums.collect()}  # entries x (dimensions + 1) rows at most
    out = books.copy()
    for (slot, d), total in found.items():
        if d >= 0:
            out[slot // entries, slot % entries, d] = total // found[slot, -1]
    return out


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray | None:
    """Codebooks (parts x entries x components) of complete rows (id, vector); None without rows."""
    seeds = [r["vector"] for r in _smallest(rows, entries).collect()]
    if not seeds:
        return None
    dim = len(seeds[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    seeds = [s for s in seeds if len(s) == dim]
    books = whole_numbers(pa.array(seeds, pa.list_(pa.float64())), dim, scale).reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _refined(rows.where(F.size("vector") == dim), books, dim, scale)
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """id, label, code, error of complete rows (id, label, vector)."""
    parts, _, width = books.shape
    dim = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                x = whole_numbers(piece.column("vector"), dim, scale)
                error, text = np.zeros(len(x), np.int64), np.full(len(x), "", dtype=object)
                for p in range(parts):
                    code, distance = nearest(x[:, p * width : (p + 1) * width], books[p])
                    error += distance
                    text = text + hexes[code].astype(object)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), pa.array(text, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return mapped(rows.select("id", "label", "vector"), run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances summed over parts), label_error (error summed over equal labels),
    codebooks_sha256 of all complete vectors. Up to 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, since a code has two hex digits")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(complete(F.col("vector")))
    books = codebooks(rows, parts, entries, rounds, scale)
    digest = F.lit(None if books is None else books_sha256(books)).cast("string")
    if books is None:
        coded = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = store(codes(rows.where(F.size("vector") == books.shape[0] * books.shape[2]), books, scale))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if isinstance(coded.schema["label"].dataType, NumericType) and sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", digest.alias("codebooks_sha256"))
