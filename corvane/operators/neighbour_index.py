"""Nearest neighbours by inner product, with inverted lists of centroids.

An index is a table of entries (list, idx, vec, distance) and a small table of centres. Centres are fitted on a bounded sample; every
row is in the list of its nearest centre. A query goes through the lists whose centres have the greatest inner product with it. Lists are
dealt out by blocks, so a task holds some 4,096 queries and as many entries of one list, whatever the size of a list, and no pair of
blocks of different lists is made.

Exact searches compare all queries with all entries. (A bound by a list's centre and radius ruled out 4 % of the lists of the embeddings
of 64 dimensions, so nearly every vector went to nearly every list.) Both sides are dealt over a grid, of GRID parts a side up to
SIDE blocks a part: a vector is sent once for each part of the other side, and a task holds two parts, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.studies import _cut

#: Rows on which centres are fitted: those of the least hashes. All rows are indexed.
SAMPLE = 32_768
#: Rows that a list has on average, and the most lists: their centres are the only thing that every task holds.
LIST_ROWS, MAX_LISTS = 512, 16_384
#: Queries and entries that a task compares at once.
BLOCK = 4_096
#: Parts of each side of an exact search, the least rows of a part, and the blocks beyond which there are more parts.
GRID, LEAST_PART, SIDE = 8, 256, 16
#: Queries by which the number of probes is chosen, and the share of true neighbours that must be found.
TUNING_QUERIES, TUNED_RECALL = 256, 0.95


def matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    squares = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    at = squares.argmin(axis=1)
    # measured again without cancellation, since bounds rest on it
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most k centres: rows far from those chosen before, then rounds of means. A centre that no row is nearest to goes."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        at, _ = _nearest(x, centres)
        used, at = np.unique(at, return_inverse=True)
        n = np.bincount(at)
        centres = np.stack([np.bincount(at, x[:, d]) for d in range(x.shape[1])], axis=1) / n[:, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Entries (list, idx, vec, distance and further columns) and, for each list, its centre, its greatest distance and its number of rows."""

    entries: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    probes: int = 8
    block: int = BLOCK

    def tuned(self, k: int, recall: float = TUNED_RECALL, queries: int = TUNING_QUERIES) -> Index:
        """The index with as many probes as find `recall` of the true k neighbours of a bounded number of its own rows."""
        asked = self.entries.select("idx", "vec").orderBy(F.xxhash64("idx"), "idx").limit(queries).collect()
        if not asked:
            return self
        ids, q = [r["idx"] for r in asked], np.array([r["vec"] for r in asked], np.float64)
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, lists = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                s = np.round(q @ matrix(batch.column("vec")).T, 12)
                place = {i: n for n, i in enumerate(ids)}
                for at, i in enumerate(batch.column("idx").to_pylist()):
                    if i in place:
                        s[place[i], at] = -np.inf
                s = np.concatenate([best, s], axis=1)
                of = np.concatenate([lists, np.broadcast_to(batch.column("list").to_numpy(), (len(q), batch.num_rows))], axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best, lists = np.take_along_axis(s, top, axis=1), np.take_along_axis(of, top, axis=1)
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), n)), pa.array(best.ravel()), pa.array(lists.ravel().astype(np.int64))], ["query", "similarity", "list"])

        near = self.entries.select("list", "idx", "vec").mapInArrow(run, "query long, similarity double, list long").where(F.col("similarity") > float("-inf"))
        rank = Window.partitionBy("query").orderBy(F.desc("similarity"), "list")
        found = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query", "list").collect()  # queries x k rows at most
        if not found:
            return self
        order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape).copy(), axis=1)
        need = np.sort([place[r["query"], r["list"]] + 1 for r in found])
        return replace(self, probes=int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]))

    def search(self, queries: DataFrame, key: str, vector: str, k: int, exact: bool = False, probes: int | None = None) -> DataFrame:
        """target, neighbour, similarity, rank: the k entries of the greatest inner product with each query, its own key left out.
        Ties go to the smaller key. Queries without a vector have no neighbours; with `exact` no neighbour is missed."""
        asked = queries.select(F.col(key).alias("target"), F.col(vector).alias("q")).where(F.col("q").isNotNull() & (F.size("q") > 0))
        if not len(self.centres):
            kind = self.entries.schema["idx"].dataType
            return asked.select("target", F.lit(None).cast(kind).alias("neighbour"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("rank")).limit(0)
        if exact:
            return _ranked(swept(asked, self.entries.select("idx", "vec"), k, self.block), k)
        probes = min(probes or self.probes, len(self.centres))
        return _ranked(self._compared(asked, self._probed(asked, probes), k), k)

    def _probed(self, asked: DataFrame, probes: int) -> DataFrame:
        """target, q, list: the lists that a query goes through."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    q = matrix(part.column("q"))
                    s = q @ centres.T
                    order = np.argsort(-s, axis=1, kind="stable")
                    row, at = np.repeat(np.arange(len(q)), probes), order[:, :probes].ravel()
                    yield pa.RecordBatch.from_arrays([part.column("target").take(pa.array(row)), part.column("q").take(pa.array(row)), pa.array(at.astype(np.int64))], ["target", "q", "list"])

        kinds = {c: asked.schema[c].dataType.simpleString() for c in ("target", "q")}
        return asked.select("target", "q").mapInArrow(run, f"target {kinds['target']}, q {kinds['q']}, list long")

    def _compared(self, asked: DataFrame, probed: DataFrame, k: int) -> DataFrame:
        """target, neighbour, similarity: the best k entries of each block of a list for the queries that go through it."""
        spark = asked.sparkSession
        probed = _cut(probed)
        blocks = probed.groupBy("list").agg(F.ceil(F.count("*") / self.block).cast("int").alias("q_blocks"))
        sizes = spark.createDataFrame([(i, int(-(-n // self.block))) for i, n in enumerate(self.sizes) if n], "list long, e_blocks int")
        # a row a list, at most MAX_LISTS
        both = F.broadcast(_cut(blocks.join(F.broadcast(sizes), "list")))
        left = probed.join(both, "list").withColumn("q_block", F.pmod(F.xxhash64("target"), "q_blocks")).withColumn("e_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("e_blocks").cast("long") - 1)))
        # of equal vectors only the first k + 1 can be neighbours
        first = Window.partitionBy("list", "vec").orderBy("idx")
        kept = self.entries.select("list", "idx", "vec").withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
        right = kept.join(both, "list").withColumn("e_block", F.pmod(F.xxhash64("idx"), "e_blocks")).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks").cast("long") - 1)))
        kind = self.entries.schema["idx"].dataType.simpleString()

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                none = [a.column("target").slice(0, 0), b.column("idx").slice(0, 0), pa.array([], pa.float64())]
                return pa.table(none, ["target", "neighbour", "similarity"])
            # in the order of keys, so that ties go to the smaller one
            b = b.sort_by("idx")
            q, x = matrix(a.column("q")), matrix(b.column("vec"))
            targets, ids = a.column("target").to_pylist(), b.column("idx").to_pylist()
            own = {i: n for n, i in enumerate(ids)}
            out: tuple[list, list, list] = ([], [], [])
            for start in range(0, len(q), 512):
                # equal vectors must tie, whatever the order of a sum's parts
                s = np.round(q[start : start + 512] @ x.T, 12)
                for row, t in enumerate(targets[start : start + 512]):
                    if t in own:
                        s[row, own[t]] = -np.inf
                top = _top(s, k)
                values = np.take_along_axis(s, top, axis=1)
                row, at = np.nonzero(values > -np.inf)
                out[0].append(start + row)
                out[1].append(top[row, at])
                out[2].append(values[row, at])
            row, at, values = (np.concatenate(c) for c in out)
            return pa.table([a.column("target").take(pa.array(row)), b.column("idx").take(pa.array(at)), pa.array(values)], ["target", "neighbour", "similarity"])

        keys = ["list", "q_block", "e_block"]
        schema = f"target {asked.schema['target'].dataType.simpleString()}, neighbour {kind}, similarity double"
        near = left.select(*keys, "target", "q").groupBy(*keys).cogroup(right.select(*keys, "idx", "vec").groupBy(*keys)).applyInArrow(compare, schema)
        return _ranked(near, k).drop("rank")

    def add(self, rows: DataFrame, key: str, vector: str) -> Index:
        """The index with more rows in the lists that it has; a key that it holds stays as it was. Bounds are widened where needed."""
        new = rows.join(self.entries.select(F.col("idx").alias(key)), key, "left_anti")
        return _with_bounds(self.entries.unionByName(_assigned(new, key, vector, self.centres)), self.centres, self.probes)

    def save(self, path: str) -> None:
        """Entries sorted by list, so that a reader skips files of other lists, and centres, each a Parquet table."""
        spark = self.entries.sparkSession
        self.entries.repartitionByRange("list").sortWithinPartitions("list", "idx").write.parquet(f"{path}/entries")
        rows = [(i, c.tolist(), float(r), int(n), self.probes) for i, (c, r, n) in enumerate(zip(self.centres, self.radii, self.sizes))]
        spark.createDataFrame(rows, "list long, centre array<double>, radius double, n long, probes int").coalesce(1).write.parquet(f"{path}/centres")


def swept(asked: DataFrame, entries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """target, neighbour, similarity: the best k of each part of the entries (idx, vec) for every query (target, q)."""
    parts = lambda n: max(1, min(GRID, n // LEAST_PART), -(-n // (SIDE * block)))
    e_parts, q_parts = parts(entries.count()), parts(asked.count())
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # of equal vectors only the first k + 1 can be neighbours
    first = Window.partitionBy("vec").orderBy("idx")
    kept = entries.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    keys = ["q_part", "e_part"]
    left = asked.select(deal("target", q_parts).alias("q_part"), each(e_parts).alias("e_part"), "target", "q")
    right = kept.select(each(q_parts).alias("q_part"), deal("idx", e_parts).alias("e_part"), "idx", "vec")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table([a.column("target").slice(0, 0), b.column("idx").slice(0, 0), pa.array([], pa.float64())], ["target", "neighbour", "similarity"])
        # in the order of keys, so that ties go to the smaller one
        b = b.sort_by("idx")
        row, at, values = _best(matrix(a.column("q")), matrix(b.column("vec")), pc.index_in(a.column("target"), b.column("idx").combine_chunks()).fill_null(-1).to_numpy(), k)
        return pa.table([a.column("target").take(pa.array(row)), b.column("idx").take(pa.array(at)), pa.array(values)], ["target", "neighbour", "similarity"])

    schema = f"target {asked.schema['target'].dataType.simpleString()}, neighbour {entries.schema['idx'].dataType.simpleString()}, similarity double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)


def _best(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, rows: int = 2_048, columns: int = 4_096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, entry and inner product of the k best entries of each query but that of place `own`; ties go to the first.

    Products of single precision tell which pairs can be among the k best, within the bound of their error; these alone are measured.
    """
    q_len, x_len = np.linalg.norm(q, axis=1), float(np.linalg.norm(x, axis=1).max())
    fast = np.float32 if max(x_len, q_len.max()) < 1e15 else np.float64
    error = 4 * (x.shape[1] + 4) * 2.0**-24 * q_len * x_len + 1e-11
    q_fast, x_fast = q.astype(fast), x.astype(fast)
    out: tuple[list, list, list] = ([], [], [])
    for start in range(0, len(q), rows):
        m = min(rows, len(q) - start)
        part, slack, mine = q_fast[start : start + m], error[start : start + m], own[start : start + m]
        least = np.full(m, -np.inf)
        row, at, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for begin in range(0, len(x), columns):
            s = part @ x_fast[begin : begin + columns].T
            here = np.flatnonzero((mine >= begin) & (mine < begin + s.shape[1]))
            s[here, mine[here] - begin] = -np.inf
            bar = least
            if s.shape[1] > k and np.isneginf(least).any():
                bar = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            new, place = np.divmod(np.flatnonzero(s >= np.maximum(bar - slack, np.finfo(fast).min).astype(fast)[:, None]), s.shape[1])
            exact = np.round(np.einsum("ij,ij->i", q[start + new], x[begin + place]), 12)
            row, at, values = np.r_[row, new], np.r_[at, begin + place], np.r_[values, exact]
            order = np.lexsort((at, -values, row))
            row, at, values = row[order], at[order], values[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, at, values, rank = (c[rank < k] for c in (row, at, values, rank))
            least[row[rank == k - 1]] = values[rank == k - 1]
        out[0].append(start + row)
        out[1].append(at)
        out[2].append(values)
    row, at, values = (np.concatenate(c) for c in out)
    return row, at, values


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each row; of equals the first places."""
    if s.shape[1] <= 4 * k:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    # all that are as great as the k-th greatest, then these alone in order
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, at = np.nonzero(s >= least[:, None])
    order = np.lexsort((at, -s[row, at], row))
    row, at = row[order], at[order]
    return at[np.searchsorted(row, np.arange(len(s)))[:, None] + np.arange(k)]


def _ranked(near: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("target").orderBy(F.desc("similarity"), "neighbour")
    return near.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _assigned(rows: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """list, idx, vec, distance and the other columns of rows that have a vector, each key once."""
    rest = [c for c in rows.columns if c not in (key, vector, "list", "distance")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                at, distance = _nearest(matrix(part.column("vec")), centres)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *part.columns, pa.array(distance)], ["list", *part.schema.names, "distance"])

    kept = rows.select(F.col(key).alias("idx"), F.col(vector).alias("vec"), *rest).where(F.col("vec").isNotNull() & (F.size("vec") > 0)).dropDuplicates(["idx"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"list long, {kinds}, distance double")


def _with_bounds(entries: DataFrame, centres: np.ndarray, probes: int) -> Index:
    entries = _cut(entries)
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in entries.groupBy("list").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect():  # a row a list, at most MAX_LISTS
        radii[r["list"]], sizes[r["list"]] = r["r"], r["n"]
    return Index(entries, centres, radii, sizes, probes)


def build(rows: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """An index of all rows with a vector. Centres are fitted on the `sample` rows of the least hashes, some 32 a list at least."""
    some = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    n = some.count()
    lists = lists or max(1, min(MAX_LISTS, sample // 32, n // LIST_ROWS))
    picked = np.array([r["v"] for r in some.orderBy(F.xxhash64("k"), "k").limit(sample).collect()], np.float64)
    centres = k_means(picked, lists) if n else np.zeros((0, 0))
    return _with_bounds(_assigned(rows, key, vector, centres), centres, probes=min(8, max(1, len(centres))))


def load(spark: SparkSession, path: str) -> Index:
    """A saved index."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])
    return Index(spark.read.parquet(f"{path}/entries"), np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], np.int64), rows[0]["probes"] if rows else 1)


def neighbours(targets: DataFrame, rows: DataFrame, key: str, vector: str, k: int, exact: bool = True, size: int = BLOCK) -> DataFrame:
    """target, neighbour, similarity, rank: the k nearest rows of each target by inner product, itself left out; ties go to the smaller key."""
    if not exact:
        return replace(build(rows.select(key, vector), key, vector).tuned(k), block=size).search(targets, key, vector, k)
    present = lambda df, a, b: df.select(F.col(key).alias(a), F.col(vector).alias(b)).where(F.col(b).isNotNull() & (F.size(b) > 0))
    return _ranked(swept(present(targets, "target", "q"), present(rows, "idx", "vec").dropDuplicates(["idx"]), k, size), k)
