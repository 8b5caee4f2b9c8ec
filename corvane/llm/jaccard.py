"""Exact n-gram Jaccard join with count vectors.

A document's shingles are hashed into groups. Two documents with Jaccard at least t differ in at most
d = (1 - t) / (1 + t) * (|A| + |B|) shingles, and each of these spoils one group at most, so all other groups
agree in full. Documents are bucketed by whole groups: of its groups, ordered by the number of their shingles and
then by hash, a document needs only the first d + 1 as keys. Within buckets the documents' group counts are points
of an R-tree; the sum of coordinate minima bounds the overlap, against a box or a point, and pairs that
survive are verified on their sets. Before that, rounds of pivots find most components, so that few buckets are left to trees.

Null texts, and texts without words, have no shingles and link with nothing. Texts with fewer words than a shingle
are one shingle. Documents with equal sets are one class, whose smallest id stands for all. Rows with a null id have
n_shingles and no component. Rows that repeat an id are documents of their own, whose results may differ if their texts do; the id is
in every component that one of them is in. An empty table gives no rows. Texts may be of any length: a chunk holds one long text alone.
Clashing column names do not matter, since only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, Words, chunks, cut, join_by_size, mapped, mix, powers, semi_by_size, store, whole_groups, word_table
from corvane.llm.components import bucket_components, shared

SHINGLE = 5
SPACE = word_table("space")
#: Coordinates of a point.
DIMENSIONS = 256
#: Up to this many shingles every shingle is a group of its own.
SMALL = 15
#: Points of a tile of a bucket, and of a leaf of its tree.
TILE, LEAF = 2048, 32
#: Buckets of so few points are compared without a tree.
FEW = 8
#: Rounds of pivots before the trees.
PIVOTS = (1, 1)
#: Bytes of a shingle that sets are verified on: two of a pair's shingles agree by chance once in 2 ** 48.
SET_BYTES = 6


def sets(values: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the offsets of texts."""
    words = Words(values, SPACE)
    n = np.diff(words.bounds)
    h, offsets = words.windows(k)
    owner = np.repeat(np.arange(len(n)), np.diff(offsets))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = []
        for i in short:
            w = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            whole.append((w * powers(len(w), 0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(w)))
        h, owner = np.concatenate([h, mix(np.array(whole, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def differing(n: np.ndarray | int, t: float):
    """Most shingles that a set of n and a partner of any size can differ in: partners have n / t shingles at most."""
    return np.floor((1 - t) / (1 + t) * (n + n / t) + 1e-9).astype(np.int64)


def classes(n: int, t: float) -> list[int]:
    """Size classes (powers of 2) that a set of n meets its partners in: its own, and the next where partners may reach it."""
    own = n.bit_length()
    return [own] if int(n / t + 1e-9).bit_length() == own else [own, own + 1]


def n_groups(size_class: int) -> int:
    top = 1 << size_class
    return max(24, top // 2 if top <= 128 else top // 3)


def keys_of(h: np.ndarray, t: float, salt: int) -> tuple[list[np.ndarray], bool]:
    """Keys of one set, and whether its groups suffice for every partner up to its own size."""
    n, out, ok = len(h), [], True
    need = int(differing(n, t)) + 1
    for c in classes(n, t):
        seed = np.uint64(((c << 8) + salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if n <= SMALL and c <= SMALL.bit_length():
            out.append(np.sort(mix(h ^ seed))[:need])
            continue
        mixed = mix(h ^ seed)
        group = (mixed >> np.uint64(32)) % np.uint64(n_groups(c))
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1])))
        size = np.diff(np.append(starts, n))
        key = mix(np.add.reduceat(mix(mixed[order]), starts) + size.astype(np.uint64))
        # small sets of the next class are matched by single shingles there too, so both sides agree
        ok &= len(starts) > int(2 * n * (1 - t) / (1 + t) + 1e-9) or n <= SMALL
        first = np.lexsort((key, -size))[:need]
        out.append(key[first])
    return out, bool(ok)


def keyed(docs: DataFrame, k: int, t: float, id_col: str, text_col: str, salt: int = 0) -> DataFrame:
    """id, n, two signatures of the set, whether its groups fail, and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, at = sets(batch.column("text"), k)
            keys, weak = [np.zeros(0, np.uint64)], np.zeros(batch.num_rows, bool)
            count = np.zeros(batch.num_rows + 1, np.int64)
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                if b > a:
                    parts, ok = keys_of(h[a:b], t, salt)
                    keys += parts
                    count[i + 1] = sum(map(len, parts))
                    weak[i] = b - a > SMALL and not ok
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            one, two = signatures(h, at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(one), pa.array(two), pa.array(weak), lists], ["id", "n", "s1", "s2", "weak", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n long, s1 long, s2 long, weak boolean, keys array<long>")


def signatures(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two independent sums of hashes of each set."""
    sums = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(s)), dtype=np.uint64))) for s in (11, 12))
    return [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]


def point_bytes(h: np.ndarray) -> bytes:
    """Group counts in the narrowest whole numbers that hold them."""
    counts = np.bincount((h >> np.uint64(64 - 8 * SET_BYTES)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS)
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint32).tobytes()


def point_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == DIMENSIONS else np.uint32).astype(np.int32)


def packed(h: np.ndarray) -> bytes:
    """The leading bytes of sorted hashes."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def set_rows(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node and set of the wanted rows (node, id, n, s1, s2) of docs (id, text), written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, at = sets(batch.column("text"), k)
            one, two = signatures(h, at)
            rows = [packed(h[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(one), pa.array(two), pa.array(rows, pa.binary())], ["id", "s1", "s2", "data"])

    found = mapped(semi_by_size(docs, wanted.select("id").distinct(), ["id"]), run, f"id {docs.schema['id'].dataType.simpleString()}, s1 long, s2 long, data binary")
    return store(join_by_size(found, wanted.select("node", "id", "s1", "s2"), ["id", "s1", "s2"], "inner").select("node", "data").dropDuplicates(["node"]))


def verified(pairs: DataFrame, of: DataFrame, t: float) -> DataFrame:
    """The pairs (id, pivot) whose sets reach the threshold. The pivots' sets are joined last, since one may have many pairs."""
    both = pairs.join(of.select(F.col("node").alias("id"), F.col("data").alias("set_a")), "id").join(of.select(F.col("node").alias("pivot"), F.col("data").alias("set_b")), "pivot")
    # exact in whole numbers: t is taken as a percentage
    percent = round(t * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                # the smaller over the larger bounds the similarity
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["id", "pivot"]).filter(pa.array(keep, pa.bool_()))

    return mapped(both.select("id", "pivot", "set_a", "set_b"), run, "id long, pivot long")


def bound(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Whether the sums of coordinate minima allow an overlap of at least t / (1 + t) of both sizes."""
    return np.minimum(a, b).sum(axis=-1) >= t / (1 + t) * (a.sum(axis=-1) + b.sum(axis=-1)) - 1e-9


class Tree:
    """An R-tree of points packed level by level: boxes of leaves, boxes of boxes."""

    def __init__(self, data: np.ndarray):
        spread = np.argsort(-data.var(axis=0))[:2] if len(data) else np.zeros(2, int)
        size = data.sum(axis=1)
        slab = np.argsort(size, kind="stable").argsort() // (LEAF * 8)
        self.order = np.lexsort((data[:, spread[1]], data[:, spread[0]] // 4, slab))
        self.data, self.size = data[self.order], size[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        top, low = self.data, self.size
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), LEAF)
            top, low = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((top, low))
            if len(top) == 1:
                break

    def search(self, point: np.ndarray, t: float) -> np.ndarray:
        """Numbers of the points that the bound does not rule out: overlap of at least t / (1 + t) of both sizes."""
        n, part = point.sum(), t / (1 + t)
        at = np.zeros(1, np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[i]
            at = at[np.minimum(top[at], point).sum(axis=1) >= part * (n + low[at]) - 1e-9]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < (len(self.levels[i - 1][0]) if i else len(self.data))]
        ok = np.minimum(self.data[at], point).sum(axis=1) >= part * (n + self.size[at]) - 1e-9
        return self.order[at[ok]]


def tree_pairs(members: DataFrame, of: DataFrame, t: float) -> DataFrame:
    """Pairs (id, pivot) of different components in a bucket that the count bound lets through.

    Large buckets are cut into tiles; each pair of tiles is one piece of work.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([point_bytes(unpacked(x.as_py())) for x in batch.column("data")], pa.binary())], ["id", "data"])

    points = of.mapInArrow(counted, "id long, data binary")
    tiles = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = members.join(tiles, "key").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("id", "cid", "key", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q")).join(points, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "p", "q"]):
            ids, cid, mine, p, q = (table.column(c).to_numpy() for c in ("id", "cid", "mine", "p", "q"))
            data = np.stack([point_of(x) for x in table.column("data").to_pylist()])
            size = np.diff(np.append(starts, len(ids)))
            of = np.repeat(np.arange(len(starts)), size)
            out = []
            # few points are one leaf: all its pairs are bounded at once
            few = (size <= FEW)[of]
            for d in range(1, FEW):
                i = np.flatnonzero(few[:-d] & (of[:-d] == of[d:]) & (cid[:-d] != cid[d:]))
                for part in np.array_split(i, max(1, len(i) // 4096)):
                    ok = bound(data[part], data[part + d], t)
                    out.append((ids[part[ok]], ids[part[ok] + d]))
            for g in np.flatnonzero(size > FEW):
                at = np.arange(starts[g], starts[g] + size[g])
                left, right = at[mine[at] == p[at]], at[mine[at] == q[at]]
                if len(right):
                    tree = Tree(data[right])
                    for i in left:
                        hit = right[tree.search(data[i], t)]
                        hit = hit[cid[hit] != cid[i]]
                        out.append((np.full(len(hit), ids[i]), ids[hit]))
            a, b = (np.concatenate([x[j] for x in out]) if out else ids[:0] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["id", "pivot"])

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "id long, pivot long")


def components(docs: DataFrame, k: int = SHINGLE, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that is reachable by links, the own id included."""
    known = store(keyed(docs, k, threshold, id_col, text_col).withColumn("node", F.monotonically_increasing_id()))
    # a class of equal sets is one node: the row of its smallest id
    found = store(known.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "node")).alias("first")).select("n", "s1", "s2", "first.id", "first.node"))
    one = known.join(found.select("node"), "node", "left_semi")
    members = one.select(F.col("node").alias("id"), F.explode("keys").alias("key"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    if not known.where("weak").isEmpty():
        # a set whose groups fall together too often gets a second hashing, and so do all that it may meet
        again = keyed(texts, k, threshold, "id", "text", 1).join(found.select("id", "s1", "s2", "node"), ["id", "s1", "s2"])
        members = members.unionByName(again.dropDuplicates(["node"]).select(F.col("node").alias("id"), F.explode("keys").alias("key")))
    rows = shared(members)
    of = set_rows(texts, k, found.join(rows.select(F.col("id").alias("node")).distinct(), "node", "left_semi"))
    labels = bucket_components(rows, lambda pairs: verified(pairs, of, threshold), finish=lambda left: tree_pairs(left, of, threshold), pivots=PIVOTS)
    if labels is not None:
        named = found.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = named.join(named.groupBy("component").agg(F.min("id").alias("least")), "component").select("n", "s1", "s2", F.col("least").alias("id"))
    rep = known.select("id", "n", "s1", "s2").join(found.select("n", "s1", "s2", F.col("id").alias("rep")), ["n", "s1", "s2"], "left")
    return rep.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component: the one with the smallest id."""
    extra = cut(components(docs, id_col=id_col, **options).where(f"component_id != {id_col}").select(id_col).distinct())
    n = extra.count()
    return docs.join(F.broadcast(extra) if n <= BROADCAST_ROWS else extra, id_col, "left_anti")
