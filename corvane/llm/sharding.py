"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in virtual partitions of bounded size. How many rows each partition sends to each shard is drawn
from the multivariate hypergeometric law, whose margins are the partitions' and the shards' exact sizes. The matrix is drawn
in a tree: the driver draws it for at most GROUPS groups of partitions, and each group, on the executors, for its own partitions.
Each partition permutes its rows and deals them out by its line of the matrix; after the exchange
each shard permutes again, block by block, and numbers its rows without gaps. Every assignment with these
shard sizes is equally likely.

Null texts are empty. Rows that are equal in every column take different slots. An empty table gives no rows. Rows may be of any
length: two exchanges carry them. Columns of the input are kept; `shard` and `slot` are replaced if the input has them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, join_by_size

#: Rows of a virtual partition and of a block of a shard, about.
PART_ROWS = 20_000
#: Rows beyond which the library draws no hypergeometric number.
LIBRARY_ROWS = 1_000_000_000
#: Groups of partitions, whose lines the driver draws; more only as each must have fewer rows than the library's limit.
GROUPS = 1024


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Sizes at most one apart."""
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def log_factorial(n) -> np.ndarray:
    """By Stirling's series in extended precision; for n of 100 or more its error is far below that of the type."""
    n = np.longdouble(n)
    return n * np.log(n) - n + np.log(2 * np.longdouble(np.pi) * n) / 2 + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)


def hypergeometric(good: int, bad: int, taken: int, rng: np.random.Generator) -> int:
    """How many of `taken` rows are good ones. Beyond the library's limit by rejection from a Cauchy-like hat around the mode."""
    total = good + bad
    if total < LIBRARY_ROWS:
        return int(rng.hypergeometric(good, bad, taken))
    if 2 * taken > total:  # what is left is drawn instead
        return good - (hypergeometric(good, bad, total - taken, rng) if taken < total else 0)
    low, high = max(0, taken - bad), min(good, taken)
    mean, spread = taken * good / total, math.sqrt(max(1.0, taken * (good / total) * (bad / total) * ((total - taken) / (total - 1))))
    if min(mean - low, high - mean) < 200 + 40 * spread:
        # a tail is near: row by row of the smaller side, each of which is taken or not, in steps that the library can draw
        small, flip = (good, False) if good <= taken else (taken, True)
        of = taken if not flip else good
        found = 0
        for k in range(small):
            found += rng.random() * (total - k) < of - found
        return found
    mode = round(mean)
    terms = lambda k: log_factorial(k) + log_factorial(good - k) + log_factorial(taken - k) + log_factorial(bad - taken + k)
    top = terms(mode)
    while True:
        x = mean + 1.5 * spread * rng.standard_cauchy()
        k = math.floor(x)
        if low + 100 < k < high - 100:
            # the hat is above the law everywhere: half as high again at the mode, and falling with the square
            hat = 1.5 / (1 + ((x - mean) / (1.5 * spread)) ** 2)
            if rng.random() * hat <= float(np.exp(top - terms(k))):
                return k


def matrix(counts: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows that each partition (line) sends to each shard, drawn without replacement."""
    left, out = [int(x) for x in sizes], np.zeros((len(counts), len(sizes)), np.int64)
    for p, c in enumerate(counts):
        rest, total = int(c), sum(left)
        for s in range(len(left)):
            out[p, s] = n = rest if s == len(left) - 1 else hypergeometric(left[s], total - left[s], rest, rng) if rest and left[s] else 0
            total -= left[s]
            left[s] -= n
            rest -= n
    return out


def lines(rows: DataFrame, shards: int, n: int, parts: int, seed: int) -> DataFrame:
    """__part, __ends: for each partition of rows where its rows to each shard end."""
    groups = min(parts, max(GROUPS, -(-n // (LIBRARY_ROWS * 9 // 10))))
    counts = cut(rows.groupBy("__part").agg(F.count("*").alias("n")).withColumn("group", F.pmod("__part", F.lit(groups))))
    found = {r["group"]: r["n"] for r in counts.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    sent = matrix(np.array([found.get(g, 0) for g in range(groups)], np.int64), shard_sizes(n, shards), np.random.default_rng(seed))
    of_group = rows.sparkSession.createDataFrame([(g, [int(x) for x in row]) for g, row in enumerate(sent)], "group int, sizes array<long>")

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by("__part")
        group, sizes = table.column("group")[0].as_py(), table.column("sizes")[0].as_py()
        own = matrix(table.column("n").to_numpy(), np.array(sizes, np.int64), np.random.default_rng([seed, group]))
        return pa.table({"__part": table.column("__part"), "__ends": pa.array(own.cumsum(axis=1).tolist(), pa.list_(pa.int64()))})

    return cut(counts.join(F.broadcast(of_group), "group").groupBy("group").applyInArrow(draw, "__part long, __ends array<long>"))


def shuffle_rows(rows: DataFrame, shards: int = 16, seed: int = 7, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with shard and slot; counts of shards are at most one apart."""
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    # the id of a row in its input split tells equal rows apart; written once, so that a lost task repeats nothing else
    keyed = cut(rows.select(*columns, F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *columns).alias("__key")))
    n = keyed.count()
    parts = max(64, -(-n // part_rows))
    keyed = keyed.withColumn("__part", F.pmod(F.col("__key"), F.lit(parts)).cast("long"))
    ends = lines(keyed, shards, n, parts, seed)
    # local permutation: the order of a second hash
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), "__key"), "__key")
    dealt = join_by_size(keyed.withColumn("__rank", F.row_number().over(local)), ends, ["__part"], "inner")
    dealt = dealt.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))).cast("int")).drop("__ends", "__rank", "__part")
    # second permutation: blocks of a shard by the leading part of a third hash, then its order inside each
    per_shard = max(4, -(-n // (shards * part_rows)))
    dealt = dealt.withColumn("__again", F.xxhash64(F.lit(seed + 2), "__key")).withColumn("__block", F.pmod(F.col("__again"), F.lit(per_shard)).cast("int"))
    dealt = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__again", "__key")))
    dealt = cut(dealt)
    sizes = dealt.groupBy("shard", "__block").agg(F.max("__in").cast("long").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return join_by_size(dealt, before, ["shard", "__block"], "inner").select(*columns, "shard", (F.col("__before") + F.col("__in") - 1).cast("long").alias("slot"))
