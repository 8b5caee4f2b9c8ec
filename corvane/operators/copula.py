"""Synthetic rows with the distributions and correlations of a table: a Gaussian copula.

Every column is turned into normal scores by its distribution function: a numeric one by a grid of quantiles, one with categories by the
cumulated shares of these, in the order of their names. The scores' correlation matrix is a sum over partitions. Rows are drawn by keyed
hashes of their number, so the same key gives the same rows however they are dealt out, correlated by the matrix's Cholesky factor, and turned back
by the same distributions. Nulls keep their share, and are drawn on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, NumericType, StructType

from corvane.operators.partition_sums import summed

#: Steps of the quantile grid of a numeric column, and its accuracy: places are right within 1 / ACCURACY of the rows.
GRID, ACCURACY = 400, 20_000
#: Categories that a column may have; a column of more is no category, and raises.
MOST_CATEGORIES = 1_000

_NORMAL = NormalDist()
_SHARES = np.clip(np.linspace(0, 1, GRID + 1), 0.25 / GRID, 1 - 0.25 / GRID)
_SCORES = np.array([_NORMAL.inv_cdf(p) for p in _SHARES])


@dataclass(frozen=True)
class Marginal:
    """The distribution of a column: values at the grid's shares, or categories with the normal scores of their upper ends."""

    name: str
    kind: DataType
    nulls: float
    values: tuple
    numeric: bool
    ends: tuple = ()

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Normal scores, and which rows have one. Of equal quantiles the middle one counts, of a category the middle of its share."""
        known = ~np.asarray(column.is_null())
        out = np.zeros(len(column))
        if not len(self.values):
            return out, np.zeros(len(column), bool)
        if self.numeric:
            x = column.cast(pa.float64(), safe=False).fill_null(0.0).to_numpy(zero_copy_only=False)
            known &= ~np.isnan(x)
            grid = np.asarray(self.values)
            # a value between two quantiles lies between their scores, a value of many equal ones in their middle
            low, high = np.searchsorted(grid, x, "left"), np.searchsorted(grid, x, "right")
            out = np.where(high > low, (_SCORES[np.minimum(low, GRID)] + _SCORES[np.maximum(high - 1, 0)]) / 2, np.interp(x, grid, _SCORES))
        else:
            shares = np.array([0.0, *(_NORMAL.cdf(e) if np.isfinite(e) else 1.0 for e in self.ends)])
            middle = {v: _NORMAL.inv_cdf(min(max((a + b) / 2, 1e-9), 1 - 1e-9)) for v, a, b in zip(self.values, shares, shares[1:])}
            out = np.array([middle.get(v, 0.0) for v in column.to_pylist()], np.float64)
        return np.where(known, out, 0.0), known

    def drawn(self, scores: np.ndarray, nulls: np.ndarray) -> pa.Array:
        """Values of normal scores."""
        kind = to_arrow_type(self.kind)
        none = nulls < self.nulls
        if not len(self.values):
            return pa.nulls(len(scores), kind)
        if self.numeric:
            grid = np.asarray(self.values)
            # few distinct values are steps, between which there is nothing
            steps = len(np.unique(grid)) <= GRID // 4
            x = grid[np.clip(np.searchsorted(_SCORES, scores), 0, GRID)] if steps else np.interp(scores, _SCORES, grid)
            whole = pa.types.is_integer(kind)
            return pa.array(np.rint(x) if whole else x, mask=none).cast(kind, safe=False)
        at = np.minimum(np.searchsorted(np.asarray(self.ends), scores, "left"), len(self.values) - 1)
        return pa.array([None if n else self.values[i] for i, n in zip(at, none)], kind)


@dataclass(frozen=True)
class Copula:
    """Marginals and the correlation matrix of their normal scores."""

    marginals: tuple[Marginal, ...]
    correlation: np.ndarray

    def rows(self, spark: SparkSession, n: int, key: str = "synthetic", id_col: str = "id") -> DataFrame:
        """n rows: their number and the columns. Rows depend on the key and their number only."""
        marginals, k = self.marginals, len(self.marginals)
        factor = np.linalg.cholesky(self.correlation) if k else np.zeros((0, 0))
        # a share of 2 ** 52 for each draw: two a column for its normal score, one for its nulls
        draw = lambda name: (F.pmod(F.xxhash64(F.lit(f"{key}|{name}"), F.col("n")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        draws = F.array(*(draw(f"{m.name}|{part}") for m in marginals for part in ("radius", "angle", "null")), F.lit(0.0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("u").flatten().to_numpy().reshape(batch.num_rows, 3 * k + 1)
                z = np.sqrt(-2 * np.log(u[:, 0 : 3 * k : 3])) * np.cos(2 * np.pi * u[:, 1 : 3 * k : 3])
                z = z @ factor.T
                yield pa.RecordBatch.from_arrays([batch.column("n"), *(m.drawn(z[:, j], u[:, 3 * j + 2]) for j, m in enumerate(marginals))], [id_col, *(m.name for m in marginals)])

        schema = StructType().add(id_col, "long")
        for m in marginals:
            schema = schema.add(m.name, m.kind)
        return spark.range(n).select(F.col("id").alias("n"), draws.alias("u")).mapInArrow(run, schema)


def _marginal(rows: DataFrame, name: str, total: int) -> Marginal:
    kind = rows.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, NumericType):
        x = column.cast("double")
        known = rows.where(x.isNotNull() & ~F.isnan(x))
        found = known.agg(F.percentile_approx(x, [i / GRID for i in range(GRID + 1)], ACCURACY).alias("q"), F.count("*").alias("n")).first()
        return Marginal(name, kind, 1 - found["n"] / total if total else 0.0, tuple(found["q"] or ()), True)
    counts = rows.groupBy(column.alias("v")).agg(F.count("*").alias("n")).limit(MOST_CATEGORIES + 2).collect()
    if len([r for r in counts if r["v"] is not None]) > MOST_CATEGORIES:
        raise ValueError(f"{name} has more than {MOST_CATEGORIES} categories")
    known = sorted((r["v"], r["n"]) for r in counts if r["v"] is not None)
    n = sum(c for _, c in known)
    shares = np.cumsum([c for _, c in known]) / n if n else np.zeros(0)
    ends = tuple(_NORMAL.inv_cdf(s) if s < 1 - 1e-12 else float("inf") for s in shares)
    return Marginal(name, kind, 1 - n / total if total else 0.0, tuple(v for v, _ in known), False, ends)


def fit(rows: DataFrame, columns: list[str]) -> Copula:
    """A copula of the columns: numbers, or strings, dates and booleans of up to MOST_CATEGORIES values.

    Correlations are those of the rows where both columns are known. A table without rows gives nulls only; a column of one value, that value.
    """
    total = rows.count()
    marginals = tuple(_marginal(rows, c, total) for c in columns)
    k = len(marginals)

    def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
        scored = [m.scores(batch.column(i)) for i, m in enumerate(marginals)]
        z, known = np.array([s for s, _ in scored]), np.array([w for _, w in scored], np.float64)
        out[0] += known @ known.T
        out[1] += z @ z.T
        out[2] += z @ known.T
        out[3] += (z * z) @ known.T

    n, products, sums, squares = summed(rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))), add, (4, k, k))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = sums / n
        spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
        r = (products / n - mean * mean.T) / (spread * spread.T)
    # a column of one value, and one that is never known beside another, go with nothing
    r = np.where((n > 0) & (np.minimum(spread, spread.T) > 1e-6), np.clip(np.nan_to_num(r), -1, 1), 0.0)
    np.fill_diagonal(r, 1)
    # pairs with unlike nulls may give a matrix that is none; the nearest one by its eigenvalues is
    values, vectors = np.linalg.eigh((r + r.T) / 2) if k else (np.zeros(0), np.zeros((0, 0)))
    fixed = (vectors * np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return Copula(marginals, fixed / np.outer(scale, scale))
