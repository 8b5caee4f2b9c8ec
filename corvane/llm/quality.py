"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each whole text becomes a short vector of statistics. Cosines of random projections approximate a Gaussian
kernel over them. Partitions sum their normal equations, the driver adds a few partial sums and solves
one system whose size is a parameter. Scores are calibrated by isotonic regression over a fixed number of bins, on rows that
the weights were not fitted on: each of two folds is scored by the weights of the other. The final weights are those of both.
Calibrated values run straight between the middles of the regression's steps, so that few scores tie.

Null and empty texts have zero statistics and are scored like any other. Without labelled rows every score is
0.5; with labels of one kind it is that kind. Several labels of one id count as their mean, null labels and
null ids as none. Repeated rows give repeated results, equal texts equal scores; an empty table gives no rows. Texts of any length are
read whole; a chunk holds one long text alone. Columns that are kept may have any names but those of the results; `keep_good` keeps them
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Words, chunks, cut, mapped, text_bytes, with_own_names, word_table

#: Cosine features.
N_COSINES = 160
RIDGE = 1e-3
SEED = 20
BINS = 4096
#: Partial sums that reach the driver.
SLOTS = 16
SPACE = word_table("space")
NAMES = ["log_bytes", "log_words", "word_len", "word_len_sd", "upper", "digit", "high", "line", "common_punct", "strong_punct", "odd_punct", "pipe", "space", "distinct", "distinct_lines", "capital_words", "short_words", "long_words", "repeat_next", "odd_words", "line_words"]


def _fractions(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n).astype(float)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_COMMON, _STRONG, _ODD = _table(b".,;:'\"-()"), _table(b"!?"), _table(b"#$%&*@^~=+<>{}[]\\/_`")
_LINES = np.ones(256, bool)
_LINES[10] = False


def statistics(values: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    data, offs = text_bytes(values)
    n = len(offs) - 1
    words = Words(values, SPACE)
    text_of = np.repeat(np.arange(n), np.diff(words.bounds))
    length = (words.ends - words.starts).astype(float)
    size, count = np.diff(offs).astype(float), np.diff(words.bounds).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    sums = lambda x: np.bincount(text_of, weights=x, minlength=n)
    mean = sums(length) * per_word
    spread = np.sqrt(np.maximum(sums(length**2) * per_word - mean**2, 0))
    lines = Words(values, _LINES)
    line_of = np.repeat(np.arange(n), np.diff(lines.bounds))
    n_lines = np.maximum(np.diff(lines.bounds), 1)
    upper_at = np.concatenate(([0], np.cumsum(_UPPER[data])))
    capital = (upper_at[words.ends] - upper_at[words.starts]) >= np.maximum(2, 0.6 * length)
    odd_at = np.concatenate(([0], np.cumsum(_ODD[data] | _STRONG[data])))
    odd = (odd_at[words.ends] - odd_at[words.starts]) >= 2
    again = np.zeros(len(length))
    if len(length) > 1:
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    share = lambda t: _fractions(t[data], offs) * per_byte
    high = np.zeros(256, bool)
    high[128:] = True
    columns = [
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), share(_UPPER), share(_DIGIT), share(high), _fractions(data == 10, offs) * per_word, share(_COMMON), share(_STRONG), share(_ODD), share(_table(b"|")), share(_table(b" \t")),
        _distinct(text_of, words.hashes, n) * per_word, _distinct(line_of, lines.hashes, n) / n_lines, sums(capital) * per_word, sums(length <= 3) * per_word, sums(length >= 12) * per_word, sums(again) * per_word, sums(odd) * per_word, np.log1p(count / n_lines),
    ]
    return np.column_stack(columns)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), score: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """id, the columns named in `keep`, and __stats array<double>; with `score`, which takes these, __score double in their place.

    A second pass over the rows would need a second Python worker beside each task's first.
    """
    kept = list(dict.fromkeys((id_col, *keep)))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            x = statistics(batch.column("__text"))
            last = pa.array(score(x)) if score else pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), last], [*kept, "__score" if score else "__stats"])

    return mapped(docs.select(*kept, F.col(text_col).alias("__text")), run, f"{fields}, {'`__score` double' if score else '`__stats` array<double>'}")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


@dataclass
class Model:
    """Standardisation, cosine projections, ridge weights, and calibrated values by bin of the raw score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None
    constant: float = 0.5

    def cosines(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        w, b = rng.normal(size=(d, N_COSINES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, N_COSINES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / N_COSINES), np.ones(len(x))])

    def bins(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        raw = self.cosines(x) @ (self.weights if weights is None else weights)
        return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.steps is None else self.steps[self.bins(x)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("__stats").flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(NAMES)))


def isotonic(value: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, int]]:
    """Steps (value, weight, points) of the least-squares rising fit, by pooling adjacent violators."""
    blocks: list[tuple[float, float, int]] = []
    for v, w in zip(value, weight):
        blocks.append((v, w, 1))
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (va, wa, na), (vb, wb, nb) = blocks[-2:]
            blocks[-2:] = [((va * wa + vb * wb) / (wa + wb), wa + wb, na + nb)]
    return blocks


def calibration(at: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A value for each bin, from the bins that have rows, their counts and sums of labels.

    A step's value has one more row, of the mean label; values run straight between the steps' middles.
    """
    mean, first, middle, value = y.sum() / n.sum(), 0, [], []
    for v, w, points in isotonic(y / n, n):
        own = slice(first, first + points)
        middle.append((at[own] * n[own]).sum() / w)
        value.append((v * w + mean) / (w + 1))
        first += points
    return np.clip(np.interp(np.arange(BINS), middle, np.maximum.accumulate(value)), 0, 1)


def solve(sums: np.ndarray, n: int) -> np.ndarray:
    """Ridge weights of summed normal equations: the upper triangle of the matrix, then the right side."""
    size = N_COSINES + 1
    upper = np.triu_indices(size)
    a = np.zeros((size, size))
    a[upper] = sums[: len(upper[0])]
    a = a + np.triu(a, 1).T
    penalty = np.full(size, RIDGE * n / size)
    penalty[-1] = 0
    return np.linalg.solve(a + np.diag(penalty + 1e-9), sums[len(upper[0]) :])


def fit(train: DataFrame) -> Model:
    """A model of rows with __stats, y (0 to 1) and fold (0 or 1)."""
    d = len(NAMES)
    stat = F.col("__stats")
    row = train.agg(F.count("y").alias("n"), F.sum("fold").alias("ones"), F.avg("y").alias("y"), *(F.avg(stat[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(stat[i]).alias(f"s{i}") for i in range(d))).first()
    if not row["n"]:
        return Model(np.zeros(d), np.ones(d))
    scale = np.array([row[f"s{i}"] for i in range(d)])
    model = Model(np.array([row[f"m{i}"] for i in range(d)]), np.where(scale > 1e-9, scale, 1.0), constant=row["y"])
    if row["y"] in (0.0, 1.0):
        return model
    size = N_COSINES + 1
    upper = np.triu_indices(size)
    width = len(upper[0]) + size

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros((2, width))
        for batch in batches:
            z, y, fold = model.cosines(_matrix(batch)), np.asarray(batch.column("y"), float), np.asarray(batch.column("fold"))
            for f in (0, 1):
                zf = z[fold == f]
                out[f] += np.concatenate([(zf.T @ zf)[upper], zf.T @ y[fold == f]])
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([out.tobytes()])], ["slot", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * width)
        for batch in batches:
            for b in batch.column("sums").to_pylist():
                out += np.frombuffer(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["sums"])

    parts = mapped(train.select("__stats", "y", "fold"), partial, "slot long, sums binary").repartition(SLOTS, "slot").select("sums")
    parts = mapped(parts, total, "sums binary")
    sums = np.zeros(2 * width)
    for r in parts.toLocalIterator():
        sums += np.frombuffer(r["sums"])
    sums = sums.reshape(2, width)
    model.weights = solve(sums.sum(axis=0), row["n"])
    # the weights that score a fold are those of the other; a fold alone has the only ones there are
    other = [solve(sums[1 - f], n) if n else model.weights for f, n in enumerate((row["ones"], row["n"] - row["ones"]))]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, y = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            x, label, fold = _matrix(batch), np.asarray(batch.column("y"), float), np.asarray(batch.column("fold"))
            for f in (0, 1):
                b = model.bins(x[fold == f], other[f])
                n += np.bincount(b, minlength=BINS)
                y += np.bincount(b, label[fold == f], minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(y[at])], ["bin", "n", "y"])

    rows = mapped(train.select("__stats", "y", "fold"), binned, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.steps = calibration(*(np.array([r[k] for r in rows], float) for k in ("bin", "n", "y")))
    return model


def train_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Statistics, labels and folds of the rows that may be learnt from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    own = stats.where(~held_out(id_col)).select(F.col(id_col).alias("__id"), "__stats")
    return own.join(known, "__id").select("__stats", "y", F.pmod(F.xxhash64("__id"), F.lit(2)).cast("int").alias("fold"))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep: tuple[str, ...]) -> DataFrame:
    """id, the columns named in `keep`, and __score."""
    kept = list(dict.fromkeys((id_col, *keep)))
    stats = cut(features(docs, id_col, text_col))
    model = fit(train_rows(stats, labels, id_col, label_col))
    # without further columns the statistics at hand are scored; else the texts are read again, rather than shuffled
    if len(kept) > 1:
        return features(docs, id_col, text_col, keep, model.score)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(_matrix(batch)))], [*kept, "__score"])

    return mapped(stats, run, f"{fields}, `__score` double")


@with_own_names
def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score, predicted for every document, and the columns named in `keep`."""
    score = F.col("__score")
    return _scored(docs, labels, id_col, text_col, label_col, keep).select(*dict.fromkeys((id_col, *keep)), held_out(id_col).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@with_own_names
def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    return _scored(docs, labels, id_col, text_col, label_col, tuple(docs.columns)).where("__score >= 0.5").select(*docs.columns)
