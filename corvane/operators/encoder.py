"""A text encoder that is fitted on the corpus, and a classifier of windows on top of it.

Words fall into hashed buckets, weighted by tf-idf. The directions that hold most of the rows' variation are found by a randomised
singular value decomposition: texts are read once and their words' counts stored, a random basis goes through X'X a few times, each time as a
sum over partitions, and is made orthogonal on the driver, where nothing is larger than buckets x dimensions. A text's vector is its weights in these directions, scaled to length 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import bound
from corvane.operators.joins import spread
from corvane.operators.neighbour_index import matrix
from corvane.operators.partition_sums import summed
from corvane.operators.studies import _cut

#: Buckets that words are hashed into, dimensions of a vector, further directions that the search carries, and passes of X'X.
BUCKETS, DIMS, SPARE, PASSES = 4_096, 64, 16, 3
#: Texts whose weights are one matrix, and words whose buckets a task remembers.
CHUNK, KNOWN = 256, 262_144
#: Words of a window and of the step from one to the next.
WINDOW, STEP = 128, 64

_WORDS = re.compile(r"\w{2,}").findall


class _Buckets(dict):
    """The bucket of each word that a task has met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        at = self[word] = zlib.crc32(word.encode()) % BUCKETS
        return at


def _counted(texts: list[str | None], buckets: _Buckets) -> np.ndarray:
    """How often each text has words of each bucket: texts x buckets."""
    found = [[buckets[word] for word in _WORDS((text or "").lower())] for text in texts]
    n = np.array([len(f) for f in found], np.int64)
    at = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())) + np.repeat(np.arange(len(texts)) * BUCKETS, n)
    return np.bincount(at, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def _scaled(at: np.ndarray, n: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """Weights (rows x buckets) by places in that matrix and counts above 0; each row's weights have length 1."""
    x = np.zeros(rows * BUCKETS)
    x[at] = (1 + np.log(n)) * idf[at % BUCKETS]
    x = x.reshape(rows, BUCKETS)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def _weights(texts: list[str | None], idf: np.ndarray, buckets: _Buckets) -> np.ndarray:
    counts = _counted(texts, buckets).ravel()
    at = np.flatnonzero(counts)
    return _scaled(at, counts[at], len(texts), idf)


def _weighted(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of all words of texts."""
    x = _weights(texts, idf, _Buckets())
    row, at = np.nonzero(x)
    return row, at, x[row, at]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, CHUNK):
        yield batch.slice(start, CHUNK)


def _terms(rows: DataFrame, text: str) -> DataFrame:
    """Buckets (at) and counts (n) of each text's words, stored, so that the passes of a fit read numbers and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            for part in _chunks(batch):
                counts = _counted(part.column("text").to_pylist(), buckets)
                row, at = np.nonzero(counts)
                offsets = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (at.astype(np.int16), counts[row, at].astype(np.int32))], ["at", "n"])

    return _cut(spread(rows.select(F.col(text).alias("text"))).mapInArrow(run, "at array<smallint>, n array<int>"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


@dataclass(frozen=True)
class Encoder:
    """Weights of buckets, the directions (buckets x dimensions) that texts are projected on, and what tuning turns vectors by."""

    idf: np.ndarray
    basis: np.ndarray
    turn: np.ndarray | None = None

    def encode(self, rows: DataFrame, text: str, vector: str = "vector") -> DataFrame:
        """The rows with the vector of each whole text; texts without words have the zero vector."""
        idf, basis, turn = self.idf, self.basis, self.turn
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets = _Buckets()
            for batch in batches:
                for part in _chunks(batch):
                    x = _weights(part.column(text).to_pylist(), idf, buckets) @ basis
                    x = _unit(x) if turn is None else _unit(_unit(x) @ turn)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, vector])

        return rows.mapInArrow(run, f"{kinds}, `{vector}` array<double>")

    def turned(self, rows: DataFrame, vector: str) -> DataFrame:
        """Rows whose vectors were made before tuning, with those of after it; no text is read again."""
        turn = self.turn
        if turn is None:
            return rows
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(matrix(batch.column(vector)) @ turn)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([lists if c == vector else batch.column(c) for c in batch.schema.names], batch.schema.names)

        return rows.mapInArrow(run, kinds)


def fit_encoder(rows: DataFrame, text: str, dims: int = DIMS, seed: int = 7) -> Encoder:
    """An encoder of all texts of a table. Null and empty texts count as texts without words."""
    terms = _terms(rows, text)

    def documents(batch: pa.RecordBatch, out: np.ndarray) -> None:
        out[:BUCKETS] += np.bincount(batch.column("at").flatten().to_numpy(), minlength=BUCKETS)
        out[BUCKETS] += batch.num_rows

    counted = summed(terms, documents, (BUCKETS + 1,))
    idf = np.log((1 + counted[BUCKETS]) / (1 + counted[:BUCKETS])) + 1
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(BUCKETS, dims + SPARE)))[0]
    for _ in range(PASSES):

        def back(batch: pa.RecordBatch, out: np.ndarray, basis: np.ndarray = basis) -> None:
            for part in _chunks(batch):
                of = np.repeat(np.arange(part.num_rows) * BUCKETS, pc.list_value_length(part.column("at")).to_numpy())
                x = _scaled(of + part.column("at").flatten().to_numpy(), part.column("n").flatten().to_numpy(), part.num_rows, idf)
                out += x.T @ (x @ basis)

        product = summed(terms, back, basis.shape)
        small = basis.T @ product  # of X'X in the basis it went through
        basis, last = np.linalg.qr(product)[0], basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    found = last @ vectors[:, np.argsort(-values)[:dims]]
    # the sign of a direction is free: its greatest part is positive
    found *= np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return Encoder(idf, found)


def tuned(encoder: Encoder, rows: DataFrame, text: str, label: str, ridge: float = 0.05) -> Encoder:
    """The encoder, turned so that texts of one label come closer: directions in which texts of one label differ count less.

    All pairs of equal labels are taken at once, as the scatter around the labels' means, which is a sum over partitions. Rows without a label
    or without words are left out; a label of one text tells nothing. `ridge` keeps directions that hardly vary from counting too much.
    """
    known = rows.select(F.col(label).cast("string").alias("y"), F.col(text).alias("text")).where("y IS NOT NULL")
    return tuned_by(encoder, encoder.encode(known, "text"), "vector", "y", ridge)


def tuned_by(encoder: Encoder, rows: DataFrame, vector: str, label: str, ridge: float = 0.05) -> Encoder:
    """`tuned` by vectors that the encoder has made already."""
    known = rows.select(F.col(label).cast("string").alias("y"), F.col(vector).alias("vector")).where("y IS NOT NULL")
    labels = {r["y"]: i for i, r in enumerate(known.select("y").distinct().collect())}  # a row a class
    k, c = encoder.basis.shape[1], len(labels)

    def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
        x = matrix(batch.column("vector"))
        x1 = np.hstack([x, (np.abs(x).sum(axis=1) > 0)[:, None]])
        np.add.at(out, [labels[y] for y in batch.column("y").to_pylist()], x1)
        out[c:, :k] += x.T @ x

    found = summed(known, add, (c + k, k + 1))
    sums, n = found[:c, :k], np.maximum(found[:c, k:], 1)
    within = (found[c:, :k] - (sums / n).T @ sums) / max(1.0, found[:c, k].sum())
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    floor = max(ridge * float(np.maximum(values, 0).mean()), 1e-12)
    return Encoder(encoder.idf, encoder.basis, (vectors / np.sqrt(np.maximum(values, 0) + floor)) @ vectors.T)


def windows(rows: DataFrame, text: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """The rows, one for each window of `size` words of their text every `step` words, to the window that holds the last word: `window`, its
    text, `at`, its first word's place, and `until`. Texts without words have none."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - size) / step), F.lit(0)).cast("int"))
    cut = lambda w: F.transform(starts(w), lambda i: F.struct((i * step).alias("at"), F.least(i * step + size, F.size(w)).alias("until"), F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ").alias("window")))
    found = bound(words, lambda w: F.when(F.size(w) > 0, cut(w)))
    return rows.select(*(c for c in rows.columns if c != text), F.explode(found).alias("w")).select("*", "w.*").drop("w")


def encoded(encoder: Encoder, rows: DataFrame, text: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """The windows of the texts with their `vector`, without their texts."""
    return encoder.encode(windows(spread(rows), text, size, step), "window").drop("window")


@dataclass(frozen=True)
class WindowClassifier:
    """A softmax regression on encoded windows."""

    encoder: Encoder
    labels: tuple[str, ...]
    model: LogisticRegressionModel

    def classify(self, rows: DataFrame, text: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
        """Each window of the texts with its `label`, that of the greatest probability (ties: the first name), and its `confidence`."""
        return self.classified(encoded(self.encoder, rows, text, size, step))

    def classified(self, found: DataFrame) -> DataFrame:
        """`classify` of windows that the encoder has encoded already."""
        scored = self.model.transform(found.withColumn("features", array_to_vector("vector")))
        p = vector_to_array("probability")
        best = F.array_position(p, F.array_max(p)).cast("int")
        return scored.select(*(c for c in found.columns if c != "vector"), F.element_at(F.array(*map(F.lit, self.labels)), best).alias("label"), F.array_max(p).alias("confidence"))


def fit_classifier(rows: DataFrame, text: str, label: str, encoder: Encoder, size: int = WINDOW, step: int = STEP, iterations: int = 40) -> WindowClassifier:
    """Learns the label of a text's windows. Gradients are summed over partitions by the solver; rows without a label are left out."""
    known = rows.select(F.col(label).cast("string").alias("y"), F.col(text).alias("text")).where("y IS NOT NULL")
    # the solver reads its rows several times
    return classifier_by(_cut(encoded(encoder, known, "text", size, step)), "y", encoder, iterations)


def classifier_by(found: DataFrame, label: str, encoder: Encoder, iterations: int = 40) -> WindowClassifier:
    """`fit_classifier` by windows that the encoder has encoded and that are stored: they are read several times."""
    known = found.select(F.col(label).cast("string").alias("y"), "vector").where("y IS NOT NULL")
    labels = tuple(sorted(r["y"] for r in known.select("y").distinct().collect()))  # a row a class
    place = F.create_map(*(x for i, y in enumerate(labels) for x in (F.lit(y), F.lit(float(i)))))
    train = known.select(array_to_vector("vector").alias("features"), place[F.col("y")].alias("label"))
    solver = LogisticRegression(family="multinomial", maxIter=iterations, regParam=1e-4, standardization=False)
    return WindowClassifier(encoder, labels, solver.fit(train))


def sections(classified: DataFrame, key: str) -> DataFrame:
    """key, label, confidence, windows, at, until: the windows of a text put together by label; the greatest confidence counts."""
    return classified.groupBy(key, "label").agg(F.max("confidence").alias("confidence"), F.count("*").alias("windows"), F.min("at").alias("at"), F.max("until").alias("until"))


def main_label(found: DataFrame, key: str) -> DataFrame:
    """The label of most windows of each text (ties: the more confident one, then the first name)."""
    order = Window.partitionBy(key).orderBy(F.desc("windows"), F.desc("confidence"), "label")
    return found.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(key, "label", "confidence")
