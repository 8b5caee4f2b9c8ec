"""Benchmark decontamination with training suffix arrays.

Each shard of training text (about a megabyte of documents) gets a word-level suffix array: its suffixes in the order of as many words as a
window has, named by prefix doubling, so that no word is looked at twice. Every test suffix is named by the same tables, by binary search
at each doubling, and then binary-searched among the shard's suffixes. Matches that go on word by word on both sides are one longest
verbatim match, which tells where it stands and how long it is.

A benchmark of more than BLOCK_BYTES is taken a block at a time: one pass over the documents each, whose result is written before the
next block is collected, so that driver and executors hold one block only.

Words are compared by 64-bit hashes. Null texts and texts without words have no words and no hits; an
item without words has no window. Repeated rows give repeated results; items that repeat an id count as one item. Texts of any length are
read whole, since a shard holds whole documents. An empty table gives no rows, an empty benchmark no hits. Clashing column names do not
matter, since only the id and the text are read, and `decontaminate` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Words, chunks, mapped, store, with_own_names, word_table

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once; a larger benchmark takes more passes over the documents.
BLOCK_BYTES = 16 << 20
ALNUM = word_table("alnum")
#: What is said of a document.
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Bytes of text of a shard.
SHARD_BYTES = 1 << 20


@dataclass
class Tests:
    """The words of a block of items in one row, an item's number and id, and the word offsets of items."""

    ids: list
    hashes: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Tests:
        w = Words(pa.array([t for _, t in rows], pa.string()), ALNUM)
        return cls([i for i, _ in rows], w.hashes, w.bounds)


def shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """The rank that stands `by` places on; 0 beyond the end."""
    out = np.zeros_like(ranks)
    out[: max(0, len(ranks) - by)] = ranks[by:]
    return out


class SuffixArray:
    """Suffixes of a shard's words by their first n words, and test suffixes by the same names. Texts do not run into each other."""

    def __init__(self, words: Words, tests: Tests):
        # what is left of its text or item at each word, so that a name never reaches beyond
        self.left, self.test_left = (np.repeat(b[1:], np.diff(b)) - np.arange(b[-1]) for b in (words.bounds, tests.bounds))
        self.names: dict[int, tuple[np.ndarray, np.ndarray]] = {1: self._named(words.hashes, tests.hashes, np.ones(len(words.hashes), bool), np.ones(len(tests.hashes), bool))}

    @staticmethod
    def _named(own: np.ndarray, test: np.ndarray, own_ok: np.ndarray, test_ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks from 1 of the shard's keys, and those of equal test keys, found by binary search; 0 for none."""
        table, inverse = np.unique(own[own_ok], return_inverse=True)
        ranks, found = np.zeros(len(own), np.int64), np.zeros(len(test), np.int64)
        ranks[own_ok] = inverse + 1
        if len(table):
            keys = test[test_ok]
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            found[test_ok] = np.where(table[at] == keys, at + 1, 0)
        return ranks, found

    def _joined(self, first: tuple[np.ndarray, np.ndarray], k: int, second: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of n words from those of the first k and of the rest."""
        span = int(second[0].max(initial=0)) + 1
        keys, ok = [], []
        for a, b, left in zip(first, second, (self.left, self.test_left)):
            b = shifted(b, k)
            keys.append(a * span + b)
            ok.append((a > 0) & (b > 0) & (left >= n))
        return self._named(*keys, *ok)

    def ranks(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the first n words of the shard's and the tests' suffixes."""
        if n not in self.names:
            half = 1 << ((n - 1).bit_length() - 1)
            self.names[n] = self._joined(self.ranks(half), half, self.ranks(n - half), n)
        return self.names[n]

    def find(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of test suffix (index in `at`) and text position that agree in their first n words."""
        own, test = self.ranks(n)
        order = np.argsort(own, kind="stable")
        ranks, wanted = own[order], test[at]
        a, b = np.searchsorted(ranks, wanted, "left"), np.searchsorted(ranks, wanted, "right")
        count = np.where(wanted > 0, b - a, 0)
        which = np.repeat(np.arange(len(at)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        return which, order[place]


def windows_of(tests: Tests, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of a window: the places of windows of so many words, and the items that they are in."""
    n = np.diff(tests.bounds)
    need = np.minimum(n, window)
    for k in np.unique(need[need > 0]):
        own = np.flatnonzero(need == k)
        count = n[own] - k + 1
        item = np.repeat(own, count)
        yield int(k), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + tests.bounds[item], item


def matches(words: Words, tests: Tests, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Text number, first word in it, words, item number and first word in the item, of each longest match of a window or more."""
    out = [np.zeros((5, 0), np.int64)]
    if len(words.hashes) and len(tests.hashes):
        shard = SuffixArray(words, tests)
        for k, at, item in windows_of(tests, window):
            which, pos = shard.find(k, at)
            place, own = at[which], item[which]
            # matches that go on by a word on both sides lie on one diagonal, in a row
            order = np.lexsort((pos, pos - place))
            pos, place, own = pos[order], place[order], own[order]
            text = np.searchsorted(words.bounds, pos, "right") - 1
            new = np.ones(len(pos), bool)
            new[1:] = (pos[1:] != pos[:-1] + 1) | (place[1:] != place[:-1] + 1) | (own[1:] != own[:-1]) | (text[1:] != text[:-1])
            starts = np.flatnonzero(new)
            length = np.diff(np.append(starts, len(pos))) + k - 1
            pos, place, own, text = pos[starts], place[starts], own[starts], text[starts]
            out.append(np.array([text, pos - words.bounds[text], length, own, place - tests.bounds[own]]))
    return tuple(np.concatenate(out, axis=1))


def hits(words: Words, tests: Tests, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are in a window's occurrence, and the pairs of text number and item. Windows with equal words are searched once."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    pairs = [np.zeros((2, 0), np.int64)]
    if len(words.hashes) and len(tests.hashes):
        shard = SuffixArray(words, tests)
        for k, at, item in windows_of(tests, window):
            name = shard.ranks(k)[1][at]
            at, item, name = at[name > 0], item[name > 0], name[name > 0]
            _, first, same = np.unique(name, return_index=True, return_inverse=True)
            which, pos = shard.find(k, at[first])
            np.add.at(change, pos, 1)
            np.add.at(change, pos + k, -1)
            # texts that hold a window, each once, and then the window's items, each once
            text = np.searchsorted(words.bounds, pos, "right") - 1
            holds = np.unique(np.stack([which, text]), axis=1)
            of = np.unique(np.stack([same, item]), axis=1)
            a, b = np.searchsorted(of[0], holds[0], "left"), np.searchsorted(of[0], holds[0], "right")
            row = np.repeat(np.arange(len(a)), b - a)
            place = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            pairs.append(np.stack([holds[1][row], of[1][place]]))
    found = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return np.cumsum(change[:-1]) > 0, found[0], found[1]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in groups whose text is about block_bytes at most, each collected alone."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(part == k)).collect()]


def locate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per longest match of at least a window: id, first word, words, item, first word in the item."""
    spark, kind, item_kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for rows in blocks(benchmark, item_col, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Tests.of(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in chunks(batches, "text", SHARD_BYTES):
                text, first, length, item, item_first = matches(Words(batch.column("text"), ALNUM), tests, window)
                if len(text):
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(text)), pa.array(first), pa.array(length), pa.array([tests.ids[i] for i in item]), pa.array(item_first)], [id_col, "first_word", "n_match", "item_id", "item_word"])

        found = store(mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"{id_col} {kind}, first_word long, n_match long, item_id {item_kind}, item_word long"))
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


@with_own_names
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: it has hit words, and they are a twentieth of its words or more. An item without an id hits words like any other, but
    is not among the items that are counted and named.
    """
    found = _contamination(docs, benchmark, window, id_col, text_col, item_col, item_text, block_bytes, ())
    return found.select(id_col, *(F.col(f"__{c}").alias(c) for c in RESULTS))


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text: str, block_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """The id and the columns named in `keep`, and RESULTS with two underscores before their names."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("n")).first()["n"]
    if size > block_bytes:
        return _by_passes(docs, benchmark, window, id_col, text_col, item_col, item_text, block_bytes, keep)
    shared = docs.sparkSession.sparkContext.broadcast(Tests.of([tuple(r) for r in benchmark.select(item_col, item_text).collect()]))
    kept = [c for c in dict.fromkeys((id_col, *keep))]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in chunks(batches, "__text", SHARD_BYTES):
            words = Words(batch.column("__text"), ALNUM)
            n = np.diff(words.bounds)
            inside, text, item = hits(words, tests, window)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for t, i in zip(text.tolist(), item.tolist()):
                if tests.ids[i] is not None:
                    items[t].add(str(tests.ids[i]))
            hit = np.concatenate(([0], np.cumsum(inside)))
            n_hit = hit[words.bounds[1:]] - hit[words.bounds[:-1]]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array((n_hit > 0) & (20 * n_hit >= n))],
                [*kept, *(f"__{c}" for c in RESULTS)],
            )

    return mapped(docs.select(*kept, F.col(text_col).alias("__text")), run, f"{fields}, __n_words long, __n_hit long, __n_items long, __items_sha256 string, __contaminated boolean")


def _by_passes(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text: str, block_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark too large to broadcast at once: one pass a block, whose spans then meet per text."""
    kept = [F.col(c) for c in dict.fromkeys((id_col, *keep))]
    text = F.col(text_col)
    rows = docs.select(*kept, text.alias("__text"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("__key"))
    spans = locate(rows.select("__key", "__text"), benchmark, window, "__key", "__text", item_col, item_text, block_bytes)
    merged = F.aggregate(
        F.array_sort("__spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(a["end"], s["a"]))).alias("n"), F.greatest(a["end"], s["b"]).alias("end")),
    )["n"]
    found = spans.groupBy("__key").agg(
        F.collect_set(F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_match")).alias("b"))).alias("__spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("__items")
    )
    n_words = F.size(F.filter(F.split(F.coalesce(F.col("__text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")
    out = rows.join(found, "__key", "left").select(
        *kept, n_words.alias("__n_words"), F.coalesce(merged, F.lit(0)).alias("__n_hit"), F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("__n_items"), F.sha2(F.coalesce(F.array_join("__items", ","), F.lit("")).cast("binary"), 256).alias("__items_sha256")
    )
    return out.withColumn("__contaminated", (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words")))


@with_own_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = _contamination(docs, benchmark, window, id_col, text_col, item_col, item_text, block_bytes, tuple(docs.columns))
    return found.where(~F.col("__contaminated")).select(*docs.columns)
