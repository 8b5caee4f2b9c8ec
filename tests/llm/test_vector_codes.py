"""Vector codes against a plain search of every entry with Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import queries, vector_codes
from corvane.llm.common import read_table

SCHEMA = "vec_id long, embedding array<double>, label int, code string, vector string"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (id, vector, label). Returns {id: [(code, error, label_error)]} and the codebooks' digest."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first: dict = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    dim = len(seeds[0])
    kept = [r for r in kept if len(r[1]) == dim]
    w = dim // parts
    books = [[s[p * w : p * w + w] for s in seeds] for p in range(parts)]

    def assign(v, p):
        part = v[p * w : p * w + w]
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups: dict = {}
        for _, v, _ in kept:
            for p in range(parts):
                groups.setdefault((p, assign(v, p)[0]), []).append(v[p * w : p * w + w])
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    coded = [(i, [assign(v, p) for p in range(parts)], y) for i, v, y in kept]
    sums: dict = {}
    for _, found, y in coded:
        sums[y] = sums.get(y, 0) + sum(d for _, d in found)
    out: dict = {}
    for i, found, y in coded:
        out.setdefault(i, []).append(("".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found), sums[y]))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {i: sorted(v) for i, v in out.items()}, digest


def rows_of(df):
    out: dict = {}
    digests = set()
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append((r["code"], r["error"], r["label_error"]))
        digests.add(r["codebooks_sha256"])
    return {i: sorted(v) for i, v in out.items()}, digests


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", "v") for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("spread, entries, width", [(3, 5, 1), (40, 64, 4), (2, 30, 3), (1 << 20, 17, 8)])
def test_search_equals_all_distances(spread, entries, width):
    """Small spreads give many ties; the lowest index wins."""
    rng = np.random.default_rng(entries)
    rows, book = rng.integers(-spread, spread, (3000, width)), rng.integers(-spread, spread, (entries, width))
    d = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    code, distance = vector_codes.nearest(rows, book)
    assert (code == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    none = vector_codes.nearest(rows[:0], book)
    assert len(none[0]) == len(none[1]) == 0


def test_components_go_by_variance():
    book = np.array([[0, 5, 1], [0, -5, 2], [0, 9, 3]])
    assert vector_codes.order_of(book).tolist() == [1, 2, 0]


def mixed_rows(seed, n=400, dim=32):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([None, 0, 1, 1, 1, 1, 2])) for i in range(n)]
    rows += [(n + i, list(rows[7][1]), 1) for i in range(150)]  # a hot vector and label
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * dim, 2), (2003, [0.5] * (dim - 1) + [float("nan")], 2), (2004, [0.5] * (dim - 1) + [float("inf")], None)]
    rows += [(2005, [0.1] * (dim // 2), 1), (None, [0.25] * dim, None), (3, [9.0] * dim, 1), (3, list(rows[3][1]), 0), (-4, [-0.001] * dim, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_codes(spark, seed):
    rows = mixed_rows(seed)
    want, digest = plain(rows)
    got, digests = rows_of(vector_codes.vector_codes(frame(spark, rows).repartition(5)))
    assert got == want and digests == {digest}


def test_blocks_and_labels_of_other_types(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    rows = mixed_rows(3, 60)
    want, digest = plain(rows, parts=4, entries=9, rounds=3, scale=100)
    named = frame(spark, rows).selectExpr("cast(vec_id as string) as vec_id", "embedding", "cast(label as string) as label")
    got, digests = rows_of(vector_codes.vector_codes(named, parts=4, entries=9, rounds=3, scale=100))
    by_text = plain([(None if i is None else str(i), v, y) for i, v, y in rows], parts=4, entries=9, rounds=0, scale=100)[0]
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in by_text.items()} and len(digests) == 1
    got, digests = rows_of(vector_codes.vector_codes(frame(spark, rows), parts=4, entries=9, rounds=3, scale=100))
    assert got == want and digests == {digest}


def test_few_rows_and_none(spark):
    rows = [(1, [0.5] * 16, 3), (2, [1.0] * 16, 3)]
    want, digest = plain(rows)
    got, digests = rows_of(vector_codes.vector_codes(frame(spark, rows)))
    assert got == want and digests == {digest}
    for none in (frame(spark, rows).limit(0), frame(spark, [(1, None, 2)])):
        df = vector_codes.vector_codes(none)
        assert df.count() == 0 and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_refusals(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(frame(spark, [(1, [0.5] * 15, 3)]))
    with pytest.raises(ValueError, match="256"):
        vector_codes.vector_codes(frame(spark, [(1, [0.5] * 16, 3)]), entries=300)
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.whole_numbers(pa.array([[1e30]]), 1, 256)


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in read_table(spark, path, "embeddings").select("vec_id", "embedding", "label").collect()]
    want, digest = plain(rows)
    got, digests = rows_of(queries.op12_vector_codes(spark, path))
    assert got == want and digests == {digest}
