"""Spelling variants against comparisons of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from corvane.llm import queries, spelling
from corvane.llm.common import read_table
from tests.llm.helpers import frame


def edits(word: str, letters: str) -> set[str]:
    """All strings that are one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def counted(rows, least_letters=6, least_count=5, every=199) -> Counter:
    out: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_letters:
                out[run] += 1
    return Counter({w: n for w, n in out.items() if n >= least_count})


def expected(words: dict[str, int], times=5) -> dict[str, tuple]:
    letters = "".join(sorted(set("".join(words))))
    near = {w: edits(w, letters) & words.keys() for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows_of(df) -> dict[str, tuple]:
    got = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r["word"] for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


@pytest.mark.parametrize("letters, length", [("ab", 9), ("abcü", 6), ("a", 30), ("abcdefgh", 5)])
def test_tries_find_every_pair_once(letters, length):
    rng = random.Random(length)
    words = list({"".join(rng.choices(letters, k=rng.randrange(0, length + 1))) for _ in range(600)})
    rng.shuffle(words)
    got = [tuple(sorted((words[a], words[b]))) for a, b in spelling.one_edit_pairs(words)]
    want = {tuple(sorted((w, x))) for w in words for x in edits(w, letters) & set(words)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most_words, most_letters", [(4096, 1 << 19), (3, 1 << 19), (4096, 40)])
def test_near_words_with_groups_of_any_size(spark, most_words, most_letters):
    rng = random.Random(most_words)
    words = {"".join(rng.choices("abé", k=rng.randrange(6, 12))) for _ in range(500)}
    words |= {"common" * 4 + "".join(rng.choices("xyz", k=6)) for _ in range(150)} | {"".join(rng.choices("xyz", k=6)) + "common" * 4 for _ in range(150)}
    words |= {"a" * k for k in range(6, 40)} | {"z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1499}
    n = {w: i for i, w in enumerate(sorted(words))}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted(map(tuple, spelling.near_words(table, most_words, most_letters).collect()))
    long = [w for w in words if len(w) >= 3000]
    letters = "abéxyzcomn"
    want = [(w, x, n[x]) for w in words - set(long) for x in edits(w, letters) & words]
    want += [(a, b, n[b]) for a, b in (("z" * 3000, "z" * 3001), ("z" * 3001, "z" * 3000), ("z" * 3000, long[[len(x) == 3000 and "y" in x for x in long].index(True)]))]
    mixed = next(x for x in long if "y" in x)
    want.append((mixed, "z" * 3000, n["z" * 3000]))
    assert got == sorted(want)


def test_groups_stay_small_and_hold_all(spark):
    """A hot prefix is split until its groups are small; every word is still in its groups."""
    rng = random.Random(1)
    words = {"prefixprefix" + "".join(rng.choices("abcdefgh", k=8)) for _ in range(3000)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = spelling.groups(table, 200).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 200


def test_forms_roots_and_ties(spark):
    words = {"example": 1000, "examples": 200, "exampless": 40, "examplesss": 8, "tiedaa": 50, "tiedab": 50, "tieda": 10, "lonely": 7, "nearby": 9, "nearbi": 9, "ünicode": 25, "unicode": 5}
    words["tied" + "ac"] = 10
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(table)) == expected(words)
    got = rows_of(spelling.variants(table))
    assert got["examplesss"][:2] == ("exampless", "example") and got["tiedac"][0] == "tiedaa"


def texts(seed: int) -> list:
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéÜ", k=rng.randrange(5, 9))) for _ in range(60)]
    out = []
    for i in range(300):
        words = [base[int(rng.random() ** 3 * len(base))] for _ in range(rng.randrange(0, 120))]
        words = [w if rng.random() < 0.9 else w[:-1] + rng.choice("abc") for w in words]
        out.append((i, rng.choice([" ", ", ", "1", "–", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return out + [(1000, None), (1001, ""), (1002, "12 34"), (None, "nullid " * 8), (1003, "ÀÉÎÕÜ×÷ÿ " * 9), (5, "repeated " * 7), (5, "repeated " * 7), (1004, "q" * 20000 + " " + "straße " * 6 + "ſtreet Ālength " * 9)]


@pytest.mark.parametrize("every", [199, 3, None])
def test_counts(spark, every):
    rows = texts(3)
    docs = frame(spark, rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "run")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, every=every).collect()}
    assert got == counted(rows, every=every)


def test_variants_of_texts(spark):
    rows = texts(4)
    docs = frame(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "form").withColumnRenamed("n_chars", "n")
    assert rows_of(spelling.spelling_variants(docs)) == expected(counted(rows))


def test_empty_tables(spark):
    empty = spelling.spelling_variants(frame(spark, ["a"]).limit(0))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(frame(spark, ["short words", None])).count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in read_table(spark, path, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_spelling(spark, path)) == expected(counted(rows))
