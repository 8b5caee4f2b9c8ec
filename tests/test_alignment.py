"""Alignment of chunks with texts against plain tables of common subsequences over all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import alignment as A


def lcs(a: str, b: str) -> int:
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[-1]))
        before = now
    return before[-1]


def partial(needle: str, window: str) -> float:
    n = len(needle)
    pieces = [window[i : i + n] for i in range(len(window) - n + 1)] + [window[:i] for i in range(1, n)] + [window[-i:] for i in range(1, n)]
    return max(200 * lcs(needle, p) / (n + len(p)) for p in set(pieces))


def plain_best(needle: str, text: str, least: float = 80.0):
    size = min(2 * len(needle), len(text))
    best = (0.0, 0, 0)
    for start in range(0, len(text) - len(needle), max(size // 4, 50)):
        end = min(start + size, len(text))
        score = partial(needle, text[start:end])
        if score > best[0]:
            best = (score, start, end)
    return best if best[0] >= least else None


def edited(rng: random.Random, text: str, letters: str, edits: int) -> str:
    x = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(x)), rng.random()
        if kind < 0.4:
            x[i] = rng.choice(letters)
        elif kind < 0.7:
            x.insert(i, rng.choice(letters))
        elif len(x) > 1:
            del x[i]
    return "".join(x)


def equal(a, b) -> bool:
    return a is b is None or a is not None and b is not None and abs(a[0] - b[0]) < 1e-9 and a[1:] == b[1:]


@pytest.mark.parametrize("seed", range(4))
def test_best_window(seed):
    rng = random.Random(seed)
    for _ in range(16):
        letters = rng.choice(["ab", "abcd ", "abcdefghij "])
        needle = "".join(rng.choices(letters, k=rng.randrange(1, 30)))
        text = "".join(rng.choices(letters, k=rng.randrange(0, 160)))
        if rng.random() < 0.8:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + edited(rng, needle, letters, rng.randrange(0, 1 + len(needle) // 4)) + text[at:]
        assert equal(A.best_window(needle, text), plain_best(needle, text)), (needle, text)
        assert equal(A.best_window(needle, text, 50.0), plain_best(needle, text, 50.0)), (needle, text)


def test_common_of_long_chunks():
    rng = random.Random(9)
    for _ in range(8):
        a, b = ("".join(rng.choices("abcdeÄ日", k=rng.randrange(0, 400))) for _ in range(2))
        assert A.Needle(a).common(b) == lcs(a, b)


def plain_chunks(text: str, size: int = 300) -> list[str]:
    if len(text) <= size:
        return [text] if text else []
    out = []
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if len(p) >= 20:
            out += [p] if len(p) <= size else [c for i in range(0, len(p), size) if len((c := p[i : i + size]).strip()) >= 20]
    return out or [text[:size]]


def test_chunks(spark):
    rng = random.Random(2)
    texts = ["", None, "short", "x" * 300, "x" * 301, "x" * 619, "x" * 620, "a\n\nb" * 200, "\n\n".join("p%d " % i * 12 for i in range(9)), "word " * 400 + "\n \t\n" + "tail " * 5, "ü日" * 400]
    texts += ["\n\n".join("".join(rng.choices("ab \n", k=rng.randrange(0, 900))) for _ in range(rng.randrange(1, 5))) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", A.chunked("text").alias("c")).collect()
    for r in rows:
        assert r["c"] == plain_chunks(texts[r["id"]] or ""), texts[r["id"]]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("aeiorstlnmd", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    passages = [prose(rng, 5) for _ in range(4)]
    chunks = [(f"c{i}", i, p) for i, p in enumerate(passages)] + [("short", 1, "too short"), ("null", 2, None), ("blank", 3, " " * 30)]
    texts = []
    for d in range(10):
        body = [prose(rng, rng.randrange(2, 9)) for _ in range(3)]
        body.insert(rng.randrange(4), edited(rng, passages[d % 4], "aeiorst", rng.choice([0, 2, 4, 6, 14])).upper())
        texts.append((d, " ".join(body), "x"))
    texts += [(90, None, "x"), (91, "", "x"), (92, passages[0], "x"), (93, passages[0] + ".", "x")]
    return passages, chunks, texts


def test_align_all_pairs(spark, tables):
    passages, chunks, texts = tables
    c = spark.createDataFrame(chunks, "part string, hay0 int, chunk string").withColumn("link", F.lit(1))
    t = spark.createDataFrame(texts, "doc int, text string, needle0 string").withColumn("link", F.lit(1))
    got = {(r["part"], r["doc"]): r for r in A.align(c, t, ["link"]).collect()}
    want = {}
    for part, _, chunk in chunks:
        for doc, text, _ in texts:
            if chunk and len(chunk.strip()) >= 10 and text and (best := plain_best(chunk.lower(), text.lower())):
                want[part, doc] = best
    assert got.keys() == want.keys() and len(want) > 6
    for key, (score, start, end) in want.items():
        r = got[key]
        text = dict((d, t) for d, t, _ in texts)[key[1]]
        span = text[start:end][: len(r["chunk"]) + 100]
        assert abs(r["similarity"] - score / 100) < 1e-9 and (r["char_offset"], r["span"], r["span_length"]) == (start, span[:500], len(span))
        assert r["needle0"] == "x" and r["hay0"] is not None


def test_links_by_words(spark, tables):
    """Exactly the pairs that share enough distinct words, though only rare words are joined."""
    passages, chunks, texts = tables
    c = spark.createDataFrame(chunks, "part string, n int, chunk string")
    t = spark.createDataFrame(texts, "doc int, text string, x string")
    words = lambda s: set(re.findall(r"\w+", (s or "").lower()))
    for share in (0.3, 0.6, 1.0):
        got = sorted(map(tuple, A.linked_by_words(c, t, "part", "doc", share=share).collect()))
        want = sorted((p, d) for p, _, s in chunks if words(s) for d, x, _ in texts if len(words(s) & words(x)) >= share * len(words(s)) - 1e-9)
        assert got == want


def test_empty(spark):
    c = spark.createDataFrame([], "doc int, chunk string")
    t = spark.createDataFrame([(1, "some text of a document")], "doc int, text string")
    assert A.align(c, t, ["doc"]).count() == 0 and A.align(c.unionByName(t.withColumnRenamed("text", "chunk")), t.limit(0), ["doc"]).count() == 0


def test_lower_case_keeps_places():
    assert A.lowered("İSTANBUL ΟΔΟΣ") == "İstanbul οδοσ" and A.lowered("ÄB") == "äb"


def test_texts_without_room_are_done_with_early():
    """Pieces side by side have the common lengths of single ones, and no text with a window is left out."""
    rng = random.Random(12)
    left = 0
    for _ in range(60):
        letters = rng.choice(["ab", "abcd ", "abcdefghijklmno ", "aäΣ日𝄞b"])
        needle = "".join(rng.choices(letters, k=rng.choice([1, 2, 5, 7, 8, 9, 16, 33, 64, 120])))
        text = "".join(rng.choices(letters, k=rng.randrange(len(needle) + 1, 400)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + edited(rng, needle, letters, rng.randrange(0, 1 + len(needle) // 4)) + text[at:]
        if len(text) <= len(needle):
            continue
        places = A.grid(len(needle), len(text))
        common = A.side_by_side(needle, [text[p : p + len(needle)] for p in places])
        assert common == [lcs(needle, text[p : p + len(needle)]) for p in places]
        room = A.may_hold(len(needle), places, common, 0.8)
        assert room or A.best_window(needle, text) is None
        left += not room
    assert left > 5


def test_a_hot_key_is_many_tasks(spark):
    """One text and many chunks of one key: the chunks are dealt over tasks, and each is found once."""
    rng = random.Random(3)
    text = prose(rng, 400)
    chunks = [(i, 1, text[i * 5 : i * 5 + 40]) for i in range(300)]
    c, t = spark.createDataFrame(chunks, "part int, doc int, chunk string"), spark.createDataFrame([(1, text)], "doc int, text string")
    found = A.align(c, t, ["doc"]).select("part", "char_offset", "similarity", F.spark_partition_id().alias("task")).collect()
    want = {i: A.best_window(A.lowered(s), A.lowered(text)) for i, _, s in chunks}
    assert len(found) == 300 and all((r["similarity"] * 100, r["char_offset"]) == pytest.approx(want[r["part"]][:2]) for r in found)
    assert len({r["task"] for r in found}) > 1


def test_pieces_of_several_chunks_and_texts_side_by_side():
    """Chunks about the words' lengths, pieces that end before others, and letters that no chunk has."""
    rng = random.Random(21)
    needles = ["".join(rng.choices("abcdeÄ日𝄞", k=n)) for n in (1, 62, 63, 64, 125, 126, 127, 189, 190, 252, 300)]
    texts = ["".join(rng.choices("abcdefÄ日𝄞", k=k)) for k in (310, 400, 700)] + [needles[-1] + "b" * 9]
    which, where, place = zip(*((k, t, rng.randrange(len(x) - len(s) + 1)) for k, s in enumerate(needles) for t, x in enumerate(texts) for _ in range(3)))
    got = A.common_lengths(needles, texts, *map(A.np.array, (which, where, place)))
    assert got.tolist() == [A.Needle(needles[k]).common(texts[t][p : p + len(needles[k])]) for k, t, p in zip(which, where, place)]


def test_few_pieces_are_compared_and_no_window_is_passed_over():
    rng = random.Random(22)
    assert len(A.grid(300, 30_000)) < 2.2 * 30_000 / 300 and len(A.grid(299, 30_000)) < 2.2 * 30_000 / 299
    found = 0
    for _ in range(80):
        letters = rng.choice(["ab", "abcd ", "abcdefghijklmno "])
        needle = "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 9, 20, 49, 50, 51, 60, 99, 100, 101, 133])))
        text = "".join(rng.choices(letters, k=len(needle) + rng.choice([1, 2, 30, 49, 50, 51, 200, 900])))
        for _ in range(rng.randrange(3)):
            at = rng.choice([0, rng.randrange(len(text) + 1), len(text)])
            text = text[:at] + edited(rng, needle[rng.randrange(1 + len(needle) // 4) :], letters, rng.randrange(0, 1 + len(needle) // 5)) + text[at:]
        if len(text) <= len(needle):
            continue
        places = A.grid(len(needle), len(text))
        assert places[0] == 0 and places[-1] == len(text) - len(needle) and all(0 < b - a <= max(1, len(needle) // 2) for a, b in zip(places, places[1:]))
        for least in (60.0, 80.0, 95.0):
            room = A.rooms(len(needle), places, A.side_by_side(needle, [text[p : p + len(needle)] for p in places]), least / 100)
            want = A.best_window(needle, text, least)
            assert A.best_window(needle, text, least, room) == want and (room or want is None)
            found += want is not None
    assert found > 60
