"""Token counts against the sentencepiece library and against cuts and whole tokens worked out plainly."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, token_counts
from corvane.llm.common import read_table
from tests.llm.helpers import frame, mixed, prose

ODD = [" ", "  ", "▁", "▁▁", "\n", "\t", "the", "ing", "é", "日本", "ß", "\x00", "<s>", "<unk>", "<0x0A>", "漢", "Ω", "😀", "한국", "1", "23", ".", ",”", "…", "»", "’s", "​", "é", "نن", "…]", "ﬁ", "\r\n", "     "]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.default_path(), "rb") as f:
        return token_counts.Counter(f.read())


def odd_texts(n: int) -> list[str]:
    rng = random.Random(11)
    out = ["".join(rng.choices(ODD, k=rng.randrange(40))) for _ in range(n)]
    ranges = [(32, 126), (0xA0, 0x2FF), (0x400, 0x500), (0x4E00, 0x5100), (0x1F300, 0x1F600)]
    out += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randrange(200))) for _ in range(n)]
    return out + [" " * k for k in range(1, 50)] + ["日本語の文章" * 3000, "x" * 20000, "ab " * 9000, "-" * 5000]


def test_equal_to_the_library(counter, library):
    texts = odd_texts(1500)
    assert counter.count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_forgetting_changes_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_BYTES", 2000)
    rng = random.Random(5)
    for _ in range(20):
        texts = [prose(rng, 60) for _ in range(5)] + odd_texts(5)[:20]
        assert counter.count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_whole_tokens_are_proven(counter, library):
    """A string is whole exactly if the library gives it as one token where nothing is put before it."""
    p = counter.p
    for piece in random.Random(3).sample(sorted(p.scores), 2000):
        pre = "\n" + piece.replace(token_counts.SPACE, " ")
        alone = len(library.encode(pre)) - len(library.encode("\n"))
        assert (piece in p.whole) == (alone == 1), piece


def test_cuts_cross_no_piece(counter):
    p = counter.p
    for text in odd_texts(200):
        marked = text.replace(" ", token_counts.SPACE)
        words = counter.find(marked)
        assert "".join(words) == marked
        assert not any(a[-1] + b[0] in p.meet for a, b in zip(words, words[1:]))


def test_both_ways_of_merging(counter):
    rng = random.Random(8)
    for piece in rng.sample(sorted(counter.p.scores), 3000):
        assert counter.p._few(piece) == counter.p._many(piece)
    for text in odd_texts(300):
        word = text.replace(" ", token_counts.SPACE)[:60]
        assert counter.p._few(word) == counter.p._many(word)


def test_table(spark, library):
    texts = mixed(13) + ["<s> hello </s>", "  two  spaces ", "é" * 5000]
    docs = frame(spark, texts).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "id")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 4096)


def test_repeats_nulls_and_empty_tables(spark):
    docs = frame(spark, [(None, "a b"), (1, None), (1, "a b"), (1, "a b")])
    rows = sorted(map(tuple, token_counts.token_counts(docs, limit=1).collect()), key=str)
    assert rows == [(1, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True), (None, 3, 2, True)]
    empty = token_counts.token_counts(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_other_models_are_refused(tmp_path, spark):
    def field(n: int, value: bytes) -> bytes:
        return bytes([n << 3 | 2, len(value)]) + value

    unigram = tmp_path / "unigram.model"
    unigram.write_bytes(field(1, field(1, b"a")) + field(2, bytes([3 << 3, 1])))
    with pytest.raises(ValueError, match="BPE"):
        token_counts.token_counts(frame(spark, ["a"]), str(unigram))


def test_query(spark, library):
    path = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, path).collect()}
    rows = read_table(spark, path, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r["text"]))
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(r["text"].encode()), n, n > 4096)
