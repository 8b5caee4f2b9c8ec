"""The tokens that end at a byte, listed by links, against a search of all; encodings against plain merging."""

import random

import pytest

from corvane.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def words(seed, n):
    rng = random.Random(seed)
    letters = ["the", "ing", "tion", "ed", "er", "str", "a", "e", "o", "n", "é", "ñ", "日", "z", "Q", "00", "=", "́"]
    return sorted({rng.choice(["", " "]) + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(n)})


def test_links_list_every_token_that_ends(encoder):
    v = encoder.v
    for word in [w.encode() for w in words(3, 300)]:
        state = 0
        for end, byte in enumerate(word, 1):
            state, got = v.step(state, byte), []
            token = v.longest[state]
            while token >= 0:
                got.append(token)
                token = v.shorter[token]
            assert got == [v.ends[word[i:end]] for i in range(end) if word[i:end] in v.ends]


@pytest.mark.parametrize("memory", [None, 3])
def test_encodings_are_those_of_plain_merging(encoder, monkeypatch, memory):
    if memory:
        monkeypatch.setattr(bpe, "MEMORY_PAIRS", memory)
        monkeypatch.setattr(bpe, "MEMORY_STEPS", memory)
    raw = sorted(w.encode() for w in words(4, 3000 if memory is None else 300))
    trie = bpe.Trie(encoder.v)
    for word, ids in zip(raw, trie.encode(raw), strict=True):
        assert list(ids) == encoder.v.merge(word)
