"""Byte-level BPE by a prefix-sharing trie.

Distinct words go into a byte trie. A node stands for a byte prefix, and the encoding of a prefix is
that of a shorter prefix followed by one last token. So a node needs only its last token: the longest
vocabulary token that ends there and that joins validly to the last token of the node where it starts.
The traversal is depth first over the sorted words, so only the nodes from the root to the current one are held: a word goes
on from the prefix that it shares with the word before, and a shared prefix is worked out once. A word's ids are read by
walking its last tokens back to the root. Of equal ranks the left pair is merged first.

Null and empty texts have no ids and the digest of the empty string. Repeated rows give repeated results, an empty table gives
no rows. Texts of any length are encoded whole; a chunk holds one long text alone. Only the id and the text are read, so other
columns do not matter; the results are the id and the columns that each function names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, kept_between_tasks, mapped

# Fixed value: the published word pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words and ids that a worker remembers before it starts anew, and pairs of tokens whose borders it remembers.
MEMORY_BYTES, MEMORY_PAIRS = 64 << 20, 250_000
#: Steps from one prefix of a token to the next that a task remembers.
MEMORY_STEPS = 100_000
#: Python's cost of a remembered word besides its letters and ids.
WORD_BYTES = 180


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and merges of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.of = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (bytes(letters[c] for c in x) for x in (left, right))
            new = self.ids[a + b]
            self.rank[self.ids[a], self.ids[b]] = (rank, new)
            self.parts.setdefault(new, (self.ids[a], self.ids[b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.of |= {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self._right = lru_cache(1 << 13)(self._chain_right)
        self._left = lru_cache(1 << 13)(self._chain_left)
        # A token that its own merges never build is no last token.
        self.ends = {t: i for t, i in self.ids.items() if len(t) == 1 or self.merge(t) == [i]}
        self._link()
        self.numerals = {i: str(i) for i in self.of}

    def _link(self) -> None:
        """Links from each prefix of a token to its longest proper suffix that is one too, so that the tokens that end at a byte are listed
        from the longest to the shortest without a search."""
        #: The prefix that a prefix (state) and one more byte make, by state << 8 | byte; more of them, that fall back, are remembered by tries.
        self.steps: dict[int, int] = {}
        owner, depth = [-1], [0]
        for t, i in self.ends.items():
            state = 0
            for byte in t:
                at = state << 8 | byte
                state = self.steps.get(at, 0)
                if not state:
                    state = self.steps[at] = len(owner)
                    owner.append(-1)
                    depth.append(depth[at >> 8] + 1)
            owner[state] = i
        #: The longest proper suffix of a state that is a state, and the longest token that a state ends in.
        self.fall, self.longest = [0] * len(owner), owner
        #: The next shorter token that ends in the same bytes, and the length of a token.
        self.shorter, self.length = {}, {i: len(t) for t, i in self.ends.items()}
        for at, state in sorted(self.steps.items(), key=lambda x: depth[x[1]]):
            if at >> 8:
                self.fall[state] = self.step(self.fall[at >> 8], at & 255)
            below = self.longest[self.fall[state]]
            if owner[state] < 0:
                owner[state] = below
            else:
                self.shorter[owner[state]] = below

    def step(self, state: int, byte: int) -> int:
        """The longest suffix of a state and a byte that is a state."""
        while (new := self.steps.get(state << 8 | byte)) is None and state:
            state = self.fall[state]
        return new or 0

    def merge(self, word: bytes) -> list[int]:
        """Plain merging by rank, for the check of the vocabulary and of tests."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min((self.rank[p] + (i,) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            rank, new, _ = best
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1]), (None,))[0] == rank:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _chain_right(self, token: int) -> list[tuple[int, int]]:
        """What stands at the right edge of a token while it is built, with the rank of the merge that ends it."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            left, right = self.parts[token]
            until = self.rank[left, right][0]
            token = right

    def _chain_left(self, token: int) -> list[tuple[int, int]]:
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            left, right = self.parts[token]
            until = self.rank[left, right][0]
            token = left

    def born(self, token: int) -> int:
        """The rank of the merge that makes a token."""
        return self.rank[self.parts[token]][0] if token in self.parts else -1

    def joins(self, a: int, b: int) -> bool:
        """Whether a then b stay apart: no merge across their border comes before the merges that end its two sides.

        Of equal ranks the left pair is merged first, so a merge across the border wins a tie against one of b's.
        """
        found, left = self.rank.get, self._left(b)
        for x, until_x in self._right(a):
            for y, until_y in left:
                new = found((x, y))
                if new is not None and max(self.born(x), self.born(y)) <= new[0] < until_x and new[0] <= until_y:
                    return False
        return True


class Trie:
    """The trie of words, of which the path from the root to one node is held: the last token of each, where that starts, and the longest
    prefix of a token that ends there."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, int] = {}

    def _joins(self, a: int, b: int, pair: int) -> bool:
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        ok = self.pairs[pair] = self.v.joins(a, b)
        return ok

    def _step(self, at: int) -> int:
        if len(self.steps) >= MEMORY_STEPS:
            self.steps.clear()
        new = self.steps[at] = self.v.step(at >> 8, at & 255)
        return new

    def encode(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of distinct sorted words: the traversal is depth first."""
        longest, shorter, length, step, seen, size = self.v.longest, self.v.shorter, self.v.length, self.steps.get, self.pairs.get, len(self.v.of) + 1
        last, back, states, before = [-1], [0], [0], b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in word[shared:]:
                at = state << 8 | byte
                state = step(at)
                if state is None:
                    state = self._step(at)
                end += 1
                token = longest[state]
                start = end - length[token]
                while start:
                    pair = last[start] * size + token
                    ok = seen(pair)
                    if ok or ok is None and self._joins(last[start], token, pair):
                        break
                    token = shorter[token]
                    start = end - length[token]
                last.append(token)
                back.append(start)
                states.append(state)
            ids, node = [], end
            while node:
                ids.append(last[node])
                node = back[node]
            before = word
            yield tuple(ids[::-1])


@lru_cache(1)
def vocabulary(text: str) -> Vocabulary:
    """A worker keeps the vocabulary, whose size is fixed, between tasks."""
    return Vocabulary(text)


kept_between_tasks(__name__, vocabulary.cache_clear)


class Encoder:
    """Texts to ids and back, with a memory of words."""

    def __init__(self, text: str):
        self.v = vocabulary(text)
        self.find = regex.compile(WORD_PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")").split if self.v.special else None
        self.trie = Trie(self.v)
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def words(self, text: str) -> list[str | int]:
        if self.split is None or not any(s in text for s in self.v.special):
            return self.find(text)
        out: list = []
        for piece in self.split(text):
            if piece in self.v.special:
                out.append(self.v.special[piece])
            else:
                out += self.find(piece)
        return out

    def learn(self, words: set[str | int]) -> None:
        """A chunk's new words go through the trie together, so shared prefixes are worked out once."""
        if self.held > MEMORY_BYTES:
            self.known, self.held = {}, 0
        new = sorted((w.encode(), w) for w in words if isinstance(w, str) and w not in self.known)
        for (raw, w), ids in zip(new, self.trie.encode([raw for raw, _ in new])):
            self.known[w] = ids
            self.held += WORD_BYTES + len(raw) + 8 * len(ids)

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        parts = [self.words(t) for t in texts]
        # a chunk's words are all learnt after the memory was last cleared
        self.learn(set().union(*parts))
        known = self.known
        for p in parts:
            ids: list[int] = []
            for w in p:
                if isinstance(w, int):
                    ids.append(w)
                else:
                    ids += known[w]
            yield ids

    def decode(self, ids: list[int]) -> str:
        of = self.v.of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


def default_path() -> str:
    """Place of the public tokenizer file: PUBLIC_TOKENIZER, else the installed package's."""
    if path := os.environ.get("PUBLIC_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the token ids of each whole text and the text that they decode to."""
    return _run(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda ids, text, numerals: (ids, text))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text."""

    def row(ids: list[int], text: str, numerals: dict[int, str]) -> tuple:
        return len(ids), hashlib.sha256(",".join([numerals[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _run(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def _run(docs: DataFrame, path: str | None, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    with open(path or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in schema.replace("array<int>", "array").split(",")]
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made anew for each task, so that a worker keeps no words between tasks
        enc = Encoder(spec.value)
        for batch in chunks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [row(ids, enc.decode(ids), enc.v.numerals) for ids in enc.encode_many(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows)))], [id_col, *names])

    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("text")), run, f"{id_col} {kind}, {schema}")
