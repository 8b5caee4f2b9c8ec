"""Token counts of a SentencePiece BPE model, by a shortcut for whole tokens.

The library merges, over a whole text with its spaces marked, the adjacent pieces whose join is the vocabulary's best; of
equal scores the left pair. Two characters that stand side by side in no piece are never merged across, so a text may be cut
there: that is what a pre-token is here, and the cuts are read off the vocabulary, not assumed. Offline, once for a model,
each vocabulary string is merged by itself; those that come out as one token are the whole tokens. A pre-token among them
counts one and is never merged. Only the rest are merged, each distinct one once in a chunk of texts; a worker remembers them up
to a bound. A character outside the vocabulary counts a token for each of its bytes, if the model falls back to bytes, else one.

Null and empty texts have no bytes and no tokens. Strings such as `<s>` inside a text are ordinary text, as the library has
it by default. Texts of any length are counted whole; a chunk holds one long text alone. Repeated rows give repeated results,
an empty table gives no rows. Only the id and the text are read, so other columns do not matter, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, kept_between_tasks, mapped, utf8

#: The mark that stands for a space in the vocabulary.
SPACE = "▁"
# Numbers of the published model format. Of the model: pieces, trainer, normaliser. Of a piece: its kinds.
PIECES, TRAINER, NORMALISER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes of merged pre-tokens that a worker remembers before it starts anew, and Python's cost of one besides its letters.
MEMORY_BYTES, ENTRY_BYTES = 32 << 20, 120
#: Letters up to which the best pair is found by looking at all pairs; longer pre-tokens use a heap.
SHORT = 24


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message; fixed-width values stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """Scores of a model's pieces, which characters may meet inside one, and the whole tokens."""

    def __init__(self, model: bytes):
        scores: dict[str, float] = {}
        trainer, normaliser = {}, {}
        for number, value in fields(model):
            if number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALISER:
                normaliser = dict(fields(value))
            elif number == PIECES:
                piece = dict(fields(value))
                kind = piece.get(3, NORMAL)
                if kind == NORMAL:
                    scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                elif kind not in (UNKNOWN, CONTROL, BYTE):
                    raise ValueError("models with user-defined or unused pieces are not supported")
        if trainer.get(3, 1) != 2 or trainer.get(24) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only BPE models that keep their text as it is are supported")
        self.scores = scores
        #: Places of the distinct scores from the lowest, from 1 on.
        place = {x: i for i, x in enumerate(sorted(set(scores.values())), 1)}
        self.rises = {p: place[x] for p, x in scores.items()}
        self.bytes = bool(trainer.get(35, 0))
        self.prefix = " " if normaliser.get(3, 1) else ""
        self.meet = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        inner = set("".join(self.meet))
        if any(a != SPACE and b == SPACE for a, b in self.meet):
            raise ValueError("a piece holds a space after another character")
        self.pattern = self._pattern()
        self.whole = {p for p in scores if self.merged(p) == 1}

    def _pattern(self) -> str:
        """Pre-tokens: spaces and the run after them. A run is cut around the characters of one byte that are in no longer piece,
        and between signs and all that meet no sign in a piece; what does meet one goes into a run with all around it."""
        inner = set("".join(self.meet))
        alone = {c for c in map(chr, range(128)) if c not in inner and c != " "}
        signs = {c for c in map(chr, range(128)) if not c.isalnum() and c != " "} - alone
        mixed = {c for pair in self.meet if len(signs & set(pair)) == 1 for c in pair} - signs - {SPACE}
        a, s, m = ("".join(map(re.escape, sorted(x))) for x in (alone, signs, mixed))
        ahead = f"(?![{m}])" if mixed else ""
        parts = [f"[{a}]"] if alone else []
        parts.append(f"{SPACE}*[^{SPACE}{a}{s}{m}]++{ahead}")
        parts += [f"{SPACE}*[{s}]++{ahead}"] if signs else []
        return "|".join([*parts, f"{SPACE}*[^{SPACE}{a}]+", f"{SPACE}+"])

    def merged(self, word: str) -> int:
        """Tokens of a string, by plain merging."""
        parts = self._few(word) if len(word) <= SHORT else self._many(word)
        n = len(parts)
        if self.bytes:
            for p in parts:
                if p not in self.scores:
                    n += len(p.encode()) - 1
        return n

    def _few(self, word: str) -> list[str]:
        parts, find = list(word), self.rises.get
        rise = [find(word[i : i + 2], 0) for i in range(len(word) - 1)]
        while rise and (best := max(rise)):
            at = rise.index(best)
            new = parts[at] = parts[at] + parts.pop(at + 1)
            del rise[at]
            if at:
                rise[at - 1] = find(parts[at - 1] + new, 0)
            if at < len(rise):
                rise[at] = find(new + parts[at + 1], 0)
        return parts

    def _many(self, word: str) -> list[str]:
        parts: list[str] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def offer(left: int, right: int) -> Iterator[tuple[float, int, int, int]]:
            if left >= 0 and right < len(parts):
                score = self.scores.get(parts[left] + parts[right])
                if score is not None:
                    yield -score, left, right, len(parts[left]) + len(parts[right])

        heap = [x for i in range(len(parts) - 1) for x in offer(i, i + 1)]
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            # one of the two has since been merged with another
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            for x in (*offer(before[left], left), *offer(left, after[left])):
                heapq.heappush(heap, x)
        return [p for p in parts if p]

    def cuts(self, word: str) -> Iterator[str]:
        """The string cut wherever two characters meet that do so in no piece."""
        start = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.meet:
                yield word[start:i]
                start = i
        yield word[start:]


@lru_cache(1)
def pieces(model: bytes) -> Pieces:
    """A worker keeps the model, whose size is fixed, between tasks."""
    return Pieces(model)


kept_between_tasks(__name__, pieces.cache_clear)


class Counter:
    """Counts tokens of texts: whole tokens at once, the rest by merging, with a memory of what was merged. When that is full it
    becomes the old memory, from which what is met again is taken over, and the old memory before it goes."""

    def __init__(self, model: bytes):
        self.p = pieces(model)
        self.find = re.compile(self.p.pattern, re.S).findall
        self.held = 0
        self.forget()

    def forget(self) -> None:
        self.old = self.known if self.held else {}
        self.known: dict[str, int] = dict.fromkeys(self.p.whole, 1)
        self.held = 0

    def tokens(self, part: str) -> int:
        """Tokens of a string without inner cuts."""
        n = self.known.get(part) or self.old.get(part) or self.p.merged(part)
        if part not in self.known:
            self.known[part] = n
            self.held += ENTRY_BYTES + len(part)
        return n

    def learn(self, words: set[str]) -> None:
        for w in words:
            n = self.old.get(w) or sum(map(self.tokens, self.p.cuts(w)))
            if w not in self.known:
                self.known[w] = n
                self.held += ENTRY_BYTES + len(w)

    def count(self, texts: list[str]) -> list[int]:
        if self.held > MEMORY_BYTES:
            self.forget()
        parts = [self.find((self.p.prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        # a chunk's pre-tokens are all learnt after the memory was last cleared
        self.learn(set().union(*parts) - self.known.keys())
        known = self.known.__getitem__
        return [sum(map(known, p)) for p in parts]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of each whole text. `path`: the model's file, read by the driver."""
    with open(path or default_path(), "rb") as f:
        model = f.read()
    pieces(model)  # refuses models of other kinds before any task runs
    spec = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made anew for each task, so that a worker keeps no words between tasks
        counter = Counter(spec.value)
        for batch in chunks(batches, "text"):
            counts = counter.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(utf8(F.col(text_col))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
