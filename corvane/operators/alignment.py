"""Where a text says nearly what a short passage says: the best partial match of chunks in whole texts.

The score of a chunk in a window is the greatest of 2 * LCS / (length of the chunk + length of the piece) over all pieces of the window that are as
long as the chunk, and over the window's beginnings and ends that are shorter. The longest common subsequence is found with one integer a row,
whose bits are the chunk's characters. Two pieces that lie d characters apart differ by at most d in it, so pieces that
cannot beat the best score so far are passed over without being compared; the result is that of comparing all. Before that, pieces at every
half of the chunk's length and at windows' edges are compared for all chunks and texts of a batch at once, side by side in arrays, and only
windows in which these leave room for the least score are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.joins import spread
from corvane.operators.studies import _cut

#: Characters of a chunk, the shortest paragraph that becomes one, and the shortest chunk that is aligned.
CHUNK, LEAST_PARAGRAPH, LEAST_CHUNK = 300, 20, 10
#: Score (0 to 100) from which a chunk counts as found.
THRESHOLD = 80.0
#: Pieces that are compared side by side, how many times these are gathered at once, and chunks that meet a text in one task or are compared together.
LANES, FILLED, TOGETHER = 4_096, 8, 64
#: Pairs whose texts a task holds at once.
ROWS = 512
#: Characters of a chunk and of a span that are returned.
SHOWN = 500


def chunked(text: Column | str, size: int = CHUNK, space: str = r"\s", around: str = r"\s") -> Column:
    """A text of up to `size` characters as it is; a longer one by its paragraphs (between blank lines, without the short ones), those that are
    too long in pieces of `size`. A text of which nothing is left gives its first `size` characters. Null and empty: no chunk.

    `space` is what is blank in lines and around paragraphs, `around` what does not count at the ends of a piece."""
    text = F.col(text) if isinstance(text, str) else text
    strip = lambda s, blank: F.regexp_replace(s, rf"(?U)^{blank}+|{blank}+\z", "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(p) - 1) / size).cast("int")), lambda i: p.substr(i * size + 1, F.lit(size)))
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{space}*\n"), lambda p: strip(p, space)), lambda p: F.char_length(p) >= LEAST_PARAGRAPH)
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.char_length(p) <= size, F.array(p)).otherwise(F.filter(cut(p), lambda c: F.char_length(strip(c, around)) >= LEAST_PARAGRAPH))))
    whole = F.array(text.substr(1, size))
    found = F.when(F.char_length(text) <= size, whole).when(F.size(pieces) > 0, pieces).otherwise(whole)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(found)


def lowered(text: str) -> str:
    """Lower case, character by character: those whose lower form is longer stay, so places are those of the text."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:
        return low
    return "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Needle:
    """A chunk whose longest common subsequences with pieces of texts are found bit by bit."""

    def __init__(self, chunk: str):
        self.n = len(chunk)
        self.all = (1 << self.n) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(chunk):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def common(self, piece: str) -> int:
        """Length of the longest common subsequence."""
        rest, masks, full = self.all, self.masks, self.all
        for c in piece:
            m = masks.get(c)
            if m is not None:
                hit = rest & m
                rest = (rest + hit | rest - hit) & full
        return self.n - rest.bit_count()

    def beginnings(self, piece: str, most: int) -> float:
        """The greatest score of the piece's proper beginnings; `most`: the common length with the whole piece."""
        rest, masks, full, best = self.all, self.masks, self.all, 0.0
        for length, c in enumerate(piece[:-1], 1):
            m = masks.get(c)
            if m is not None:
                hit = rest & m
                rest = (rest + hit | rest - hit) & full
                common = self.n - rest.bit_count()
                best = max(best, 2 * common / (self.n + length))
                if common == most:
                    break  # longer ones have no more in common
        return best


def edges(n: int, length: int) -> np.ndarray:
    """Places of the pieces at the beginnings and ends of a text's windows."""
    starts = np.arange(0, length - n, max(min(2 * n, length) // 4, 50))
    return np.unique(np.concatenate((starts, np.minimum(starts + 2 * n, length) - n)))


def grid(n: int, length: int) -> list[int]:
    """Places of the pieces that are compared first: those at windows' edges, the last place, and every half of the chunk's length between these; of chunks of one
    word every sixth, since common lengths of short pieces vary more."""
    step, places = max(1, n // (2 if n > 63 else 6)), edges(n, length)
    # one beside another tells as much but for a character
    places = np.unique(np.append(places[np.diff(places, prepend=-n) > n // 50], length - n))
    parts = -(-np.diff(places) // step)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    return np.append(np.repeat(places[:-1], parts) + (np.arange(len(first)) - first) * step, places[-1]).tolist()


def common_lengths(needles: list[str], texts: list[str], which: np.ndarray, where: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Needle.common of needle which[i] and the piece as long as it at place[i] of text where[i]. Pieces lie side by side, with a word of 64 bits for 63
    characters of their chunks and what is carried; those of long chunks come first, and a piece that has ended is passed over."""
    lengths = np.array([len(s) for s in needles], np.int64)
    words = int(lengths.max() + 62) // 63
    code = np.zeros(0x110000, np.int32)
    letters = sorted({ord(c) for s in needles for c in s})
    code[letters] = np.arange(1, len(letters) + 1)
    wide, whole = len(letters) + 1, np.uint64((1 << 63) - 1)
    masks, full = np.zeros((words, len(needles) * wide), np.uint64), np.zeros((words, len(needles)), np.uint64)
    for k, needle in enumerate(map(Needle, needles)):
        for w in range(words):
            full[w, k] = needle.all >> 63 * w & int(whole)
            for c, m in needle.masks.items():
                masks[w, k * wide + code[ord(c)]] = m >> 63 * w & int(whole)
    coded = code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    out, order = np.empty(len(which), np.int64), np.argsort(-lengths[which], kind="stable")
    for rows in (order[i : i + LANES] for i in range(0, len(order), LANES)):
        n, at, base = lengths[which[rows]], begins[where[rows]] + place[rows], which[rows] * wide
        used = int(n[0] + 62) // 63
        rest = held = [full[w, which[rows]] for w in range(used)]
        column, (hit, total, carry) = np.empty(len(rows), np.int64), np.empty((3, len(rows)), np.uint64)
        for m in np.searchsorted(-n, -np.arange(n[0]), side="left").tolist():
            if m < len(at):
                at, base, column, hit, total, carry = (x[:m] for x in (at, base, column, hit, total, carry))
                rest = [r[:m] for r in rest]
            coded.take(at, out=column, mode="clip")
            at += 1
            column += base
            for w, r in enumerate(rest):
                masks[w].take(column, out=hit, mode="clip")
                np.bitwise_and(r, hit, out=hit)
                np.add(r, hit, out=total)
                if w:
                    np.add(total, carry, out=total)
                if w < used - 1:
                    np.right_shift(total, np.uint64(63), out=carry)
                # rest + hit | rest - hit, where hit is part of rest
                np.bitwise_xor(r, hit, out=r)
                np.bitwise_or(r, total, out=r)
                np.bitwise_and(r, whole, out=r)
        out[rows] = n - sum(np.bitwise_count(r & full[w, which[rows]]).astype(np.int64) for w, r in enumerate(held))
    return out


def side_by_side(chunk: str, pieces: list[str]) -> list[int]:
    """The longest common subsequences of a chunk with pieces as long as it."""
    at = np.arange(len(pieces))
    return common_lengths([chunk], pieces, at * 0, at, at * 0).tolist()


def rooms(n: int, places: list[int], common: list[int], least: float) -> list[tuple[int, int]]:
    """First and last place of the ranges in which a text may have a piece of the least score (0 to 1), by the common lengths of its pieces at some places.

    Pieces d characters apart differ by d at most. A shorter piece counts at a window's edge only, and has no more in common than the whole piece there."""
    p, c = np.array(places), np.array(common)
    inner = np.flatnonzero(np.maximum(np.maximum(c[:-1], c[1:]), (c[:-1] + c[1:] + np.diff(p)) // 2) / n >= least - 1e-9)
    e = edges(n, places[-1] + n)
    after = np.minimum(np.searchsorted(p, e), len(p) - 1)
    before = np.maximum(after - (p[after] > e), 0)
    most = np.minimum(np.minimum(c[before] + np.abs(e - p[before]), c[after] + np.abs(p[after] - e)), n)
    at_edges = e[2 * most / (n + most) >= least - 1e-9].tolist()
    alone = [(places[0], places[0])] if len(p) == 1 and c[0] / n >= least - 1e-9 else []
    return sorted([*alone, *((places[i], places[i + 1]) for i in inner.tolist()), *zip(at_edges, at_edges)])


def may_hold(n: int, places: list[int], common: list[int], least: float) -> bool:
    """Whether a text may have a window of the least score (0 to 1), by the common lengths of its pieces at some places."""
    return bool(rooms(n, places, common, least))


def best_window(chunk: str, text: str, least: float = THRESHOLD, room: list[tuple[int, int]] | None = None) -> tuple[float, int, int] | None:
    """score, start and end of the first of the best windows of a text for a chunk, both lowered, if the score is at least `least`.

    Windows are twice as long as the chunk and begin every half of it, but at least every 50 characters. With `room` (`rooms`) only those
    are looked at that have a place of it, since the others score less.
    """
    n, size = len(chunk), min(2 * len(chunk), len(text))
    if not n or len(text) <= n:
        return None
    ahead, back = Needle(chunk), Needle(chunk[::-1])
    known: dict[int, int] = {}

    def common(at: int) -> int:
        if at not in known:
            known[at] = ahead.common(text[at : at + n])
        return known[at]

    best, found, step = least / 100, None, max(size // 4, 50)
    starts = range(0, len(text) - n, step)
    if room is not None:
        starts = sorted({s for a, b in room for s in range(max(0, -(-(a - size + n) // step)) * step, min(b + 1, starts.stop), step)})
    for start in starts:
        end = min(start + size, len(text))
        score, at = 0.0, start
        while at <= end - n:
            here = common(at) / n
            score = max(score, here)
            # the next piece that may be better than what is known: each step gains at most one common character
            goal = max(best, score)
            at += max(1, int((goal - here) * n - 1e-9))
        for needle, edge, most in ((ahead, text[start : start + n], common(start)), (back, text[end - n : end][::-1], common(end - n))):
            # no beginning has more in common than the whole piece
            if 2 * most / (n + most) >= max(best, score):
                score = max(score, needle.beginnings(edge, most))
        if found is None and score >= best or score > best:
            best, found = score, (start, end)
            if best == 1.0:
                break
    return None if found is None else (best * 100, *found)


def _worth(needles: list[str], hays: list[str], low: dict[str, str], least: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """The pairs that may hold a window of the least score, and where. As many pairs are looked at together as fill the lanes, whatever their chunks."""
    held: list[tuple[int, int, list[int]]] = []
    chunks: dict[str, int] = {}
    texts: dict[str, int] = {}
    for i, small in enumerate(needles):
        small, large = lowered(small), low[hays[i]]
        if 0 < len(small) < len(large):
            chunks.setdefault(small, len(chunks))
            texts.setdefault(large, len(texts))
            held.append((i, len(small), grid(len(small), len(large))))
        if held and (sum(len(x[2]) for x in held) >= FILLED * LANES or len(chunks) >= TOGETHER or i == len(needles) - 1):
            sizes = [len(x[2]) for x in held]
            which = np.repeat([chunks[lowered(needles[x[0]])] for x in held], sizes)
            where = np.repeat([texts[low[hays[x[0]]]] for x in held], sizes)
            common = common_lengths(list(chunks), list(texts), which, where, np.concatenate([x[2] for x in held]))
            for (j, n, places), found in zip(held, np.split(common, np.cumsum(sizes)[:-1])):
                if room := rooms(n, places, found.tolist(), least / 100):
                    yield j, room
            held, chunks, texts = [], {}, {}


def align(chunks: DataFrame, texts: DataFrame, on: list[str], chunk: str = "chunk", text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The columns of chunks, and char_offset, span, span_length and similarity (0 to 1) of the best window of each text that is joined to
    them by `on`, if it scores `least` or more. Texts are whole, whatever their length; null texts and chunks and chunks of less than
    LEAST_CHUNK characters find nothing. Chunks and texts meet by a join; a key's chunks are dealt into parts, so a hot key is many tasks.
    """
    kept = [c for c in chunks.columns if c != chunk]
    rest = [c for c in texts.columns if c not in (text, *kept, *on)]
    needle, hay = (next(n for i in range(len(kept + rest) + 1) if (n := f"{name}{i}") not in kept + rest) for name in ("needle", "hay"))
    # read twice, so it is worked out once
    found = _cut(chunks.where(F.char_length(F.trim(chunk)) >= LEAST_CHUNK).select(*kept, F.col(chunk).alias(needle)))
    part = next(n for i in range(len(kept + rest + on) + 1) if (n := f"part{i}") not in kept + rest + on)
    parts = found.groupBy(*on).agg(F.ceil(F.count("*") / TOGETHER).alias(part))
    left = spread(found.join(parts, on).withColumn(part, F.pmod(F.xxhash64(needle, *(c for c in kept if c not in on)), part)), *on, part)
    hays = texts.where(F.col(text).isNotNull()).select(*on, *rest, F.col(text).alias(hay)).join(parts, on).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(part) - 1)))
    # the work lies in the pairs, so they stay where they were dealt
    pairs = left.join(hays.hint("merge"), [*on, part]).select(*kept, *rest, needle, hay)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name not in (needle, hay))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            at, out = [], []
            needles, hays = batch.column(needle).to_pylist(), batch.column(hay).to_pylist()
            low = {t: lowered(t) for t in set(hays)}
            for i, room in sorted(_worth(needles, hays, low, least)):
                small, large = needles[i], hays[i]
                if best := best_window(lowered(small), low[large], least, room):
                    score, start, end = best
                    span = large[start:end][: len(small) + 100]
                    at.append(i)
                    out.append((small[:SHOWN], start, span[:SHOWN], len(span), score / 100))
            columns = list(zip(*out)) or [(), (), (), (), ()]
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in [*kept, *rest]), *(pa.array(c, t) for c, t in zip(columns, types))], [*kept, *rest, chunk, "char_offset", "span", "span_length", "similarity"])

    return pairs.mapInArrow(run, f"{kinds}, `{chunk}` string, char_offset long, span string, span_length long, similarity double")


def linked_by_words(chunks: DataFrame, texts: DataFrame, key: str, text_key: str, chunk: str = "chunk", text: str = "text", share: float = 0.6) -> DataFrame:
    """key, text_key of each chunk and text that share at least `share` of the chunk's distinct words, where nothing else links the two tables.

    A chunk that shares so many words shares one of its rarest words, as many as may be missing and one more. So only these are
    joined with the words of texts, rarest first by their number of texts, and the pairs found are then counted over all words.
    """
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"(?U)\W+"), lambda w: w != ""))
    c = chunks.select(F.col(key).alias("k"), words(F.col(chunk)).alias("words")).where(F.size("words") > 0)
    c = c.withColumn("need", F.ceil(F.size("words") * share - 1e-9).cast("int"))
    t = texts.select(F.col(text_key).alias("t"), words(F.col(text)).alias("words"))
    wanted = c.select("k", F.size("words").alias("n"), "need", F.explode("words").alias("word"))
    of_texts = t.select("t", F.explode("words").alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    often = of_texts.groupBy("word").agg(F.count("*").alias("texts"))
    rare = Window.partitionBy("k").orderBy("texts", "word")
    # a word of no text is among those that are missing
    first = wanted.join(often, "word", "left").withColumn("texts", F.coalesce("texts", F.lit(0))).withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= F.col("n") - F.col("need") + 1)
    pairs = first.where("texts > 0").select("k", "word").join(of_texts, "word").select("k", "t").distinct()
    # few bytes may be much work, so pairs are dealt over tasks before a text's many words are looked up among a chunk's few
    both = spread(pairs, "t").join(c, "k").join(t.withColumnRenamed("words", "others"), "t")
    counted = both.where(F.size(F.array_intersect("others", "words")) >= F.col("need"))
    return counted.select(F.col("k").alias(key), F.col("t").alias(text_key))
