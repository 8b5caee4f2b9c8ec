"""Small tables and plain rereadings of the operators' contracts."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    """documents of (id, text) pairs or of texts."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    """Words of which some are frequent."""
    words = []
    for _ in range(n):
        k = int(rng.random() ** 2 * vocabulary)
        words.append("".join("bcdfghklmnprst"[(k * 7 + i * 5) % 14] + "aeiou"[(k + i * 3) % 5] for i in range(1 + k % 4)))
    return " ".join(words)


def near_copies(rng: random.Random, text: str, n: int, edits: int) -> list[str]:
    out = []
    for _ in range(n):
        words = text.split(" ")
        for _ in range(edits):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(10**6)
        out.append(" ".join(words))
    return out


def mixed(seed: int) -> list[str | None]:
    """Texts with copies, near copies, shared passages, short, empty, null, long and repetitive ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 260)) for _ in range(40)]
    passage = prose(rng, 90)
    out: list[str | None] = list(base) + base[:6] + [base[0]] * 12
    for t in base[:8]:
        out += near_copies(rng, t, 6, rng.randrange(1, 12))
    out += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(8)]
    out += [None, "", "", "a", "a b", "a b", "A  B", "\n\n \t", "a" * 1500, "ab" * 700, " ".join(["the"] * 400), prose(rng, 8000), "é" * 450, "x y z w", "x y z w v", None]
    rng.shuffle(out)
    return out


def sets_of(text: str | None, k: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def component_ids(ids: list, links: list[tuple]) -> dict:
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}
