"""Blocks with carry and sub-sections against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import blocks as B


def heading(line: str) -> bool:
    words = re.split("[ \t]+", line)
    second = words[1] if len(words) > 1 else ""
    numbered = bool(re.fullmatch(r"\d+(\.\d+)*\.?[.)]", words[0])) and ".." not in words[0] and second[:1].isupper() and second[:1].isascii()
    return numbered or bool(re.fullmatch(r"[A-Z][A-Z \t]{3,}", line)) or words[0] in ("Section", "SECTION", "Part", "PART") and bool(re.match("[A-Z0-9]", second))


def plain_blocks(text, least):
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if heading(x)]
    if not starts:
        return [text]
    raw = ["\n".join(lines[a:b]) + ("\n" if b < len(lines) else "") for a, b in zip(starts, [*starts[1:], len(lines)])]
    out, carry = [], ""
    for b in raw:
        carry += b
        if len(carry) >= least:
            out.append(carry)
            carry = ""
    if carry:
        out[-1:] = [out[-1] + carry] if out else [carry]
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    line = lambda: rng.choice(["1. Title of it", "2.3) Another", "4.5. lower", "ALL CAPS", "ABC", "Section 3 of", "Part B", "PART x", "", " ", "  1. Indented", "1..2. Bad", "some words that go on " * rng.randrange(1, 9), "1 Title", "Ä B C D"])
    return ["\n".join(line() for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 60, 500])
def test_heading_blocks(spark, least):
    rows = [*texts(least), "", "no heading", "ONE HEADING", "x\n1. A", None]
    got = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", B.heading_blocks(F.col("t"), least).alias("b")).collect()
    for r in got:
        t = rows[r["id"]]
        assert r["b"] == (None if t is None else plain_blocks(t, least)), t


SUBS = [("B.1", "Trial Identifiers", "sponsor name and trial number"), ("B.2", "Primary Objective", "main objective endpoint of the trial"), ("B.3", "Safety", "adverse events safety reports")]


def plain_subsections(text, parent):
    words = lambda s, stop=(): sorted({w for w in re.findall("[a-z]{3,}", s.lower()) if w not in stop})

    def best(t, sets, share, default):
        top, code = 0.0, default
        for c, ws in sets:
            score = sum(w in t for w in ws) / len(ws)
            if score > top:
                top, code = score, c
        return code if top >= share else default

    names, about = [(c, words(n)) for c, n, _ in SUBS], [(c, words(d, B.STOP_WORDS)) for c, _, d in SUBS]
    lines = text.split("\n")
    found = []
    for i, x in enumerate(lines):
        w = [y for y in re.split(r"\s+", x) if y.replace("#", "")]
        if w and re.fullmatch(r"\d[\d.]*", w[0]) and len(w) > 1 and re.match("[A-Z]", w[1]):
            code = best(" ".join(w[1:]).lower(), names, 0.30, None)
            if code:
                found.append((i, code))
    parts = {c: [] for c, _, _ in SUBS} | {parent: []}
    if len(found) >= 2:
        for (a, code), b in zip(found, [*(i for i, _ in found[1:]), len(lines)]):
            parts[code].append("\n".join(lines[a:b]).strip())
        parts[parent].append("\n".join(lines[: found[0][0]]).strip())
    else:
        for p in re.split(r"\n\s*\n", text.strip()):
            parts[parent if len(p.strip()) < 30 else best(p.lower(), about, 0.08, parent)].append(p)
    return [(c, "\n\n".join(y for y in x if y)) for c, x in parts.items() if any(x)]


def test_subsections(spark):
    rng = random.Random(8)
    line = lambda: rng.choice(["## 1.1 Trial identifiers", "1.2 Primary objective of it", "3 Safety", "2. Objective", "1.4 Unknown thing", "preamble", "", "", "The sponsor of this trial and its number are given here.", "adverse events are reported for safety in this part", "nothing that says anything about any of these things"])
    rows = ["\n".join(line() for _ in range(rng.randrange(0, 14))) for _ in range(80)] + ["", "1.1 Trial Identifiers\n1.2 Primary Objective", None]
    got = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", B.subsections(F.col("t"), SUBS, "B").alias("s")).collect()
    split = 0
    for r in got:
        t = rows[r["id"]]
        want = None if t is None else plain_subsections(t, "B")
        assert (r["s"] if r["s"] is None else [tuple(x) for x in r["s"]]) == want, t
        split += len(want or []) > 2
    assert split > 5
