"""Texts cut at headings and blank lines, with what is too short carried over."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import bound

#: Characters below which a block is carried into the next one.
LEAST_BLOCK = 500
#: Characters below which a paragraph stays with the parent, and the shares of a heading's and of a paragraph's words that must agree.
LEAST_PARAGRAPH, HEADING_SHARE, PARAGRAPH_SHARE = 30, 0.30, 0.08
# Words that begin a named heading, and words that say nothing about a section.
NAMED = ["Section", "SECTION", "Part", "PART"]
STOP_WORDS = "the and for are what that this with from have has will been should there their which each any all how does used into may can also name".split()

_SEP = "\u0001"


def is_heading(line: Column) -> Column:
    """A number with a full stop or bracket before a capital, a line in capitals, or a named part with its number or letter."""

    def read(w: Column) -> Column:
        first, second = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        capital = second.rlike("^[A-Z]")
        numbered = first.rlike("^[0-9].*[.)]$") & (F.translate(first, "0123456789.)", "") == "") & ~F.contains(first, F.lit("..")) & capital
        return numbered | (first.isin(NAMED) & (capital | second.rlike("^[0-9]")))

    in_capitals = (F.length(line) >= 4) & line.rlike("^[A-Z]") & (F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ \t\r\f", "") == "")
    return in_capitals | (~line.startswith(" ") & bound(F.split(line, "[ \t]+"), read))


def _cut(lines: Column, starts: Column) -> Column:
    """Parts of lines from each start to the next, with their line ends."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))
    part = lambda a, b: F.concat(F.array_join(F.slice(lines, a + 1, b - a), "\n"), F.when(b < F.size(lines), "\n").otherwise(""))
    return F.zip_with(starts, ends, part)


def carried(blocks: Column, least: int = LEAST_BLOCK) -> Column:
    """Blocks of `least` characters or more: shorter ones go before the next, a short last one after the one before it."""
    last = lambda s: F.substring_index(s, _SEP, -1)
    # what stands after the last separator is still being carried while it is short
    joined = F.aggregate(blocks, F.lit("").cast("string"), lambda s, b: F.when(F.length(last(s)) < least, F.concat(s, b)).otherwise(F.concat(s, F.lit(_SEP), b)))

    def done(s: Column) -> Column:
        short = (F.length(last(s)) < least) & F.contains(s, F.lit(_SEP))
        before = s.substr(F.lit(1), F.length(s) - F.length(last(s)) - 1)
        return F.split(F.when(short, F.concat(before, last(s))).otherwise(s), _SEP)

    return bound(joined, done)


def heading_blocks(text: Column, least: int = LEAST_BLOCK) -> Column:
    """A text cut at its headings, short blocks carried into the next one. What stands before the first heading drops; a text without
    headings is one block. Null: null. The character U+0001 must not be in a text; it is taken out."""

    def cut(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
        return bound(starts, lambda s: F.when(F.size(s) == 0, F.array(F.array_join(lines, "\n"))).otherwise(carried(_cut(lines, s), least)))

    return bound(F.split(F.replace(text, F.lit(_SEP), F.lit("")), "\n"), cut)


def _best(text: Column, subs: list[tuple[str, list[str]]], share: float, default: str | None) -> Column:
    """The code whose words a lower-case text holds the greatest share of (ties: the first), if that reaches `share`."""
    codes = F.array(*(F.struct((F.lit(0.0) + sum((F.contains(text, F.lit(w)).cast("double") for w in words), F.lit(0.0)) / len(words)).alias("score"), F.lit(-i).alias("first"), F.lit(code).alias("code")) for i, (code, words) in enumerate(subs) if words))
    return bound(F.array_max(codes), lambda b: F.when((b["score"] >= share) & (b["score"] > 0), b["code"]).otherwise(F.lit(default).cast("string")))


def _plain_words(text: str, stop: list[str] | None = None) -> list[str]:
    return sorted({w for w in re.findall("[a-z]{3,}", text.lower()) if w not in (stop or [])})


def subsections(text: Column, subs: list[tuple[str, str, str]], parent: str) -> Column:
    """An array of (code, text) of a section's sub-sections (code, name, description), in their order, the parent last.

    If two numbered headings or more (with or without marks before them) name a sub-section, the text is cut at these, and what stands before them goes to
    the parent. Else each paragraph goes to the sub-section whose description's words it holds most of, short ones and unclear ones to
    the parent. Parts of one sub-section are put together with a blank line between. Null: null.
    """
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    part = lambda code, t: F.struct(code.alias("code"), t.alias("text"))
    names = [(code, _plain_words(name)) for code, name, _ in subs]
    about = [(code, _plain_words(described, STOP_WORDS)) for code, _, described in subs]

    def named(line: Column) -> Column:
        def read(w: Column) -> Column:
            number, title = F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.array_join(F.slice(w, F.lit(2), F.size(w)), " ")
            numbered = number.rlike("^[0-9]") & (F.translate(number, "0123456789.", "") == "") & F.rtrim(title).rlike("^[A-Z]")
            return F.when(numbered, _best(F.lower(title), names, HEADING_SHARE, None))

        return bound(F.filter(F.split(line, r"\s+"), lambda w: (w != "") & (F.replace(w, F.lit("#"), F.lit("")) != "")), read)

    def by_headings(lines: Column, found: Column) -> Column:
        starts = F.transform(found, lambda x: x["at"])
        regions = F.zip_with(_cut(lines, starts), found, lambda t, x: part(x["code"], strip(t)))
        before = part(F.lit(parent), strip(F.array_join(F.slice(lines, F.lit(1), F.get(starts, F.lit(0))), "\n")))
        return F.concat(regions, F.array(before))

    def by_paragraphs(lines: Column) -> Column:
        paragraphs = F.split(strip(F.array_join(lines, "\n")), r"\n\s*\n")
        code = lambda p: F.when(F.length(strip(p)) < LEAST_PARAGRAPH, F.lit(parent)).otherwise(_best(F.lower(p), about, PARAGRAPH_SHARE, parent))
        return F.transform(paragraphs, lambda p: part(code(p), p))

    def cut(lines: Column) -> Column:
        found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), named(x).alias("code"))), lambda x: x["code"].isNotNull())
        return bound(found, lambda f: F.when(F.size(f) >= 2, by_headings(lines, f)).otherwise(by_paragraphs(lines)))

    def together(parts: Column) -> Column:
        of = lambda code: F.array_join(F.transform(F.filter(parts, lambda p: (p["code"] == code) & (p["text"] != "")), lambda p: p["text"]), "\n\n")
        codes = F.array(*(F.lit(code) for code, _, _ in subs), F.lit(parent))
        return F.filter(F.transform(codes, lambda c: part(c, of(c))), lambda p: p["text"] != "")

    return F.when(text.isNotNull(), bound(bound(F.split(text, "\n"), cut), together))
