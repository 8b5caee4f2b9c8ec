"""Text expressions: extraction, parsing, normalisation, scoring. Patterns stay in what Java and RE2 share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of visit labels with their spellings; days and confidence of those that count from day 1.
UNITS = {"cycle": ["cycle", "c"], "day": ["day", "d"], "week": ["week", "wk", "w"], "month": ["month", "mo"]}
SPANS = [("week", 7, 0.9), ("month", 30, 0.8)]
# Milestones by phrase, the day that each stands for, and its confidence; day 0 is filled in later. # is a number.
MILESTONES = [
    ("screening", -14, 1.0, ["screen", "screening"]),
    ("baseline", 1, 1.0, ["baseline"]),
    ("eot", 0, 0.7, ["end of treatment", "end of study", "eot", "eos"]),
    ("follow_up", 0, 0.7, ["follow up", "followup", "fu", "post treatment", "posttreatment"]),
    ("repeating", 0, 0.5, ["every # cycle thereafter", "every # cycles thereafter", "q # w thereafter", "q # c thereafter"]),
]
# Phrases that state the length of a cycle, the days that their number counts in, and the days where none does.
CYCLE_PHRASES = [("# day cycle", 1), ("# day treatment cycle", 1), ("q # w", 7), ("every # days", 1)]
DEFAULT_CYCLE = 21
# Date forms in the order in which they are tried.
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = [rf"\b\d{{1,2}}\s+{MONTHS}\s+\d{{4}}\b", rf"\b{MONTHS}\s+\d{{1,2}},?\s+\d{{4}}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}/\d{2}/\d{4}\b"]


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column | str, pattern: str, group: int = 1) -> Column:
    return found(text, pattern, group).try_cast("long")


def first_of(text: Column | str, rules: list[tuple[str, int, float]]) -> tuple[Column, Column]:
    """Value and confidence of the first of (pattern, group, confidence) that matches; '' and 0.0 if none does."""
    value = F.coalesce(*(found(text, p, g) for p, g, _ in rules), F.lit(""))
    confidence = F.lit(0.0)
    for p, g, c in reversed(rules):
        confidence = F.when(found(text, p, g).isNotNull(), c).otherwise(confidence)
    return value, confidence


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def spelled(text: Column | str, keep: str = "") -> Column:
    """Lower-case words and numbers, each between single spaces; a number stands apart from letters around it."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), r"([a-z])([0-9])", "$1 $2"), r"([0-9])([a-z])", "$1 $2")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, f"[^a-z0-9{keep}]+", " ")), F.lit(" "))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def says(plain: Column, phrases: list[str]) -> Column:
    """Whether spelled words, their numbers replaced by #, hold one of the phrases."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(plain, F.lit(f" {phrase} "))
    return hit


def number_in(words: Column, phrase: str) -> Column:
    """The number at # of a phrase in spelled words."""
    return number(words, " " + phrase.replace("#", "([0-9]+)") + " ")


def counted(words: Column, unit: str) -> Column:
    """The number after the first of a unit's spellings that one follows, in spelled words."""
    return number(words, f" (?:{'|'.join(UNITS[unit])}) ([0-9]+) ")


def visit_day(label: Column, cycle: Column | int = DEFAULT_CYCLE) -> Column:
    """A struct (day, method, confidence) of a visit label. Relative visits have day 0 until milestones are filled."""
    made = lambda day, method, c: F.struct(day.cast("long").alias("day"), F.lit(method).alias("method"), F.lit(c).alias("confidence"))
    baseline = next(phrases for name, _, _, phrases in MILESTONES if name == "baseline")

    def read(x: Column) -> Column:
        # a minus belongs to its number, so that days before the first are no plain days
        numbers = [counted(x["signed"], unit).alias(unit) for unit in UNITS]
        return F.struct(x["cycle_days"].alias("cycle_days"), F.regexp_replace(F.regexp_replace(x["signed"], "[- ]+", " "), "[0-9]+", "#").alias("plain"), *numbers)

    def decide(n: Column) -> Column:
        rules = [
            (n["cycle"].isNotNull() & n["day"].isNotNull(), made((n["cycle"] - 1) * n["cycle_days"] + n["day"], "cycle_day", 0.95)),
            ((n["day"] == 1) & says(n["plain"], baseline), made(F.lit(1), "baseline_day1", 1.0)),
            (n["day"].isNotNull(), made(n["day"], "explicit_day", 1.0)),
            *((n[unit].isNotNull(), made((n[unit] - 1) * days + 1, unit, c)) for unit, days, c in SPANS),
            *((says(n["plain"], phrases), made(F.lit(day), name, c)) for name, day, c, phrases in MILESTONES),
            (n["cycle"].isNotNull(), made((n["cycle"] - 1) * n["cycle_days"] + 1, "cycle_only", 0.85)),
        ]
        out = made(F.lit(0), "unresolved", 0.0)
        for holds, value in reversed(rules):
            out = F.when(holds, value).otherwise(out)
        return out

    given = F.struct((F.lit(cycle) if isinstance(cycle, int) else cycle).alias("cycle_days"), spelled(label, "-").alias("signed"))
    return bound(given, lambda x: bound(read(x), decide))


def cycle_length(text: Column | str) -> Column:
    """Days of a treatment cycle that a text states, else the default."""
    words = spelled(text)
    return F.coalesce(*(number_in(words, phrase) * days for phrase, days in CYCLE_PHRASES), F.lit(DEFAULT_CYCLE)).cast("long")


def date_of(text: Column | str) -> tuple[Column, Column]:
    return first_of(text, [(p, 0, 0.92) for p in DATES])


def sentences(text: Column) -> Column:
    """Parts between sentence ends that white space follows, and between lines."""
    return F.split(text, r"[.!?][ \t\n\f\r]+|\n")


def one_line(text: Column) -> Column:
    """Lower case, with single spaces for white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\f\r]+", " "))


def lines_like(text: Column | str, pattern: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))


def keywords(text: Column | str, stop: list[str]) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, stop)))


def overlap(text: Column, words: Column) -> Column:
    """Share of the words that a text contains; null of no words."""
    low = F.lower(text)
    return F.try_divide(F.size(F.filter(words, lambda w: F.contains(low, w))), F.size(words))


def best_sentence(text: Column, words: list[str]) -> Column:
    """A struct (score, pos, sentence): the first sentence with most of the words."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    score = lambda s: sum((F.contains(F.lower(s), F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.array_max(F.transform(sentences, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("pos"), s.alias("sentence"))))


def pattern_score(text: Column, patterns: list[str], words: list[str]) -> Column:
    """(2 * patterns hit + words hit) / (2 * patterns + words)."""
    hits = sum((2 * text.rlike(p).cast("int") for p in patterns), F.lit(0)) + sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    return hits / (2 * len(patterns) + len(words))


def masked_digits(text: Column | str) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def format_of(text: Column) -> Column:
    """A struct (format, confidence): table, list, short or long text."""
    n_lines = F.size(F.split(text, "\n"))
    pipes, items = F.size(lines_like(text, r"\|.*\|")), F.size(lines_like(text, r"^\s*(?:[-*]\s+|\d+[.)]\s+)"))
    made = lambda f, c: F.struct(F.lit(f).alias("format"), c.alias("confidence"))
    return (
        F.when(pipes >= 2, made("table", F.least(F.lit(0.95), 0.70 + 0.05 * pipes)))
        .when((items >= 3) & (items >= 0.3 * n_lines), made("list", F.least(F.lit(0.92), 0.65 + 0.03 * items)))
        .when(F.length(text) < 200, made("text_short", F.lit(0.70)))
        .otherwise(made("text_long", F.lit(0.50)))
    )


def natural_key(code: Column | str) -> Column:
    """Parts of a dotted code as numbers; what is no number counts as 0."""
    return F.transform(F.split(code, "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def first_keyword(text: Column, ordered: list[tuple[str, str]], default: str) -> Column:
    """The label of the first keyword, in list order, that the lower-case text contains."""
    out = F.lit(default)
    for word, label in reversed(ordered):
        out = F.when(F.contains(F.lower(text), F.lit(word)), label).otherwise(out)
    return out


def relevance(text: Column, words: list[str]) -> Column:
    """Keywords hit, a fifth each, at most 1."""
    return F.least(sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0)) / 5, F.lit(1.0))


def garbage_header(title: Column) -> Column:
    """Headers that are too long, cite authors, or hold two or more scraps of recognition."""
    words = F.split(title, r"\s+")
    common = ["a", "an", "as", "at", "by", "de", "du", "en", "es", "if", "in", "is", "it", "la", "le", "of", "on", "or", "se", "to", "un", "we"]
    scraps = F.filter(words, lambda w: (F.length(w) <= 2) & ~F.lower(w).isin(common) | w.startswith("-"))
    return (F.length(title) > 100) | title.rlike(r"[A-Z][a-z]+,? [A-Z]\.") | (F.size(scraps) >= 2)
