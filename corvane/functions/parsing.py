"""Parsers of protocol phrases: citations, contents lists, tables, doses, eligibility, endpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import bound, found, number, sentences, spelled

#: Letters of a reference that is given in full.
FULL_REFERENCE = 60
# The public syntax of DOI names and of PubMed numbers.
DOI_NAME, PUBMED_NUMBER = r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+", r"pmid[: ]+[0-9]{1,8}"
# Routes and frequencies.
ROUTES = [
    ("oral", "ORAL"), ("orally", "ORAL"), ("po", "ORAL"), ("intravenous", "INTRAVENOUS"), ("iv", "INTRAVENOUS"), ("subcutaneous", "SUBCUTANEOUS"), ("sc", "SUBCUTANEOUS"), ("sq", "SUBCUTANEOUS"),
    ("intramuscular", "INTRAMUSCULAR"), ("im", "INTRAMUSCULAR"), ("topical", "TOPICAL"), ("transdermal", "TRANSDERMAL"), ("inhalation", "INHALATION"), ("intranasal", "INTRANASAL"), ("ophthalmic", "OPHTHALMIC"),
]
FREQUENCIES = [
    ("twice daily", "BID"), ("twice a day", "BID"), ("three times daily", "TID"), ("four times daily", "QID"), ("once daily", "QD"), ("every two weeks", "Q2W"), ("every 2 weeks", "Q2W"), ("every three weeks", "Q3W"),
    ("every 3 weeks", "Q3W"), ("every 4 weeks", "Q4W"), ("every week", "QW"), ("single dose", "ONCE"), ("b.i.d", "BID"), ("biweekly", "Q2W"), ("monthly", "QM"), ("weekly", "QW"), ("daily", "QD"), ("bid", "BID"), ("tid", "TID"),
    ("qid", "QID"), ("qd", "QD"), ("once", "ONCE"),
]
DOSE_UNITS = ["mg/kg", "mg", "g", "mcg", "ug", "µg", "ml", "iu", "units", "unit"]
# What is done at visits, how visits are named, units of intervals, and the confidence of each form of sentence.
DONE = ["performed", "collected", "assessed", "obtained", "measured", "done"]
VISIT_NAMES = ["screening", "baseline", "day #", "week #", "month #", "cycle #", "visit #", "end of treatment", "end of study", "early termination", "follow up", "followup", "unscheduled"]
INTERVALS = ["cycle", "week", "month", "visit"]
AT_VISITS, AT_INTERVALS, AT_EACH = 0.70, 0.65, 0.60
#: Words that lead from a name to its visits, words that stand before a verb of DONE, and articles.
LEADS, HELPERS, ARTICLES = ["at", "during", "on"], ["will be", "is", "are"], ["a", "an", "the"]


def is_citation(line: Column) -> Column:
    """A reference given in full: it names a DOI or PubMed number, or is in author-date style, or in numbered style.

    Author-date: a surname first, an initial before the bracketed year, and a sentence after it. Numbered: an ordinal, a surname, and
    initials that a comma or full stop ends. Mentions in brackets within a sentence are none.
    """
    low, word = F.lower(line), F.split(line, " +")
    named = (F.contains(low, F.lit("doi")) & low.rlike(DOI_NAME)) | low.rlike(PUBMED_NUMBER)
    surname = lambda x: F.coalesce(x.rlike(r"^\p{Lu}\p{Ll}"), F.lit(False))
    before, after = F.substring_index(line, "(", 1), F.substring_index(line, ").", -1)
    dated = line.rlike(r"\((1[5-9]|20)[0-9][0-9][a-z]?\)\.") & surname(line) & before.rlike(r"\p{Lu}\.") & F.contains(F.trim(after), F.lit("."))
    ordinal = F.translate(F.get(word, F.lit(0)), "[].)", "").rlike("^[0-9]{1,3}$") & F.get(word, F.lit(0)).rlike(r"[\].)]$")
    numbered = ordinal & surname(F.get(word, F.lit(1))) & F.get(word, F.lit(2)).rlike(r"^\p{Lu}{1,3}[.,]")
    return (F.length(line) >= FULL_REFERENCE) & (named | dated | F.coalesce(numbered, F.lit(False)))


def contents_entry(line: Column) -> Column:
    """A struct (number, title, page, level) of a contents line; nulls if it is none."""
    p = r"^(\d+(?:\.\d+)*)\.?\s+(.*?)\s*\.{3,}\s*(\d+)$"
    n = found(line, p, 1)
    return F.struct(n.alias("number"), found(line, p, 2).alias("title"), found(line, p, 3).try_cast("int").alias("page"), F.size(F.split(n, "[.]")).alias("level"))


def pipe_cells(row: Column) -> Column:
    """Trimmed cells of a row between pipes."""
    return F.transform(F.split(F.regexp_replace(row, r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))


def synonym_day(label: Column) -> Column:
    """A struct (day, follow_up): years of 365 days, months of 30 (over six: follow-up), weeks of 7, days."""
    year, month, week, day = (number(label, p) for p in (r"[Yy]ear\s*(\d+)", r"[Mm]onth\s*(\d+)", r"[Ww]eek\s*(\d+)", r"[Dd]ay\s*(-?\d+)"))
    return F.struct(F.coalesce(year * 365, month * 30, week * 7, day, F.lit(0)).cast("long").alias("day"), F.coalesce(month > 6, F.lit(False)).alias("follow_up"))


def _is_visit(label: Column) -> Column:
    names = F.array(*(F.lit(f" {name} ") for name in VISIT_NAMES))
    return bound(F.regexp_replace(spelled(label), "[0-9]+", "#"), lambda plain: F.exists(names, lambda name: F.startswith(plain, name)))


def _without_end(phrase: str) -> Callable[[Column], Column]:
    """Words without a phrase that they end with."""
    n = len(phrase.split(" "))

    def cut(words: Column) -> Column:
        ends = F.lower(F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")) == phrase
        return F.when(ends, F.slice(words, F.lit(1), F.size(words) - n)).otherwise(words)

    return cut


def _name(words: Column) -> Column:
    """The words before a lead, without article, verb and the verb's helper, as a name."""
    last = lambda w: F.lower(F.coalesce(F.get(w, F.size(w) - 1), F.lit("")))

    def without_verb(w: Column) -> Column:
        bare = F.slice(w, F.lit(1), F.size(w) - 1)
        for helper in HELPERS:
            bare = bound(bare, _without_end(helper))
        return F.when(last(w).isin(DONE), bare).otherwise(w)

    article = lambda w: F.when(F.lower(F.coalesce(F.get(w, F.lit(0)), F.lit(""))).isin(ARTICLES), F.slice(w, F.lit(2), F.size(w))).otherwise(w)
    return F.array_join(bound(bound(words, without_verb), article), " ")


def _first_place(words: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """The first place, from 0, whose word and place hold; null if none does."""
    return F.array_min(F.filter(F.transform(words, lambda w, i: F.when(holds(F.lower(w), i), i)), lambda i: i.isNotNull()))


def _next(words: Column, place: Column, after: int) -> Column:
    return F.lower(F.coalesce(F.get(words, place + after), F.lit("")))


def narrative_pairs(text: Column) -> Column:
    """An array of (name, visit, confidence) of sentences that say what is done at which visits, at which intervals, or at each visit.

    Sentences are read as words, commas being words too. A sentence has a lead ("at", "during" or "on" before a list of visits, "every" before a
    number and a unit, "each" or "every" before a visit); the words before it, without article and verb, are the name. Of equal names
    and visits, whatever their case, the first one of the first form counts.
    """
    pair = lambda name, visit, c: F.struct(name.alias("name"), visit.alias("visit"), F.lit(c).alias("confidence"))
    none = F.array().cast("array<struct<name:string,visit:string,confidence:double>>")
    before = lambda w, place: _name(F.slice(w, F.lit(1), place))

    def words(sentence: Column) -> Column:
        return F.filter(F.split(F.replace(F.rtrim(F.trim(sentence), F.lit(".")), F.lit(","), F.lit(" , ")), r"\s"), lambda w: w != "")

    def listed(w: Column) -> Column:
        def at(place: Column) -> Column:
            tail = F.transform(F.slice(w, place + 2, F.size(w)), lambda x: F.when(F.lower(x).isin(",", "and"), F.lit(",")).otherwise(x))
            labels = F.filter(F.transform(F.split(F.array_join(tail, " "), ","), lambda x: F.trim(x)), _is_visit)
            return bound(before(w, place), lambda name: F.transform(labels, lambda v: pair(name, v, AT_VISITS)))

        return bound(_first_place(w, lambda x, i: x.isin(LEADS)), lambda place: F.when(place > 0, at(place)).otherwise(none))

    def repeated(w: Column) -> Column:
        unit = lambda place: F.rtrim(_next(w, place, 2), F.lit("s"))
        holds = lambda x, i: (x == "every") & _next(w, i, 1).try_cast("int").isNotNull() & unit(i).isin(INTERVALS)
        plural = lambda place: F.concat(F.rtrim(F.get(w, place + 2), F.lit("s")), F.lit("s"))
        made = lambda place: F.array(pair(before(w, place), F.concat_ws(" ", F.lit("Every"), F.get(w, place + 1), plural(place)), AT_INTERVALS))
        return bound(_first_place(w, holds), lambda place: F.when(place > 0, made(place)).otherwise(none))

    def each(w: Column) -> Column:
        visit = lambda place, k: F.startswith(_next(w, place, k), F.lit("visit"))
        holds = lambda x, i: x.isin("each", "every") & (visit(i, 1) | (_next(w, i, 1) == "scheduled") & visit(i, 2))
        name = lambda place: _name(bound(F.slice(w, F.lit(1), place), _without_end("at")))
        return bound(_first_place(w, holds), lambda place: F.when(place > 0, F.array(pair(name(place), F.lit("Each Visit"), AT_EACH))).otherwise(none))

    read = F.transform(sentences(text), words)
    found = bound(read, lambda r: F.flatten(F.array(*(F.flatten(F.transform(r, form)) for form in (listed, repeated, each)))))
    key = lambda p: F.lower(F.concat(p["name"], F.lit("\u0001"), p["visit"]))
    long = lambda p: F.length(p["name"]) >= 3
    return bound(F.filter(found, long), lambda named: bound(F.transform(named, key), lambda keys: F.filter(named, lambda p, i: F.array_position(keys, key(p)) == i + 1)))


def without_markers(name: Column) -> Column:
    """Without superscripts, stars and daggers."""
    return F.trim(F.regexp_replace(name, r"\^\d+|[*†‡§]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+", ""))


def first_in(text: Column, terms: list[tuple[str, str]]) -> Column:
    """The term of the first keyword, in list order, that a text contains."""
    out = F.lit(None).cast("string")
    for word, term in reversed(terms):
        out = F.when(F.contains(F.lower(text), F.lit(word)), term).otherwise(out)
    return out


def dose(text: Column) -> Column:
    """A struct (dose, unit, route, frequency): the first number with a unit, and controlled terms of route and frequency."""
    p = rf"(?i)(\d+(?:\.\d+)?)\s*({'|'.join(DOSE_UNITS)})(?:[^a-z0-9]|$)"
    return F.struct(found(text, p, 1).try_cast("double").alias("dose"), F.upper(found(text, p, 2)).alias("unit"), first_in(text, ROUTES).alias("route"), first_in(text, FREQUENCIES).alias("frequency"))


def criteria(lines: DataFrame, doc: str) -> DataFrame:
    """Numbered lines (doc, pos, line) with the category of the last heading before them, numbered within it."""
    w = Window.partitionBy(doc).orderBy("pos")
    low = F.lower("line")
    switch = F.when(F.contains(low, F.lit("exclusion")), "exclusion").when(F.contains(low, F.lit("inclusion")), "inclusion")
    rows = lines.withColumn("category", F.last_value(switch, F.lit(True)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = rows.where(F.col("line").rlike(r"^\s*\d+[.)]\s+") & F.col("category").isNotNull())
    return numbered.withColumn("seq", F.row_number().over(Window.partitionBy(doc, "category").orderBy("pos")).cast("long"))


def endpoints(text: Column) -> Column:
    """An array of (kind, value) of response rates, survival months, hazard ratios and p-values."""
    parts = []
    for kind, p in (("ORR", r"ORR[^0-9]{0,20}(\d+(?:\.\d+)?)\s*%"), ("CR", r"\bCR[^0-9]{0,20}(\d+(?:\.\d+)?)\s*%"), ("PFS", r"PFS[^0-9]{0,20}(\d+(?:\.\d+)?)\s*months"), ("OS", r"\bOS[^0-9]{0,20}(\d+(?:\.\d+)?)\s*months"), ("HR", r"\bHR[^0-9]{0,5}(\d+\.\d+)"), ("P", r"\bp\s*[=<]\s*(0?\.\d+)")):
        parts.append(_valued(F.regexp_extract_all(text, F.lit(p), F.lit(1)), kind))
    return F.flatten(F.array(*parts))


def _valued(numbers: Column, kind: str) -> Column:
    return F.transform(numbers, lambda v: F.struct(F.lit(kind).alias("kind"), v.try_cast("double").alias("value")))


def bulleted(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
