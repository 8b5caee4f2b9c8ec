"""Predicates and small array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def boilerplate_header(h: Column) -> Column:
    """Page numbers, metadata, bare dates, and headers over 60 characters."""
    return (F.length(h) > 60) | h.rlike(r"^\s*[Pp]age\s+\d+") | h.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$") | h.rlike(r"(?i)(confidential|version|protocol number|table of contents)")


def schedule_table(headers: Column, visit_pattern: str) -> Column:
    """Five columns or more, three of which name visits."""
    return (F.size(headers) >= 5) & (F.size(F.filter(headers, lambda x: x.rlike(visit_pattern))) >= 3)


def any_phrase(text: Column | str, phrases: list[str]) -> Column:
    return F.lower(text).rlike("(" + "|".join(phrases) + ")")


def padded(values: Column | str, n: int, fill: str) -> Column:
    """Cut or filled to n elements."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)


def alignment(population: Column, endpoint: Column, temporal: Column, domain: Column) -> Column:
    """.3 population + .3 endpoint + .2 temporal + .2 domain; what is missing counts .5."""
    known = lambda c: F.coalesce(c, F.lit(0.5))
    return 0.3 * known(population) + 0.3 * known(endpoint) + 0.2 * known(temporal) + 0.2 * known(domain)
