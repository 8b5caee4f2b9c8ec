"""Person names after capitalised words and with listed surnames; surrogates of shapes with few strings."""

import random
import re

import pytest

from corvane.llm import pii
from tests.llm.helpers import frame


def found(text):
    return [(kind, value) for _, _, kind, value in pii.detect(text)]


def test_names_after_capitalised_words():
    assert found("Contact John Smith") == [("given", "John"), ("surname", "Smith")]
    assert found("When Anna Keller came") == [("given", "Anna"), ("surname", "Keller")]
    assert found("Dear Dr. Anna Maria Keller-Weiss") == [("given", "Anna"), ("given", "Maria"), ("surname", "Keller-Weiss")]
    assert found("Contact Prof. Dr. Keller") == [("surname", "Keller")]
    assert found("Contact Support Team") == []


def test_listed_names_as_surnames():
    for name in ("Anna Martin", "Sarah Thomas"):
        assert found(f"so {name} said") == list(zip(("given", "surname"), name.split()))
    assert found("so Mr Thomas said") == [("surname", "Thomas")]


def test_names_alone():
    assert found("Anna came. Anna Keller spoke to Klaus; Keller left, Smith-Keller too.") == [("given", "Anna"), ("given", "Anna"), ("surname", "Keller"), ("given", "Klaus"), ("surname", "Keller"), ("surname", "Keller")]


def test_dense_shapes(spark):
    # two-letter surnames: 20 x 6 strings, of which `n` are entities; if they are more than half, surrogates get longer
    every = [c + v for c in "BCDFGHJKLMNPQRSTVWXZ" for v in "aeiouy"]
    make = pii.Surrogates(b"key")
    for n in (58, 100, 120):
        names = sorted(random.Random(n).sample(every, n))
        known = spark.createDataFrame([("surname", x) for x in [*names, "Kowalska"]], "kind string, value string")
        steps = {r["value"]: r["steps"] for r in pii.exceptions(known, b"key", 3).collect()}
        out = [make.of("surname", x, steps.get(x, 1)) for x in names]
        assert len(set(out)) == n and not set(out) & {*names, "Kowalska"}


def test_shapes():
    for kind, text in (("surname", "Keller"), ("email", "jo.5@mail.example.com"), ("email", "jo@firm3.de"), ("card", "4111 1111 1111 1112"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("phone", "+1 (743) 555-3824"), ("ip", "13.149.130.89"), ("ssn", "123-45-6789"), ("secret", "24be6443" * 4)):
        make = pii.Surrogates(b"key")
        assert pii.shape(kind, text) == pii.shape(kind, make.of(kind, text)) == pii.shape(kind, make.of(kind, text, pii.WALK + 7))


def test_a_full_shape_gets_wider(spark):
    # all ten mailboxes of one character, and the longer ones that they could become
    mails = [f"{i}@example.com" for i in range(10)] + [f"{i}{c}@example.com" for i in range(10) for c in "abcdefghijklmnopqrstuvwxyz"]
    known = spark.createDataFrame([("email", m) for m in mails], "kind string, value string")
    steps = {r["value"]: r["steps"] for r in pii.exceptions(known, b"key", 2).collect()}
    make = pii.Surrogates(b"key")
    out = [make.of("email", m, steps.get(m, 1)) for m in mails]
    assert len(set(out)) == len(mails) and not set(out) & set(mails)


def test_a_full_shape_of_fixed_length_raises():
    with pytest.raises(ValueError):
        pii.Surrogates(b"key").of("ip", "1.2.3.4", pii.WIDE)


def test_nothing_of_a_name_is_left(spark):
    text = "Maria Lopez came. Maria said that Lopez left. William Turner saw Thomas Paul at 5551234567. Mr O'Brien met Jean de la Fontaine-Weiss, Emma McDonald and +4915112345678."
    assert {v for _, _, k, v in pii.detect(text) if k == "phone"} == {"5551234567", "+4915112345678"}
    got = pii.replace(frame(spark, [text, "Klaus Tiber"]), b"key", given={("m", "latin"): ["Tiber"]}).orderBy("doc_id").collect()
    words = set(re.findall(r"\w+", got[0]["text"]))
    assert not words & {"Lopez", "Turner", "William", "Brien", "Fontaine", "McDonald", "5551234567", "4915112345678"}
    said = re.findall(r"(\w+) (\w+) came. (\w+) said that (\w+) left", got[0]["text"])[0]
    assert said[0] == said[2] != "Maria" and said[1] == said[3]
    assert set(got[1]["text"].split()).isdisjoint({"Klaus", "Tiber"})


def test_given_names_never_stay():
    make = pii.Surrogates(b"key")
    for names in pii.GIVEN.values():
        assert sorted(make.of("given", n) for n in names) == sorted(names) and all(make.of("given", n) != n for n in names)
