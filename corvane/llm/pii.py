"""Surrogates for personal data: keyed, type-consistent replacements.

Detected: e-mail addresses, phone numbers (grouped, or undivided with a plus or ten digits of a subscriber's form), payment cards, IP
addresses, national ids (ddd-dd-dddd), IBANs, secrets (long hexadecimal strings) and person names: given names of the lists below
(`given` adds more), alone or before a capitalised surname, surnames after a title, and each such surname alone in the same text. Names
of no list and without a title are not found. A surrogate is a keyed permutation (a Feistel network with cycle walking) of all strings of the
same shape: digits stay digits, letters keep case, script and, in names, vowel or consonant; card and IBAN check
digits stay as valid as they were; given names go to the next of their gender and script in a keyed order, so never to themselves;
e-mail hosts under reserved example domains stay.
So equal entities have equal surrogates in the whole corpus and different ones different surrogates.

Collision checks: a surrogate that equals an entity of the corpus, or another's surrogate, is walked one step
further, for some turns. What collides after these is of shapes with few strings: all entities of such a shape are then
assigned together, by steps that are permutations of their own, so that none is left. If a shape has too few strings for that,
its names and mailboxes get a letter more, and again until nothing collides; kinds of fixed length raise then. A surrogate is never
the entity itself or another one of the corpus.
Entities meet as a distinct table; only those that needed further steps are exceptions,
and they reach the tasks by broadcast while few, else by a join over their documents.

Null texts stay null. Texts without entities are unchanged. Repeated rows give repeated results, an empty table gives no rows. Texts of
any length are read whole. Columns of the input are kept, whatever their names; a column n_entities is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, chunks, cut, mapped, with_own_names

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Sofia Julia Laura Elena Clara Alice Sarah Mary Emily Jane Lucy Grace Marie Camille Isabel Carmen Ingrid Petra Sabine Monika Helga Elizabeth Jennifer Linda Patricia Susan Jessica Karen Nancy Margaret Lisa Rachel Rebecca Hannah Olivia Charlotte Sophie Claire Chloe Lucia Pilar Ana Rosa Katrin Claudia".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Daniel Mark Charles Henry Pierre Louis Antoine Carlos Pedro Miguel Hans Klaus Jürgen Stefan Martin Georg William Richard Joseph George Edward Steven Kevin Brian Andrew Matthew Jacob Lucas Noah Oliver Samuel Benjamin Jean François Juan José Luis Javier Wolfgang Matthias".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("f", "greek"): "Ελένη Μαρία Άννα Σοφία".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης".split(),
}
# Titles before names, and the characters that stand for each other.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώς", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ"]
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿаеиоуыэюяёαεηιουωάέήίόύώ"
RESERVED_HOSTS = ("example.com", "example.org", "example.net")

#: A chunk without any of these characters has no entity but names.
HINTS = regex.compile(r"[@\d]")
PATTERN = regex.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{8,15}|[2-9]\d{9})(?![\w-]))"
    r"|(?P<card>(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]))"
)
#: A surname: capital, small letters, perhaps after an apostrophe, with an inner capital or of two parts; and what may stand before it.
_PART = r"(?:[OD]['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?"
_SURNAME = rf"(?:(?:van|von|der|den|de|del|da|di|la) ){{0,3}}(?P<sur>{_PART}(?:-{_PART})?)"


class Names:
    """Given names by gender and script, and the pattern of names: given ones, which may be surnames too, or titles before a surname."""

    def __init__(self, given: dict[tuple[str, str], list[str]]):
        self.given = given
        self.kind = {n: k for k, names in given.items() for n in names}
        self.pattern = regex.compile(
            r"(?<!\p{L})(?=\p{Lu})(?:(?P<given>\L<given>)(?: (?P<given>\L<given>))* " + _SURNAME + r"|(?:\L<titles>\.? )+(?!\L<titles>(?!\p{L}))(?!\L<given> \p{Lu}\p{Ll})" + _SURNAME + r"|(?P<given>\L<given>))(?!\p{L})",
            given=sorted(self.kind),
            titles=TITLES,
        )

    def with_more(self, given: dict[tuple[str, str], list[str]] | None) -> Names:
        if not given:
            return self
        return Names({k: list(dict.fromkeys([*self.given.get(k, []), *given.get(k, [])])) for k in {*self.given, *given}})


LISTED_NAMES = Names(GIVEN)
_CLASS = {c: i for i, a in enumerate(ALPHABETS) for c in a}


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    whole = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(whole) % 97:02d}"


class Permuter:
    """Keyed permutations of 0 .. n - 1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: bytes, i: int, half: int, bits: int) -> int:
        mac = hashlib.blake2b(tag + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big"), key=self.key[:64], digest_size=(bits + 7) // 8 or 1)
        return int.from_bytes(mac.digest(), "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tag: bytes) -> int:
        """A Feistel network over the next even number of bits, walked until the value is in range again."""
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            a, b = x >> bits, x & ((1 << bits) - 1)
            for i in range(8):
                a, b = b, a ^ self._round(tag, i, b, bits)
            x = a << bits | b
            if x < n:
                return x


def letter_classes(text: str, names: bool) -> list[str | None]:
    """The characters that may stand in each place; None: the character stays."""
    out: list[str | None] = []
    for c in text:
        k = _CLASS.get(c)
        if k is None:
            out.append(None)
            continue
        alphabet = ALPHABETS[k]
        if names and k:
            vowel = c.lower() in VOWELS
            alphabet = "".join(x for x in alphabet if (x.lower() in VOWELS) == vowel)
        out.append(alphabet)
    return out


#: Steps up to here walk one permutation; each one beyond is another permutation, taken once; from WIDE on that of a wider shape.
WALK, WIDE = 1000, 1 << 24
#: Kinds that may get longer.
WIDER = ("email", "surname")


class Surrogates:
    def __init__(self, key: bytes, names: Names = LISTED_NAMES):
        self.key, self.names = key, names
        self.perm = Permuter(hmac.new(key, b"surrogates", hashlib.sha256).digest())
        self.of = lru_cache(1 << 15)(self._of)

    def shaped(self, text: str, tag: bytes, classes: list[str | None]) -> str:
        """Another string of the same shape; the tag names the shape, so each shape has its own permutation."""
        places = [i for i, a in enumerate(classes) if a]
        x, n = 0, 1
        for i in places:
            x, n = x * len(classes[i]) + classes[i].index(text[i]), n * len(classes[i])
        shape = "".join(a[0] if a else text[i] for i, a in enumerate(classes))
        x = self.perm.permute(x, n, tag + shape.encode())
        out = list(text)
        for i in reversed(places):
            x, r = divmod(x, len(classes[i]))
            out[i] = classes[i][r]
        return "".join(out)

    def _digits(self, text: str, tag: bytes, keep: set[int] = frozenset()) -> str:
        return self.shaped(text, tag, ["0123456789" if c.isdigit() and i not in keep else None for i, c in enumerate(text)])

    def _of(self, kind: str, text: str, steps: int = 1) -> str:
        """The surrogate after some steps of the permutation; beyond WALK, of the permutation of that number."""
        if steps >= WIDE:
            if kind not in WIDER:
                raise ValueError(f"the corpus has nearly as many values of kind {kind} as there are of one shape")
            local, at, host = text.partition("@")
            text = local + "a" * (steps - WIDE + 1) + at + host
        if steps > WALK:
            return getattr(Surrogates(hmac.new(self.key, b"step %d" % steps, hashlib.sha256).digest(), self.names), f"_{kind}")(text)
        for _ in range(steps):
            text = getattr(self, f"_{kind}")(text)
        return text

    def _email(self, text: str) -> str:
        local, _, host = text.rpartition("@")
        local = self.shaped(local, b"email", letter_classes(local, False))
        low = host.lower()
        if not any(low == h or low.endswith("." + h) for h in RESERVED_HOSTS):
            name, _, top = host.rpartition(".")
            host = self.shaped(name, b"host", letter_classes(name, False)) + "." + top
        return f"{local}@{host}"

    def _secret(self, text: str) -> str:
        hexes = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
        return self.shaped(text, b"secret", [hexes] * len(text))

    def _ip(self, text: str) -> str:
        x = 0
        for part in text.split("."):
            x = x << 8 | int(part)
        x = self.perm.permute(x, 1 << 32, b"ip")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _card(self, text: str) -> str:
        """The first and the check digit depend on the rest as they did before."""
        at = [i for i, c in enumerate(text) if c.isdigit()]
        off = (int(text[at[-1]]) - luhn("".join(text[i] for i in at[:-1]))) % 10
        out = self._digits(text, b"card", {at[0], at[-1]})
        last = (luhn("".join(out[i] for i in at[:-1])) + off) % 10
        return out[: at[-1]] + str(last) + out[at[-1] + 1 :]

    def _iban(self, text: str) -> str:
        at = [i for i, c in enumerate(text) if c != " "]
        plain = "".join(text[i] for i in at)
        valid = iban_check(plain[:2], plain[4:]) == plain[2:4]
        rest = self.shaped(plain[4:], b"iban" + plain[:2].encode(), letter_classes(plain[4:], False))
        check = iban_check(plain[:2], rest) if valid else self._digits(plain[2:4], b"check" + rest.encode())
        out = list(text)
        for i, c in zip(at, plain[:2] + check + rest):
            out[i] = c
        return "".join(out)

    def _ssn(self, text: str) -> str:
        return self._digits(text, b"ssn")

    def _phone(self, text: str) -> str:
        """Country codes stay, and so does the exchange 555, which no subscriber has."""
        country = regex.match(r"\+\d{1,3}(?!\d)|\+\d\d(?=\d+$)", text)
        keep = set(range(country.end() if country else 0))
        fiction = regex.search(r"(?<=[ .)-])555(?=[ .-])", text)
        return self._digits(text, b"phone", keep | (set(range(*fiction.span())) if fiction else set()))

    def _given(self, text: str) -> str:
        names = sorted(self.names.given[self.names.kind[text]], key=lambda n: hmac.new(self.key, n.encode(), hashlib.sha256).digest())
        return names[(names.index(text) + 1) % len(names)]

    def _surname(self, text: str) -> str:
        return self.shaped(text, b"surname", letter_classes(text, True))


class First(Permuter):
    """Everything becomes 0, so that a surrogate is the first string of its shape."""

    def permute(self, x: int, n: int, tag: bytes) -> int:
        return 0


def shape(kind: str, text: str) -> str:
    """Equal for the strings that the surrogates of a text are among."""
    first = Surrogates(b"shape")
    first.perm = First(b"shape")
    return first._of(kind, text)


def assigned(kind: str, values: list[str], key: bytes) -> list[int]:
    """Steps of all entities of a shape, so that surrogates differ and are no entities; those of a wider shape if it has too few strings."""
    make, real, used, steps = Surrogates(key), set(values), set(), []
    tries = 64 * len(values) + 4096
    for value in values:
        for s in (1, *range(WALK + 1, WALK + tries)):
            out = make._of(kind, value, s)
            if out not in real and out not in used:
                break
        else:
            return [WIDE] * len(values)
        used.add(out)
        steps.append(s)
    return steps


def detect(text: str, names: Names = LISTED_NAMES) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and value of each entity; the parts of a name are entities of their own, for coreference."""
    found = [(m.start(), m.end(), m.lastgroup, m.group()) for m in PATTERN.finditer(text)] if HINTS.search(text) else []
    taken = {i for a, b, *_ in found for i in range(a, b)}
    people, surnames = [], set()
    for m in names.pattern.finditer(text):
        people += [(*at, "given", text[slice(*at)]) for at in m.spans("given")]
        if m.group("sur"):
            people.append((*m.span("sur"), "surname", m.group("sur")))
            surnames.add(m.group("sur"))
    if surnames:  # a surname alone, later or before, is the same person's
        have = {i for a, b, *_ in people for i in range(a, b)}
        alone = regex.compile(r"(?<!\p{L})\L<sur>(?!\p{L})", sur=sorted(surnames))
        people += [(*m.span(), "surname", m.group()) for m in alone.finditer(text) if m.start() not in have and m.end() - 1 not in have]
    return sorted(found + [x for x in people if x[0] not in taken])


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: Names = LISTED_NAMES) -> DataFrame:
    """id, begin, end, kind, value."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = [(i, *x) for i, t in enumerate(batch.column("text").to_pylist()) if t for x in detect(t, names)]
            if rows:
                at, begin, end, kinds, values = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(kinds), pa.array(values)], [id_col, "begin", "end", "kind", "value"])

    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"{id_col} {kind}, begin long, end long, kind string, value string")


#: Given names share a short list, so two people may swap names; their surnames tell them apart.
LISTED = ("given",)


def exceptions(found: DataFrame, key: bytes, most_turns: int = 20) -> DataFrame:
    """kind, value, steps of the entities that take more than one step. found: distinct kind, value."""
    known = cut(found.where(~F.col("kind").isin(*LISTED)).select("kind", "value").distinct())

    def made(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = Surrogates(key)
            for b in batches:
                out = [make._of(k, v, s) for k, v, s in zip(b.column("kind").to_pylist(), b.column("value").to_pylist(), b.column("steps").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.select(["kind", "value", "steps"]).columns, pa.array(out, pa.string())], ["kind", "value", "steps", "surrogate"])

        return rows.mapInArrow(run, "kind string, value string, steps int, surrogate string")

    def colliding(state: DataFrame) -> DataFrame:
        """A surrogate that is an entity, or that a smaller entity has too."""
        real = known.select(F.col("kind"), F.col("value").alias("surrogate"))
        hits = state.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value", "steps")
        twice = state.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).where("n > 1")
        return cut(hits.unionByName(state.join(twice, ["kind", "surrogate"]).where("value != first").select("kind", "value", "steps")).distinct())

    none = known.limit(0).select("kind", "value", F.lit(2).alias("steps"))
    state = made(known.withColumn("steps", F.lit(1)))
    moved = None
    for turn in range(most_turns + 1):
        hits = colliding(state)
        if hits.isEmpty():
            return moved if moved is not None else none
        if turn == most_turns:
            break
        hits = hits.withColumn("steps", F.col("steps") + 1)
        moved = hits if moved is None else moved.join(hits, ["kind", "value"], "left_anti").unionByName(hits)
        moved = cut(moved)
        state = made(known.join(moved, ["kind", "value"], "left").select("kind", "value", F.coalesce("steps", F.lit(1)).alias("steps")))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shape(k, v) for k, v in zip(b.column("kind").to_pylist(), b.column("value").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.select(["kind", "value"]).columns, pa.array(out, pa.string())], ["kind", "value", "shape"])

    def assign(group: pa.Table) -> pa.Table:
        group = group.sort_by("value")
        steps = assigned(group.column("kind")[0].as_py(), group.column("value").to_pylist(), key)
        return pa.table({"kind": group.column("kind"), "value": group.column("value"), "steps": pa.array(steps, pa.int32())})

    kinds = "kind string, value string, shape string"
    dense = hits.select("kind", "value").mapInArrow(shaped, kinds).select("kind", "shape").distinct()
    whole = cut(known.mapInArrow(shaped, kinds).join(dense, ["kind", "shape"], "left_semi").groupBy("kind", "shape").applyInArrow(assign, "kind string, value string, steps int"))
    rest = moved.join(whole, ["kind", "value"], "left_anti") if moved is not None else none
    moved = cut(rest.unionByName(whole.where("steps > 1")))
    # longer surrogates may meet entities of their own shape: a letter more until none does, as each makes them rarer
    while True:
        hits = colliding(made(known.join(moved, ["kind", "value"], "left").select("kind", "value", F.coalesce("steps", F.lit(1)).alias("steps"))))
        if hits.isEmpty():
            return moved
        hits = hits.withColumn("steps", F.greatest(F.col("steps") + 1, F.lit(WIDE)))
        moved = cut(moved.join(hits, ["kind", "value"], "left_anti").unionByName(hits))


@with_own_names
def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", given: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """The documents with surrogates for their entities, and n_entities. given: more given names by gender and script."""
    names = LISTED_NAMES.with_more(given)
    odd = exceptions(entities(docs, id_col, text_col, names), key)
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*columns)
    if odd.count() <= BROADCAST_ROWS:
        steps = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["steps"] for r in odd.collect()})
        rows = rows.withColumn("__steps", F.lit(None).cast("array<struct<kind:string,value:string,steps:int>>"))
    else:
        steps = docs.sparkSession.sparkContext.broadcast({})
        own = entities(docs, id_col, text_col, names).select(id_col, "kind", "value").distinct().join(odd, ["kind", "value"])
        rows = rows.join(own.groupBy(id_col).agg(F.collect_list(F.struct("kind", "value", "steps")).alias("__steps")), id_col, "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key, names)
        for batch in chunks(batches, text_col):
            texts, counts = [], []
            for t, own in zip(batch.column(text_col).to_pylist(), batch.column("__steps").to_pylist()):
                spans = detect(t, names) if t else []
                more = {(x["kind"], x["value"]): x["steps"] for x in own or ()}
                parts, at = [], 0
                for a, b, kind, value in spans:
                    parts += [t[at:a], make.of(kind, value, more.get((kind, value)) or steps.value.get((kind, value), 1))]
                    at = b
                texts.append("".join([*parts, t[at:]]) if spans else t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, batch.schema.field(c).type) if c == text_col else batch.column(c) for c in columns), pa.array(counts, pa.int64())], [*columns, "n_entities"])

    return mapped(rows.select(*columns, "__steps"), run, f"{fields}, n_entities long")
