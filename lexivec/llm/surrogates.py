"""Personal data replaced by keyed surrogates of the same kind, format, script and gender.

A surrogate is found by a keyed permutation of all values of the same shape. Equal values have equal
surrogates wherever they stand, different ones different surrogates, and no value is its own, without any
table of values.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_VALUES = 1 << 18
ROUNDS = 6

# Titles that tell the gender, and given names by gender and script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Господин"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"]}
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Jürgen",
                     "Pierre", "Jean", "Carlos", "Miguel", "José", "Paul"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Ursula",
                     "Greta", "Marie", "Claire", "Carmen", "Lucía", "María", "Alice"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Николай", "Сергей", "Алексей", "Дмитрий"],
    ("f", "cyrillic"): ["Мария", "Анна", "Елена", "Ольга", "Наталья", "Татьяна"],
}
GENDER = {name: (gender, script) for (gender, script), names in GIVEN.items() for name in names}

# Letters change within a class, so that words keep script, case and the place of vowels.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
           "áàâäéèêëíîïóôöúùûü", "çñß", "ÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÙÛÜ", "ÇÑ",
           "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
           "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "0123456789"]
CLASS_OF = {c: k for k, cs in enumerate(CLASSES) for c in cs}

_TITLED = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
PATTERN = re.compile(
    r"(?P<email>[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<!\w)\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?!\w))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16})(?!\w))"
    rf"|(?P<titled>\b(?:{_TITLED})\.? {_NAME}(?: {_NAME})?)"
    rf"|(?P<named>\b(?:{'|'.join(GENDER)}) {_NAME})")
# One of these stands in or before every match; texts without any need no search.
HINT = re.compile(rf"[\d@]|\b(?:{_TITLED}|{'|'.join(GENDER)})\b|[A-F]{{32}}|[a-f]{{32}}|AKIA")


class Permutation:
    """A keyed permutation of 0..size-1 without fixed points (size above 1): a cyclic step seen through a Feistel
    network that walks until it is back in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, -(-max(size - 1, 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.bytes = -(-self.half // 8)
        self.seed = hashlib.blake2b(tweak.encode(), key=key, digest_size=32).digest()

    def _mix(self, n: int, value: int) -> int:
        data = bytes([n]) + value.to_bytes(self.bytes, "big")
        out, block = b"", 0
        while len(out) < self.bytes:
            out += hashlib.blake2b(data + bytes([block]), key=self.seed, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[:self.bytes], "big") & self.mask

    def _forward(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for n in range(ROUNDS):
            left, right = right, left ^ self._mix(n, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for n in reversed(range(ROUNDS)):
            left, right = right ^ self._mix(n, left), left
        return left << self.half | right

    def _walk(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.size:
            x = step(x)
        return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        return self._walk(self._back, (self._walk(self._forward, x) + 1) % self.size)


def permuted(key: bytes, tweak: str, digits: list[int], radices: list[int],
             fits: Callable[[list[int]], bool] = lambda _: True) -> list[int]:
    """Moves a mixed-radix number by a keyed permutation of those that ``fits`` accepts."""
    size = 1
    for r in radices:
        size *= r
    step, x = Permutation(key, f"{tweak}|{radices}", size), 0
    for d, r in zip(digits, radices):
        x = x * r + d
    while True:
        x, rest, out = step(x), 0, []
        rest = x
        for r in reversed(radices):
            rest, d = divmod(rest, r)
            out.append(d)
        out.reverse()
        if fits(out):
            return out


def letters(key: bytes, tweak: str, text: str, fits: Callable[[str], bool] = lambda _: True) -> str:
    """Every letter and digit moves within its class; other signs and CJK-external scripts stay."""
    spots = [(i, CLASSES[CLASS_OF[c]]) for i, c in enumerate(text) if c in CLASS_OF]
    wide = [i for i, c in enumerate(text) if "\u4e00" <= c <= "\u9fa5"]
    digits = [cs.index(text[i]) for i, cs in spots] + [ord(text[i]) - 0x4E00 for i in wide]
    radices = [len(cs) for _, cs in spots] + [0x9FA6 - 0x4E00] * len(wide)
    fixed = "".join("*" if c in CLASS_OF or i in set(wide) else c for i, c in enumerate(text))

    def spelled(values: list[int]) -> str:
        out = list(text)
        for (i, cs), d in zip(spots, values):
            out[i] = cs[d]
        for i, d in zip(wide, values[len(spots):]):
            out[i] = chr(0x4E00 + d)
        return "".join(out)

    if not digits:
        return text
    tweak = f"{tweak}|{fixed}|{[CLASS_OF.get(c, -1) for c in text]}"
    return spelled(permuted(key, tweak, digits, radices, lambda v: fits(spelled(v))))


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def zero_of(digit: str) -> int:
    """The code point of the zero in the digit's script."""
    return ord(digit) - unicodedata.decimal(digit)


def number(key: bytes, kind: str, text: str, first: int, fits: Callable[[str], bool] = lambda _: True) -> str:
    """The digits from place ``first`` on move, each within its script; a number that does not begin with 0 keeps
    that. Numbers in different scripts are of different shapes."""
    spots = [i for i, c in enumerate(text) if c.isdecimal()][first:]
    lead = int(text[spots[0]]) != 0
    radices = [9 if k == 0 and lead else 10 for k in range(len(spots))]
    values = [int(text[i]) - (k == 0 and lead) for k, i in enumerate(spots)]

    def spelled(digits: list[int]) -> str:
        out = list(text)
        for k, (i, d) in enumerate(zip(spots, digits)):
            out[i] = chr(zero_of(text[i]) + d + (k == 0 and lead))
        return "".join(out)

    shape = "".join(chr(zero_of(c)) if i in spots else c for i, c in enumerate(text))
    return spelled(permuted(key, f"{kind}|{shape}", values, radices, lambda v: fits(spelled(v))))


def email(key: bytes, text: str) -> str:
    """The local part moves, and the domain below its last label unless it is reserved for examples."""
    local, domain = text.rsplit("@", 1)
    if re.search(r"(?:^|\.)example\.(?:com|org|net)$|\.(?:test|invalid|example)$", domain.lower()):
        return letters(key, f"email|{domain.lower()}", local) + "@" + domain
    below, last = domain.rsplit(".", 1)
    moved = letters(key, f"email|{last.lower()}", f"{local}@{below}")
    return f"{moved}.{last}"


def address(key: bytes, text: str) -> str:
    """Each part keeps its number of digits, their scripts, and stays below 256."""
    low = {1: 0, 2: 10, 3: 100}
    high = {1: 9, 2: 99, 3: 255}
    parts = text.split(".")
    radices = [high[len(p)] - low[len(p)] + 1 for p in parts]
    scripts = "" if text.isascii() else "|" + "".join(chr(zero_of(c)) if c != "." else c for c in text)
    moved = permuted(key, "ip" + scripts, [int(p) - low[len(p)] for p in parts], radices)
    return ".".join("".join(chr(zero_of(c) + int(n)) for c, n in zip(p, str(d + low[len(p)]))) for d, p in zip(moved, parts))


def secret(key: bytes, text: str) -> str:
    head = "AKIA" if text.startswith("AKIA") and len(text) == 20 else ""
    signs = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" if head else (
        "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF")
    body = text[len(head):]
    moved = permuted(key, f"secret|{head}{signs}", [signs.index(c) for c in body], [len(signs)] * len(body))
    return head + "".join(signs[d] for d in moved)


def given_name(key: bytes, name: str, gender: str | None) -> str:
    """A listed name becomes another of its gender and script; any other a word of the same
    shape that is not on the lists."""
    if name in GENDER:
        names = GIVEN[GENDER[name]]
        return names[Permutation(key, f"given|{GENDER[name]}", len(names))(names.index(name))]
    return letters(key, f"name|{gender}", name, lambda w: w not in GENDER)


def person(key: bytes, text: str) -> str:
    """Titles stay; a given name (listed, or the first of two) and the family name move on their own, so that
    the family name alone still points to the same person."""
    words = text.split(" ")
    bare = words[0].rstrip(".")
    gender = next((g for g, ts in TITLES.items() if bare in ts), None)
    head, names = (words[:1], words[1:]) if gender else ([], words)
    out = []
    for k, word in enumerate(names):
        family = k == len(names) - 1 and word not in GENDER
        out.append(letters(key, "family", word, lambda w: w not in GENDER) if family else given_name(key, word, gender))
    return " ".join(head + out)


def surrogate(key: bytes, kind: str, text: str) -> str:
    if kind == "email":
        return email(key, text)
    if kind == "ip":
        return address(key, text)
    if kind == "phone":
        first = len(re.match(r"\+(\d*)", text)[1]) if text[0] == "+" else 0
        first = first if first <= 3 else 0
        return number(key, kind, text, first)
    if kind == "card":
        valid = luhn(re.sub(r"\D", "", text))
        return number(key, kind, text, 0, lambda t: luhn(re.sub(r"\D", "", t)) == valid)
    if kind == "ssn":
        return number(key, kind, text, 0)
    if kind == "secret":
        return secret(key, text)
    return person(key, text)


class Replacer:
    """Finds and replaces; keeps the surrogates it made last."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.made: dict[tuple[str, str], str] = {}

    def of(self, kind: str, value: str) -> str:
        found = self.made.get((kind, value))
        if found is None:
            if len(self.made) >= CACHE_VALUES:
                self.made.clear()
            found = self.made[kind, value] = surrogate(self.key, kind, value)
        return found

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and (kind, start, length in the new text, surrogate) of each."""
        if not HINT.search(text):
            return text, []
        parts, spans, at, size = [], [], 0, 0
        for m in PATTERN.finditer(text):
            kind = m.lastgroup if m.lastgroup != "sep" else "card"
            value = self.of("person" if kind in ("titled", "named") else kind, m[0])
            parts += [text[at:m.start()], value]
            size += m.start() - at
            spans.append(("person" if kind in ("titled", "named") else kind, size, len(value), value))
            size += len(value)
            at = m.end()
        if not spans:
            return text, []
        return "".join([*parts, text[at:]]), spans


ENTITIES = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType())
                       .add("length", T.IntegerType()).add("surrogate", T.StringType()))


def replace_personal_data(docs: DataFrame, key: str | bytes, text: str = "text", entities: str | None = "entities",
                          ) -> DataFrame:
    """``docs`` with surrogates in ``text`` and, if named, a column of what was replaced: kind, start and
    length in the new text, surrogate.

    Found are e-mail and IPv4 addresses, telephone, card and social security numbers, secrets in
    hexadecimal, and persons by title or listed given name. A null text stays null with null entities; empty texts and
    texts without personal data stay as they are; repeated rows stay and get equal surrogates. A column of
    ``docs`` named like ``entities`` is replaced; all other columns are kept. Nothing is shuffled.
    """
    secret_key = key.encode() if isinstance(key, str) else key
    fields = [f for f in docs.schema.fields if not entities or f.name.lower() != entities.lower()]
    extra = T.StructType().add(entities, ENTITIES) if entities else T.StructType()
    schema = T.StructType([*fields, *extra])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()),
                               ("surrogate", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = Replacer(secret_key)
        for batch in batches:
            done = [(None, None) if t is None else replacer.replace(t) for t in batch.column(text).to_pylist()]
            columns = [pa.array([d[0] for d in done], pa.string()) if f.name == text else batch.column(f.name)
                       for f in fields]
            if entities:
                columns.append(pa.array([None if d[1] is None else [
                    dict(zip(("kind", "start", "length", "surrogate"), s)) for s in d[1]] for d in done], kind))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(work, schema)


def surrogate_pairs(docs: DataFrame, key: str | bytes, text: str = "text") -> DataFrame:
    """(kind, value, surrogate) of everything found, each once."""
    secret_key = key.encode() if isinstance(key, str) else key

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = Replacer(secret_key)
        for batch in batches:
            found: dict[tuple[str, str, str], None] = {}
            for body in batch.column(0).to_pylist():
                for m in PATTERN.finditer(body or ""):
                    kind = {"sep": "card", "titled": "person", "named": "person"}.get(m.lastgroup, m.lastgroup)
                    found[kind, m[0], replacer.of(kind, m[0])] = None
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)],
                                             names=["kind", "value", "surrogate"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(work, "kind string, value string, surrogate string").distinct()


def collisions(pairs: DataFrame) -> DataFrame:
    """Surrogates that stand for several values, or equal their value: always empty."""
    return pairs.groupBy("kind", "surrogate").agg(
        F.count_distinct("value").alias("values"),
        F.max((F.col("value") == F.col("surrogate")).cast("int")).alias("unchanged")).filter("values > 1 OR unchanged = 1")
