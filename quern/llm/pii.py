"""Surrogates for personal data.

Every detected entity gets a replacement drawn by a keyed permutation of its own format: the same value always gets
the same surrogate (coreference), and because the map permutes the values of a format, two values never share one
(distinctness), on any number of machines and without a shuffle. Letters stay letters of their script, vowels
vowels, upper case upper case, digits digits; given names come from a list of the same gender and script; card
numbers keep their issuer digit and Luhn validity, IP addresses their class, IBANs their country and checksum.
`collisions` checks both properties over everything found.

The permutation of a format is one cycle through all its values in a keyed order, and a value is replaced by the next
one of its kind: so no value keeps itself, unless it is the only one. There is no default key: whoever knows it can
invert the replacements.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import need, read

# Letters by script, vowels and consonants apart.
ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåæéèêëíìîïóòôöõøœúùûü", "çñßýÿšžčćđłńśźż",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789",
)
# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Hans Karl Pierre Jean Carlos José Juan Luis".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Anna Greta Marie Claire Carmen María Lucía Elena".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
}
# Endings of family names that tell gender, kept as they are.
ENDINGS = ("ова", "ева", "ина", "ая", "ова", "ska", "ová")
# Titles before a name.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")

# Phrases that a name follows, in the four languages.
PHRASES = (
    "My name is", "my name is", "Dear", "Sincerely,", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "Liebe", "Lieber", "je m'appelle", "Je m'appelle",
    "Cher", "Chère", "me llamo", "Me llamo", "mi nombre es", "Mi nombre es", "Estimado", "Estimada",
)

_CLASS = {c: (k, i) for k, letters in enumerate(ALPHABETS) for i, c in enumerate(letters)}
_FIRST = {name: (where, i) for where, names in GIVEN.items() for i, name in enumerate(names)}
_CAP = r"[A-ZÀ-ÖØ-ÞŠŽ][a-zß-öø-ÿšž]+|[А-ЯЁ][а-яё]+|[Α-Ω][α-ωά-ώ]+"

ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<card>(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w))"
    r"|(?P<phone2>(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))"
    rf"|(?P<name>(?:\b(?:{'|'.join(TITLES)})\b\.? (?:{_CAP})(?: (?:{_CAP}))?)|(?:\b(?:{'|'.join(sorted(_FIRST))})\b(?: (?:{_CAP})))"
    rf"|(?:{'|'.join(rf'(?<=\b{re.escape(p)} )' for p in PHRASES)})(?:{_CAP})(?: (?:{_CAP}))?)"
)
_CUES = {*TITLES, *_FIRST, *(p for p in PHRASES if p.istitle() and p.isalpha())}
_SAID = tuple(p for p in PHRASES if p not in _CUES)
_DIGIT, _CAPITAL = re.compile(r"[@0-9]"), re.compile(r"[A-ZÀ-ÞŠŽА-Я][^\W\d_]+")


def hinted(text: str) -> bool:
    """Whether the text can hold an entity at all; where not, the long pattern need not run."""
    return bool(_DIGIT.search(text)) or not _CUES.isdisjoint(_CAPITAL.findall(text)) or any(p in text for p in _SAID)


def permute(key: bytes, tweak: str, sizes: list[int], value: list[int]) -> list[int]:
    """The mixed-radix number with digits below `sizes` that follows `value` in a keyed order of all of them, the last being
    followed by the first. The order is given by ten rounds of an alternating network, which are undone after one step."""
    if len(sizes) == 1:
        order = sorted(range(sizes[0]), key=lambda i: _prf(key, tweak, i, 99))
        return [order[(order.index(value[0]) + 1) % sizes[0]]]
    half = len(sizes) // 2
    modulus = [_product(sizes[:half]), _product(sizes[half:])]
    part = [_number(sizes[:half], value[:half]), _number(sizes[half:], value[half:])]
    for r in range(10):
        a = r % 2
        part[a] = (part[a] + _prf(key, tweak, part[1 - a], r)) % modulus[a]
    place = (part[0] * modulus[1] + part[1] + 1) % (modulus[0] * modulus[1])
    part = list(divmod(place, modulus[1]))
    for r in reversed(range(10)):
        a = r % 2
        part[a] = (part[a] - _prf(key, tweak, part[1 - a], r)) % modulus[a]
    return _digits(sizes[:half], part[0]) + _digits(sizes[half:], part[1])


def _prf(key: bytes, tweak: str, x: int, r: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{x}".encode(), key=key, digest_size=32).digest())


def _product(sizes: list[int]) -> int:
    out = 1
    for s in sizes:
        out *= s
    return out


def _number(sizes: list[int], value: list[int]) -> int:
    out = 0
    for s, v in zip(sizes, value, strict=True):
        out = out * s + v
    return out


def _digits(sizes: list[int], x: int) -> list[int]:
    out = []
    for s in reversed(sizes):
        x, v = divmod(x, s)
        out.append(v)
    return out[::-1]


def _letters(key: bytes, kind: str, text: str, fixed: Callable[[int], bool] = lambda i: False) -> str:
    """`text` permuted among the texts of its pattern of letter classes; unknown and fixed characters stay."""
    lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
    spots = [i for i, c in enumerate(lower) if c in _CLASS and not fixed(i)]
    if not spots:
        return text
    classes = [_CLASS[lower[i]][0] for i in spots]
    rest = "".join(c for i, c in enumerate(lower) if i not in set(spots))
    new = permute(key, f"{kind}|{classes}|{rest}", [len(ALPHABETS[k]) for k in classes], [_CLASS[lower[i]][1] for i in spots])
    out = list(text)
    for i, k, v in zip(spots, classes, new, strict=True):
        c = ALPHABETS[k][v]
        out[i] = c.upper() if text[i].isupper() and len(c.upper()) == 1 else c
    return "".join(out)


def luhn(digits: str) -> bool:
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def _numeric(key: bytes, kind: str, digits: str, first: int = 0, good: Callable[[str], bool] = lambda s: True) -> str:
    """Digits after the first `first` permuted; applied again until `good`, which also holds for the input."""
    out = digits
    while True:
        new = permute(key, f"{kind}|{len(digits)}|{digits[:first]}", [10] * (len(digits) - first), [int(c) for c in out[first:]])
        out = digits[:first] + "".join(map(str, new))
        if good(out):
            return out


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _ip_class(parts: list[int]) -> str:
    a, b = parts[:2]
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "special" if a in (0, 127) or a >= 224 else "public"


def _iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _card(key: bytes, d: str) -> str:
    if not luhn(d):
        return _numeric(key, "card", d, 1, lambda s: not luhn(s))
    body = _numeric(key, "luhn", d[:-1], 1)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _ssn(key: bytes, d: str) -> str:
    valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    was = valid(d)
    return _numeric(key, "ssn", d, 0, lambda s: valid(s) == was)


def _ip(key: bytes, text: str) -> str:
    now = [int(x) for x in text.split(".")]
    kind = _ip_class(now)
    while True:
        now = permute(key, f"ip|{kind}", [256] * 4, now)
        if _ip_class(now) == kind:
            return ".".join(map(str, now))


def _iban(key: bytes, text: str) -> str:
    flat = text.replace(" ", "")
    body = _letters(key, f"iban|{flat[:2]}", flat[4:].lower()).upper()
    if not _iban_ok(flat):
        head = flat[:4]
    else:
        head = flat[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + flat[:2] + '00')) % 97:02d}"
    it = iter(head + body)
    return "".join(c if c == " " else next(it) for c in text)


def _name(key: bytes, text: str) -> str:
    words = text.split(" ")
    if words[0].rstrip(".") in TITLES:
        return " ".join([words[0], *_names(key, words[1:])])
    return " ".join(_names(key, words))


def _names(key: bytes, words: list[str]) -> list[str]:
    out = []
    for word in words:
        if word in _FIRST:
            where, i = _FIRST[word]
            out.append(GIVEN[where][permute(key, f"given|{where}", [len(GIVEN[where])], [i])[0]])
        else:
            out.append(_family(key, word))
    return out


def _tail(word: str) -> int:
    return next((len(e) for e in ENDINGS if word.lower().endswith(e) and len(word) > len(e) + 2), 0)


def _family(key: bytes, word: str) -> str:
    """A word that is no listed given name, permuted among such words of its pattern and its ending: the permutation of all
    words of the pattern is applied again until it is back among them."""
    tail, new = _tail(word), "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    while True:
        new = _letters(key, "family", new, lambda i, n=len(word), t=tail: i >= n - t)
        out = "".join(c.upper() if was.isupper() and len(c.upper()) == 1 else c for c, was in zip(new, word, strict=True))
        if out not in _FIRST and _tail(out) == tail:
            return out


def canonical(kind: str, text: str) -> str:
    """The form in which two mentions of one entity agree: letter case and punctuation don't count, nor a name's title."""
    if kind == "email":
        return text.lower()
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return digits[-10:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "name":
        words = text.split(" ")
        return " ".join(words[1:] if words[0].rstrip(".") in TITLES else words)
    return text


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one mention. Mentions with one canonical form get replacements with one canonical form."""
    if kind == "email":
        keep = text.rindex(".")
        return _letters(key, "email", text, lambda i: i >= keep)
    if kind == "phone":
        digits, own = re.sub(r"\D", "", text), canonical("phone", text)
        return _refill(text, digits[: len(digits) - len(own)] + _numeric(key, "phone", own))
    if kind == "card":
        return _refill(text, _card(key, canonical(kind, text)))
    if kind == "ssn":
        return _refill(text, _ssn(key, canonical(kind, text)))
    return {"ip": _ip, "iban": _iban, "name": _name}[kind](key, text)


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all entities in order. A family name that occurs in a name is one wherever else it stands alone."""
    if not hinted(text):
        return []
    found = [(m.lastgroup.rstrip("2"), m.start(), m.end()) for m in ENTITY.finditer(text)]
    family = {w for kind, a, b in found if kind == "name" for w in text[a:b].split(" ") if w.rstrip(".") not in TITLES and w not in _FIRST and len(w) > 2}
    if not family:
        return found
    alone, taken = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(family)))})(?!\w)"), set()
    for _, a, b in found:
        taken.update(range(a, b))
    return sorted([*found, *(("name", m.start(), m.end()) for m in alone.finditer(text) if m.start() not in taken and m.end() - 1 not in taken)], key=lambda e: e[1])


def replace(text: str, swap: Callable[[str, str], str]) -> tuple[str, list[tuple[str, int, int, int, int]]]:
    """The text with every entity swapped, and (kind, start, end, new start, new end) of each, in characters."""
    out, found, at, size = [], [], 0, 0
    for kind, start, stop in entities(text):
        new = swap(kind, text[start:stop])
        size += start - at
        out += [text[at:start], new]
        found.append((kind, start, stop, size, size + len(new)))
        at, size = stop, size + len(new)
    return ("".join([*out, text[at:]]) if out else text), found


SPANS = "array<struct<kind:string,start:int,stop:int,new_start:int,new_stop:int>>"


def session_key(spark: SparkSession) -> str:
    """The key in the setting `spark.quern.surrogate.secret` (Spark redacts settings of such names in lists); where it is unset, one is drawn for the session, so that its
    replacements agree with one another and can't be undone later."""
    name = "spark.quern.surrogate.secret"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def surrogates(docs: DataFrame, *, key: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns, `text` with surrogates for all entities, and their `spans` in the old and the new text.

    A null text stays null and has no spans; row order, repeated rows and null ids are left as they are; a text of any
    length is scanned whole; an empty table gives no rows; columns not carried are ignored. `key` decides the permutations
    and must be kept secret.
    """
    secret = hashlib.sha256(key.encode()).digest()
    rest = tuple(c for c in carry if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = lru_cache(1 << 16)(lambda kind, text: surrogate(kind, text, secret))
        kind = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in ("start", "stop", "new_start", "new_stop"))]))
        for batch in batches:
            texts, spans = [], []
            for x in batch.column(len(rest)):
                text, found = (None, []) if not x.is_valid else replace(x.as_py(), swap)
                texts.append(text)
                spans.append([dict(zip(("kind", "start", "stop", "new_start", "new_stop"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array(spans, kind)], [*rest, "text", "spans"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text string", f"spans {SPANS}"])
    return docs.select(*rest, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def collisions(docs: DataFrame, *, key: str) -> DataFrame:
    """The check over all entities of `docs`: (kind, surrogate, n_values), a row for each surrogate of several values and
    for each value that kept itself. No row means that distinctness and replacement hold. Null texts and empty tables
    have no entities; other columns are ignored."""
    secret = hashlib.sha256(key.encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, str, str]] = set()
            for x in batch.column(0):
                if x.is_valid:
                    text = x.as_py()
                    for kind, a, b in entities(text):
                        rows.add((kind, canonical(kind, text[a:b]), canonical(kind, surrogate(kind, text[a:b], secret))))
            columns = zip(*sorted(rows), strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "value", "surrogate"])

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string, surrogate string")
    count = pairs.distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_values"), F.max(F.col("value") == F.col("surrogate")).alias("same"))
    return count.where("n_values > 1 or same").select("kind", "surrogate", "n_values")


def report(docs: DataFrame, *, key: str) -> int:
    """The number of rows of `collisions`, over all documents; where there are any, a warning names them by kind."""
    found = collisions(docs, key=key).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_values") > 1).cast("int")).alias("shared")).collect()
    if found:
        kinds = ", ".join(f"{r['kind']}: {r['shared']} surrogates of several values, {r['n'] - r['shared']} values that kept themselves" for r in found)
        warnings.warn(f"surrogates are not distinct or not replaced ({kinds}); another key gives others", RuntimeWarning, stacklevel=2)
    return sum(r["n"] for r in found)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates: the new text and the number of entities by kind. Collisions are warned of."""
    docs, key = need(read(spark, sf_dir, "documents"), doc_id="long", text="string"), session_key(spark)
    report(docs, key=key)
    done = surrogates(docs, key=key)
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "phone", "card", "ip", "ssn", "iban", "name")]
    return done.select("doc_id", F.size("spans").alias("n_entities"), *count, "text")
