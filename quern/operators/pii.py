"""Detection of personal data by fourteen patterns, with false-positive rules, confidence, redaction and pseudonyms."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.operators.pieces import pieces

# The patterns of each kind, its base confidence and the words nearby that raise it.
PATTERNS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0, 0.85, ["email", "contact", "mail", "e-mail"]),
    "phone": (r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", 0, 0.7, ["phone", "tel", "call", "mobile", "cell", "fax"]),
    "ssn": (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", 0, 0.85, ["ssn", "social security", "social-security", "ss#"]),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 0, 0.9, ["card", "credit", "payment", "cc", "visa", "mastercard"]),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0, 0.7, []),
    "date_of_birth": (r"\b(?:born|dob|birth\s*date|date\s*of\s*birth|birthday)[:\s]*(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\w+\s+\d{1,2},?\s+\d{4})\b", re.I, 0.8, ["born", "birthday", "dob", "age"]),
    "name": (r"\b(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+)?(?:[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)\b", 0, 0.5, ["name", "customer", "user", "member", "subscriber"]),
    "address": (r"\b\d+\s+(?:[A-Za-z]+\s+){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Circle|Cir)\.?(?:\s*,?\s*(?:Apt|Suite|Unit|#)\s*\d+)?\b", re.I, 0.6, ["address", "location", "residence", "home", "mailing"]),
    "passport": (r"\b(?:passport\s*(?:no|number|#)?[:\s]*)?[A-Z]{1,2}\d{6,9}\b", re.I, 0.75, ["passport", "travel document"]),
    "driver_license": (r"\b(?:driver'?s?\s*(?:license|lic)\s*(?:no|number|#)?[:\s]*)?[A-Z]{0,2}\d{5,12}\b", re.I, 0.7, ["driver", "license", "dmv", "driving"]),
    "national_id": (r"\b(?:national\s*id|id\s*(?:no|number|#))[:\s]*[A-Z0-9]{6,15}\b", re.I, 0.7, []),
    "health_info": (r"\b(?:diagnosis|diagnosed|patient|medical\s*record|prescription|medication|treatment|condition|blood\s*type|allergy|allergies|disease|disorder|symptoms?|chronic|health\s*(?:condition|issue|problem))[:\s]+[A-Za-z0-9\s,.-]{3,50}\b", re.I, 0.75, ["medical", "health", "patient", "doctor", "hospital"]),
    "financial": (r"\b(?:account\s*(?:no|number|#)|routing\s*(?:no|number)|bank\s*account|iban|swift|bic)[:\s]*[A-Z0-9]{8,34}\b", re.I, 0.8, ["bank", "account", "routing", "wire", "transfer"]),
    "biometric": (r"\b(?:fingerprint|retina|iris|facial\s*recognition|voice\s*print|dna|biometric)\s*(?:id|data|scan|sample)[:\s]+[A-Za-z0-9-]{5,}\b", re.I, 0.8, []),
}
# The category of each sensitive kind, and pairs of capitalized words that are places, not names.
SENSITIVE = {"ssn": "identity", "credit_card": "financial", "health_info": "health", "biometric": "biometric", "national_id": "identity", "passport": "identity", "driver_license": "identity", "financial": "financial"}
PLACES = {"New York", "Los Angeles", "San Francisco", "San Diego", "United States", "North America", "South America"}
_COMPILED = {k: re.compile(p, f) for k, (p, f, _, _) in PATTERNS.items()}

#: What a text must hold for a kind to match at all, by its pattern: digits in a row, and one of some words (in lower case).
GUARDS: dict[str, tuple[int, tuple[str, ...]]] = {
    "email": (0, ("@",)), "phone": (4, ()), "ssn": (4, ()), "credit_card": (4, ()), "ip_address": (1, (".",)), "date_of_birth": (1, ("born", "dob", "birth")), "name": (0, ()),
    "address": (1, ("st", "ave", "road", "rd", "boulevard", "blvd", "dr", "lane", "ln", "way", "c")), "passport": (6, ()), "driver_license": (5, ()), "national_id": (0, ("id",)),
    "health_info": (0, ("diagnos", "patient", "medical", "prescription", "medication", "treatment", "condition", "blood", "allerg", "disease", "disorder", "symptom", "chronic", "health")),
    "financial": (0, ("account", "routing", "iban", "swift", "bic")), "biometric": (0, ("fingerprint", "retina", "iris", "facial", "voice", "dna", "biometric")),
}


def luhn(number: str) -> bool:
    d = [int(c) for c in number if c.isdigit()]
    if not 13 <= len(d) <= 19:
        return False
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


@dataclass(frozen=True)
class Found:
    """A match in its text."""

    value: str
    text: str
    start: int
    end: int

    @property
    def digits(self) -> str:
        return "".join(c for c in self.value if c.isdigit())

    def before(self, n: int) -> str:
        return self.text[max(0, self.start - n) : self.start].lower()

    def around(self, n: int) -> str:
        return self.text[max(0, self.start - n) : self.end + n].lower()


# Forms that look like a phone number and aren't one, words before versions, and areas that no SSN has.
NOT_PHONES = re.compile(r"\d{4}[-/]\d{2}[-/]\d{2}|\d+\.\d+\.\d+")
VERSIONS = re.compile(r"version|v\d|\.jar|\.dll")
NO_AREAS = ("000", "666", *map(str, range(900, 1000)))
#: The rule of each kind that has one; a match must pass it.
RULES: dict[str, Callable[[Found], bool]] = {
    "phone": lambda m: len(m.digits) >= 7 and not NOT_PHONES.fullmatch(m.value),
    "ip_address": lambda m: max(map(int, m.value.split("."))) < 256 and not VERSIONS.search(m.before(20)),
    "ssn": lambda m: len(m.digits) == 9 and not m.digits.startswith(NO_AREAS),
    "credit_card": lambda m: luhn(m.value),
    "name": lambda m: m.value not in PLACES,
    "address": lambda m: len(m.value) >= 15,
    "driver_license": lambda m: any(w in m.around(50) for w in ("license", "driver")),
    "passport": lambda m: "passport" in m.around(50),
}


def possible(text: str, kinds: tuple[str, ...]) -> list[str]:
    """The kinds that a text can hold by their guards."""
    run, low = max(map(len, re.findall(r"\d+", text)), default=0), text.lower()
    return [k for k in kinds if run >= GUARDS[k][0] and (not GUARDS[k][1] or any(w in low for w in GUARDS[k][1]))]


def detect(text: str, kinds: tuple[str, ...] = tuple(PATTERNS), least: float = 0.5, window: int = 30) -> list[tuple[str, str, int, int, float]]:
    """(kind, value, start, end, confidence) of all matches, by kind and place; a word nearby raises confidence once."""
    out = []
    for kind in possible(text, kinds):
        _, _, base, words = PATTERNS[kind]
        for m in _COMPILED[kind].finditer(text):
            if kind not in RULES or RULES[kind](Found(m[0], text, m.start(), m.end())):
                near = text[max(0, m.start() - window) : m.end() + window].lower()
                confidence = min(1.0, base + 0.15) if any(w in near for w in words) else base
                if confidence >= least:
                    out.append((kind, m[0], m.start(), m.end(), round(confidence, 6)))
    return out


def replace(text: str, found: list[tuple[str, str, int, int, float]], how: str, salt: str = "", merge: bool = False) -> str:
    """Matches redacted or replaced by pseudonyms, from the right by their places in the input; with `merge`, matches that
    overlap an earlier one are left out, else overlaps are replaced one after another."""
    kept: list = []
    for m in sorted(found, key=lambda m: (m[2], -m[3])):
        if not merge or not kept or m[2] >= kept[-1][3]:
            kept.append(m)
    for kind, value, start, end, _ in sorted(kept, key=lambda m: -m[2]):
        mark = f"[REDACTED:{kind}]" if how == "redact" else f"[{kind}:{hashlib.sha256(f'{salt}:{kind}:{value}'.encode()).hexdigest()[:8]}]"
        text = text[:start] + mark + text[end:]
    return text


def matches(docs: DataFrame, key: str = "doc_id", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """One row per match: key, pii_type, value, start, end, confidence, category."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            rows = [(i, *m, SENSITIVE.get(m[0])) for i, t in zip(b[key], b["text"], strict=True) for m in detect(t or "", kinds)]
            yield pd.DataFrame(rows, columns=[key, "pii_type", "value", "start", "end", "confidence", "category"])

    return docs.select(key, "text").mapInPandas(run, f"{key} long, pii_type string, value string, start int, end int, confidence double, category string")


def processed(docs: DataFrame, how: str, key: str = "doc_id", kinds: tuple[str, ...] = tuple(PATTERNS), salt: str | None = None, merge: bool = False, alert_on_sensitive: bool = True) -> DataFrame:
    """key, text, n_matches, categories and `excluded`. `how`: redact, pseudonymize, flag (text as it is) or exclude. A page
    with sensitive categories is excluded if alerts are on, also when its text is redacted. Pseudonyms need a `salt`, which
    must be kept secret: values can be guessed by whoever knows it."""
    if how == "pseudonymize" and not salt:
        raise ValueError("pseudonyms need a salt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            rows = []
            for i, t in zip(b[key], b["text"], strict=True):
                found = detect(t or "", kinds)
                categories = sorted({SENSITIVE[m[0]] for m in found if m[0] in SENSITIVE})
                new = replace(t, found, how, salt, merge) if t and how in ("redact", "pseudonymize") else t
                rows.append((i, new, len(found), categories, bool((how == "exclude" and found) or (alert_on_sensitive and categories))))
            yield pd.DataFrame(rows, columns=[key, "text", "n_matches", "categories", "excluded"])

    return docs.select(key, "text").mapInPandas(run, f"{key} long, text string, n_matches int, categories array<string>, excluded boolean")


# Java's \b and \s are others than SQL engines' (RE2's), and \b is another in each version of Java: words and white space in ASCII.
_NATIVE = {r"\b": "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", r"\s": r"[\t\n\f\r ]"}


def native(kind: str) -> str:
    """A kind's pattern for Spark's regular expressions, with the words and white space of ASCII."""
    p, flags = PATTERNS[kind][:2]
    for mark, form in _NATIVE.items():
        p = p.replace(mark, form)
    return ("(?i)" if flags else "") + p


def counts(docs: DataFrame, key: str = "doc_id", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Raw matches of each kind, as native expressions with the words of ASCII (unlike `detect`); a pattern runs only over texts
    that pass its guard."""
    low = F.lower("text")

    def count(k: str) -> Column:
        digits, words = GUARDS[k]
        guard = F.col("text").rlike(rf"\d{{{digits}}}") if digits else F.lit(True)
        if words:
            some = F.lit(False)
            for w in words:
                some = some | F.contains(low, F.lit(w))
            guard = guard & some
        found = F.regexp_count("text", F.lit(native(k)))
        return F.when(guard, found).when(F.col("text").isNotNull(), F.lit(0)).alias(k)

    return docs.select(key, *[count(k) for k in kinds])
