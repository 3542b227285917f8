"""Operator 13: personal data found by pattern, checksum and context.

1. Proposals. Four base patterns (``email``, ``ip``, ``card``, ``phone``) are
   taken leftmost and without overlaps per kind; a match whose parts or digits
   fail its test is dropped. Further rules propose what the base patterns miss:
   cards and phone numbers that ran into other digits, cards with other
   separators, short cards, national phone numbers, IPv6 and defanged addresses,
   addresses written with (at) and (dot), ``iban`` and ``id`` (social security
   and tax numbers of four countries).
2. Confirmation. Luhn for cards, modulo 97 for bank accounts and French ids,
   modulo 23 for Spanish ones, ISO 7064 for German ones, number ranges for the
   rest. A proposal that fails is dropped.
3. Context. A proposal has its rule's score; words that name its kind within
   ``BEFORE`` characters before or ``AFTER`` behind it add ``CONTEXT`` to it,
   words that name other numbers (orders, versions) take it off. Proposals of
   ``MIN_SCORE`` or more are kept where no base match lies, the better of two
   that overlap; base matches always stay, their score only tells how sure they
   are.

Texts are independent rows of an Arrow map with small Python helpers; every
pattern takes time in proportion to the text, also for texts that are one word
or one number.

Defined results: places are code points, ends exclusive; a null or empty text
has no spans; repeated rows and equal ids are judged alike; an empty table gives
an empty result; other columns pass by unread, whatever their names: a result
column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from cartwheel.llm.common import free_name

#: Kinds in the order in which spans are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "id")
BASE_KINDS = KINDS[:4]
MIN_SCORE, CONTEXT = 0.5, 0.3
BEFORE, AFTER = 48, 24

SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
                   StructField("score", DoubleType()), StructField("base", BooleanType())])
SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

# --- checks -----------------------------------------------------------------


def digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(number: str) -> bool:
    return sum(int(c) if k % 2 == 0 else _DOUBLED[int(c)] for k, c in enumerate(reversed(number))) % 10 == 0


def mod97(account: str) -> bool:
    """Bank account: the first four characters go to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def french_key(number: str) -> bool:
    return 97 - int(number[:13]) % 97 == int(number[13:])


def spanish_letter(number: str) -> bool:
    plain = str("XYZ".find(number[0])) + number[1:-1] if number[0] in "XYZ" else number[:-1]
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(plain) % 23] == number[-1]


def iso7064(number: str) -> bool:
    """ISO 7064 modulo 11, 10 over all but the last digit."""
    product = 10
    for c in number[:-1]:
        total = (int(c) + product) % 10 or 10
        product = 2 * total % 11
    return (11 - product) % 10 == int(number[-1])


# --- base patterns ----------------------------------------------------------

# The contract's patterns, written so that no text takes quadratic time: a
# digit that follows a digit begins no address, and what stands before an @ is
# taken back from there.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def byte_parts(address: str) -> bool:
    # leading zeros are part of the pattern and do not change the number
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in base_emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if byte_parts(m.group())]
    for m in CARD.finditer(text):
        number = digits(m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


# --- the method's own rules -------------------------------------------------


class Rule(NamedTuple):
    kind: str
    score: float
    pattern: re.Pattern
    check: object  # of the match's text


def _card(low: int, high: int):
    return lambda s: low <= len(digits(s)) <= high and luhn(digits(s))


def _phone(s: str) -> bool:
    return 8 <= len(digits(s)) <= 15


def _ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return len([p for p in s.split(":") if p]) >= 3 and bool(digits(s))


_SEP = r"[ .\u00a0\u2009\u202f\u2010-\u2013/-]"

RULES = (
    # cards that ran into other digits, or whose groups have other separators
    Rule("card", 0.7, re.compile(r"(?<![0-9])[0-9]{16,19}(?![0-9])"), _card(16, 19)),
    Rule("card", 0.7, re.compile(rf"(?<![0-9])[0-9]{{4}}({_SEP})[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}(?:\1[0-9]{{3}})?(?![0-9])"), _card(16, 19)),
    Rule("card", 0.7, re.compile(rf"(?<![0-9])[0-9]{{4}}({_SEP})[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}(?![0-9])"), _card(16, 16)),
    # cards of 13 to 15 digits, of issuers that have such
    Rule("card", 0.4, re.compile(rf"(?<![0-9])3[47][0-9]{{2}}({_SEP}?)[0-9]{{6}}\1[0-9]{{5}}(?![0-9])"), _card(15, 15)),
    Rule("card", 0.3, re.compile(r"(?<![0-9])(?:4[0-9]{12}|3[0689][0-9]{12})(?![0-9])"), _card(13, 14)),
    # international numbers group by group, where the base pattern ran on
    Rule("phone", 0.6, re.compile(r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"), _phone),
    Rule("phone", 0.4, re.compile(r"(?<![0-9.+-])00[1-9][0-9]{0,2}[ .-](?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])"), _phone),
    Rule("phone", 0.5, re.compile(r"(?<![0-9+)])(?<!\+[0-9] )\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"), _phone),
    Rule("phone", 0.3, re.compile(r"(?<![0-9.+-])(?:\(0?[0-9]{2,4}\)|0?[0-9]{2,4})[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9.])"), _phone),
    Rule("ip", 0.6, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"), _ipv6),
    Rule("ip", 0.6, re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])"), lambda s: all(int(p) <= 255 for p in re.findall("[0-9]+", s))),
    Rule("id", 0.5, re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"), lambda s: True),
    Rule("id", 0.7, re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])"), lambda s: french_key(digits(s))),
    Rule("id", 0.5, re.compile(r"(?<![A-Za-z0-9])(?:[XYZ][0-9]{7}|[0-9]{8})-?[A-Z](?![A-Za-z0-9])"), lambda s: spanish_letter(s.replace("-", ""))),
    Rule("id", 0.3, re.compile(r"(?<![0-9])[1-9][0-9]{10}(?![0-9])"), iso7064),
)
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7}
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
AT_SIGN = re.compile(r" ?[(\[{] ?at ?[)\]}] ?", re.I)
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]+)+", re.I)

#: Words of the test languages that name a kind, or numbers that are none.
NAMES = {
    "email": "email e-mail mail mailto contact kontakt correo courriel",
    "ip": "ip ipv4 ipv6 address host server client addr adresse dirección",
    "card": "card visa mastercard amex credit debit payment cc karte kreditkarte tarjeta carte",
    "phone": "phone tel telephone call mobile cell fax telefon handy teléfono móvil téléphone portable",
    "iban": "iban bank account konto kontonummer cuenta compte",
    "id": "ssn social security id tax identity steuer-id steuernummer dni nie nif sécu sécurité nir passport",
}
OTHER_NUMBERS = "isbn issn order invoice version serial sku tracking bestellnummer rechnung pedido factura commande facture"
_WORD = re.compile(r"[^\W\d_](?:[\w-]*[^\W_])?")
_NAMES = {kind: frozenset(words.split()) for kind, words in NAMES.items()}
_OTHER = frozenset(OTHER_NUMBERS.split())
#: A text without these has neither base matches nor proposals.
HINT = re.compile(r"[0-9]|@|[(\[{] ?at ?[)\]}]", re.I)


def iban_spans(text: str) -> Iterator[tuple[int, int]]:
    """Accounts, cut back group by group until modulo 97 agrees."""
    for m in IBAN.finditer(text):
        start, end = m.span()
        while end - start >= 15:
            account = re.sub("[ -]", "", text[start:end])
            if 15 <= len(account) <= 34 and mod97(account):
                yield start, end
                break
            cut = max(text.rfind(" ", start, end), text.rfind("-", start, end))
            end = cut if cut > start else start


def written_emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in AT_SIGN.finditer(text):
        start = done + len(text[done:m.start()].rstrip(LOCAL))
        domain = WRITTEN_DOMAIN.match(text, m.end()) if start < m.start() else None
        done = max(done, domain.end() if domain else m.end())
        if domain:
            yield start, domain.end()


def proposals(text: str) -> Iterator[tuple[str, int, int, float]]:
    for rule in RULES:
        for m in rule.pattern.finditer(text):
            if rule.check(m.group()):
                yield rule.kind, *m.span(), rule.score
    for start, end in iban_spans(text):
        yield "iban", start, end, 0.8
    for start, end in written_emails(text):
        yield "email", start, end, 0.6


def in_context(text: str, kind: str, start: int, end: int, score: float) -> float:
    """The score raised or lowered by the words around a proposal."""
    near = _WORD.findall(text[max(0, start - BEFORE):start].lower()) + _WORD.findall(text[end:end + AFTER].lower())
    if not _NAMES[kind].isdisjoint(near):
        score += CONTEXT
    if not _OTHER.isdisjoint(near):
        score -= CONTEXT
    return round(min(1.0, max(0.0, score)), 3)


def spans_of(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a text, by kind and start."""
    if not text or not HINT.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, b, in_context(text, k, a, b, BASE_SCORE[k]), True) for k, a, b in base]
    found = [(k, a, b, in_context(text, k, a, b, s)) for k, a, b, s in proposals(text)]
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    # the best score first, then the longest, the leftmost, the kind listed first
    for k, a, b, score in sorted(found, key=lambda x: (-x[3], x[1] - x[2], x[1], KINDS.index(x[0]))):
        if score >= min_score and 1 not in taken[a:b]:
            out.append((k, a, b, score, False))
            taken[a:b] = b"\1" * (b - a)
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def redact(text: str | None, spans: list[tuple]) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_personal_data(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents' columns, ``spans`` (kind, start, end, score, base; by kind
    in the order of ``KINDS``, then start) and ``redacted``, the text with its
    spans replaced by their kinds."""
    columns = docs.columns
    at = [c.lower() for c in columns].index("text")
    names = [*columns]
    names.append(free_name(names, "spans"))
    names.append(free_name(names, "redacted"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = [spans_of(t, min_score) for t in texts]
            listed = [[dict(zip(SPAN.names, s)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(listed, pa.list_(SPAN_ARROW)), pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string())], names=names)

    schema = StructType([*docs.schema.fields, StructField(names[-2], ArrayType(SPAN)), StructField(names[-1], StringType())])
    return docs.mapInArrow(find, schema)
