"""Personal data replaced by format-preserving pseudonyms.

Validated values are permuted within their own format by a keyed Feistel network, so that equal
values get equal pseudonyms in every document, different ones never collide, and the pseudonym
passes the same validation. A value is read as a number in mixed radix (the digits, letters or octets
that may vary; all else stays), split into two halves that are added to in turn a keyed hash of the
other; results outside the format (a day that doesn't exist, a reserved address) are permuted again
until they are inside, which keeps the map one-to-one.

Kinds: payment card numbers (13 to 19 digits with a valid check digit, which is recomputed), IBANs (check
digits recomputed), IPv4 addresses, phone numbers with a country code or in US form, US social security numbers,
dates from 1900 to 2099 (year, month, day or day, month, year with dashes, dots or slashes between, and
month, day, year where the day is over 12), e-mail addresses, and secrets after a key word, whatever
stands before it. Numbers that fail their validation are left alone.

Each text is worked on by itself, in any order and any number of times with the same result, so
nothing is shuffled and a lost executor costs its tasks only.

Defined results: a null text stays null with no values, an empty one is unchanged; repeated rows get
equal results; other columns pass through, those named like an output are replaced; an empty table
stays empty. Values that overlap are taken from left to right, by the order of the kinds at one place.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import map_arrow
from .bpe import pieces, schema_with, with_column

ROUNDS = 10
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def feistel(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """Permutation of range(left * right)."""
    a, b = divmod(value, right)
    for r in range(ROUNDS):
        other = b if r % 2 == 0 else a
        mac = hmac.digest(key, f"{tweak}|{r}|{other}".encode(), hashlib.sha256)
        if r % 2 == 0:
            a = (a + int.from_bytes(mac, "big")) % left
        else:
            b = (b + int.from_bytes(mac, "big")) % right
    return a * right + b


def permute(digits: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """The same permutation on a number in mixed radix."""
    half = len(digits) // 2
    left = right = 1
    value = 0
    for i, (d, r) in enumerate(zip(digits, radices)):
        value = value * r + d
        if i < half:
            left *= r
        else:
            right *= r
    value = feistel(value, left, right, key, tweak)
    out = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def walk(digits: list[int], radices: list[int], key: bytes, tweak: str, valid: Callable[[list[int]], bool]) -> list[int]:
    """Permute until the result is valid; one-to-one on the valid values."""
    while True:
        digits = permute(digits, radices, key, tweak)
        if valid(digits):
            return digits


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: alphabet for alphabet in _ALPHABETS for c in alphabet}


def permute_text(text: str, key: bytes, kind: str, alphabets: dict[str, str] | None = None) -> str:
    """Letters and digits permuted within their class; everything else stays in place."""
    classes = [(alphabets or _CLASS).get(c) for c in text]
    at = [i for i, a in enumerate(classes) if a]
    shape = "".join("x" if a else c for c, a in zip(text, classes))
    digits = [classes[i].index(text[i]) for i in at]
    fresh = permute(digits, [len(classes[i]) for i in at], key, f"{kind}|{shape}|{'.'.join(str(len(classes[i])) for i in at)}")
    out = list(text)
    for i, d in zip(at, fresh):
        out[i] = classes[i][d]
    return "".join(out)


def with_digits(text: str, digits: list[int]) -> str:
    """``text`` with its digits replaced in order."""
    fresh = iter(digits)
    return "".join(str(next(fresh)) if "0" <= c <= "9" else c for c in text)


def luhn(digits: list[int]) -> int:
    """Remainder of the check sum: 0 for valid numbers."""
    return (sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])) % 10


def card(text: str, key: bytes) -> str | None:
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19 or luhn(digits) or not any(digits):
        return None
    body = walk(digits[:-1], [10] * (len(digits) - 1), key, f"card|{len(digits)}", any)
    return with_digits(text, [*body, -luhn([*body, 0]) % 10])


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_number(plain) % 97 != 1:
        return None
    body = permute_text(plain[4:], key, f"iban|{plain[:2]}")
    check = 98 - iban_number(plain[:2] + "00" + body) % 97
    fresh = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(fresh) for c in text)


def reserved(octets: list[int]) -> bool:
    return octets[0] in (0, 10, 127) or octets[0] >= 224 or octets[:2] in ([192, 168], [169, 254]) or (octets[0] == 172 and 16 <= octets[1] < 32)


def address(text: str, key: bytes) -> str | None:
    """Public addresses stay public, reserved ones stay reserved; octets keep their number of digits."""
    octets = [int(p) for p in text.split(".")]
    if any(o > 255 or str(o) != p for o, p in zip(octets, text.split("."))):
        return None
    kind = reserved(octets)
    return ".".join(map(str, walk(octets, [256] * 4, key, "ipv4", lambda o: reserved(o) == kind)))


def phone(text: str, key: bytes) -> str | None:
    """The country code stays."""
    code = re.match(r"(?:\+1|\+\d{1,3})?", text).group()
    rest = text[len(code) :]
    digits = [int(c) for c in rest if c.isdigit()]
    return code + with_digits(rest, permute(digits, [10] * len(digits), key, f"phone|{code}|{len(digits)}"))


def social_security(text: str, key: bytes) -> str | None:
    def valid(d: list[int]) -> bool:
        area, group, serial = d[0] * 100 + d[1] * 10 + d[2], d[3] * 10 + d[4], d[5:]
        return 0 < area < 900 and area != 666 and group > 0 and any(serial)

    digits = [int(c) for c in text if c.isdigit()]
    return with_digits(text, walk(digits, [10] * 9, key, "ssn", valid)) if valid(digits) else None


def day(text: str, key: bytes) -> str | None:
    """Year-first and day-first dates, and month-first ones that are no day-first date; the order, the
    separators and the leading zeros' widths stay."""
    parts = re.split(r"[-./]", text)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]  # places of year, month and day
    for order in orders:
        try:
            found = date(*(int(parts[k]) for k in order))
            break
        except ValueError:
            continue
    else:
        return None
    days = (_LAST_DAY - _FIRST_DAY).days + 1
    if not _FIRST_DAY <= found <= _LAST_DAY:
        return None
    month, of_month = (len(parts[k]) for k in order[1:])
    short, american = min(month, of_month) < 2, order == (2, 0, 1)

    def valid(d: list[int]) -> bool:
        at = d[0] * 300 + d[1]
        if at >= days:
            return False
        fresh = _FIRST_DAY + timedelta(at)
        fits = not short or len(str(fresh.day)) == of_month and len(str(fresh.month)) == month
        return fits and (not american or fresh.day > 12)

    tweak = ("day|us" if american else "day") + (f"|{of_month}{month}" if short else "")
    at = walk(list(divmod((found - _FIRST_DAY).days, 300)), [days // 300 + 1, 300], key, tweak, valid)
    fresh = _FIRST_DAY + timedelta(at[0] * 300 + at[1])
    values = dict(zip(order, (fresh.year, fresh.month, fresh.day)))
    marks = re.findall(r"[-./]", text)
    out = [f"{values[k]:0{len(p)}d}" for k, p in enumerate(parts)]
    return out[0] + marks[0] + out[1] + marks[1] + out[2]


def email(text: str, key: bytes) -> str | None:
    """Letters and digits of the name and of the domain; the top-level domain stays."""
    name, _, host = text.rpartition("@")
    host, dot, top = host.rpartition(".")
    return permute_text(name, key, "email") + "@" + permute_text(host, key, "host") + dot + top



def secret(text: str, key: bytes) -> str | None:
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF"):
        if all(c in alphabet for c in text):
            return permute_text(text, key, "hex", dict.fromkeys(alphabet, alphabet))
    return permute_text(text, key, "secret")


#: Kind, pattern of the value (its group 1 if it has one), and the validating permutation.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("secret", r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\"?\s*[=:]\s*[\"']?((?=[A-Za-z0-9+/_.\-]{16})[A-Za-z0-9+/_\-]+(?:\.[A-Za-z0-9+/_\-]+)*)", secret),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", email),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("phone", r"\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|\+(?!1[ .\-(])\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?![ .\-]?\d)"
     r"|(?<![\d+(.\-])(?<!\d )\(?\d{3}\)?[ .\-]\d{3}(?:[.\-]\d{4}(?![\d\-])| \d{4}(?![ .\-]?\d))", phone),
    ("date", r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\1\d{4}|(?<!\d-)(?:\d{4}([-./])\d{1,2}\2\d{1,2}|\d{1,2}-\d{1,2}-\d{4})(?!-\d))(?!\.?\d)", day),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", social_security),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    ("card", r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])", card),
]
_TRIGGER = re.compile(r"\d|@|(?i:token|secret|passw|key)")
_ASCII = [(kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind == "secret" else 0)), fix) for kind, pattern, fix in KINDS]


def single_cards(text: str, start: int, end: int, key: bytes):
    """Valid numbers among those that a run of digit groups holds, from left to right, the longest first."""
    groups = [(m.start() + start, m.end() + start) for m in re.finditer(r"\d+", text[start:end])]
    i = 0
    while i < len(groups):
        for j in range(len(groups), i, -1):
            fresh = card(text[groups[i][0] : groups[j - 1][1]], key)
            if fresh is not None:
                yield groups[i][0], groups[j - 1][1], fresh
                i = j - 1
                break
        i += 1


def values(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a text, in order and without overlap."""
    if not _TRIGGER.search(text):
        return []
    found = []
    for order, (kind, pattern, fix) in enumerate(_ASCII):
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            group = 1 if kind == "secret" else 0
            if kind == "card":
                found.extend((a, order, b, kind, fresh) for a, b, fresh in single_cards(text, m.start(), m.end(), key))
                continue
            fresh = fix(m.group(group), key)
            if fresh is not None:
                found.append((m.start(group), order, m.end(group), kind, fresh))
    out, done = [], 0
    for start, _, end, kind, fresh in sorted(found):
        if start >= done:
            out.append((start, end, kind, fresh))
            done = end
    return out


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The text with pseudonyms, and (kind, pseudonym) in order."""
    parts, done, listed = [], 0, []
    for start, end, kind, fresh in values(text, key):
        parts += [text[done:start], fresh]
        done = end
        listed.append((kind, fresh))
    return ("".join([*parts, text[done:]]) if parts else text), listed


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and the array ``found`` of kinds and pseudonyms."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, text) if whole.num_rows else ():
                column = batch.column(batch.schema.get_field_index(text)).to_pylist()
                done = [(None, []) if t is None else pseudonymised(t, key) for t in column]
                out = with_column(batch, text, pa.array([t for t, _ in done], pa.string()))
                listed = [[{"kind": k, "value": v} for k, v in x] for _, x in done]
                yield with_column(out, found, pa.array(listed, _ARROW))

    return map_arrow(docs, run, schema_with(docs.schema, found, FOUND))
