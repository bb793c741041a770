"""Format-preserving pseudonyms for personal numbers, addresses and dates.

A value that passes its format's own check (Luhn, mod 97, octets, calendar) is read as an integer of the
format's domain, permuted by a keyed Feistel network with cycle walking, and written back in the same
format. Equal values get equal pseudonyms everywhere, so documents stay linked; different values never
share one, because a permutation has no collisions.

Formats: e-mail addresses, IPv4 addresses, card numbers (Luhn), phone numbers (international ones keep their calling code, however they are
spaced), SSN, IBAN (mod 97), dates as 2020-01-31 and with day, month and year apart by ``.``, ``/`` or ``-``. Others, such as IPv6 addresses or
dates as 2020/01/31, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import lean_batches, need, own_name

ROUNDS = 8
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "date")
#: For trials only; a deployment hands in its own secret.
TRIAL_KEY = b"cargolens trial key"
DATES_FROM, DATES_UPTO = date(1900, 1, 1), date(2099, 12, 31)

_EDGE, _END = r"(?<![\w.+-])", r"(?!\w|[.-]\w)"
_NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    rf"|(?P<date>{_EDGE}(?:\d{{4}}-\d\d-\d\d|\d{{1,2}}(?P<sep>[./-])\d{{1,2}}(?P=sep)\d{{4}})(?!\w|[./-]\d))"
    rf"|(?P<ssn>{_EDGE}\d{{3}}-\d\d-\d{{4}}(?!\w|-\w))"
    r"|(?P<card>(?<!\w)(?:\d{13,19}|\d{4}(?P<four>[ -])\d{4}(?P=four)\d{4}(?P=four)\d{4}|\d{4}(?P<six>[ -])\d{6}(?P=six)\d{5})(?!\w))"
    r"|(?P<phone>(?<!\w)\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w|\.\d)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}(?P<three>[.-])\d{3}(?P=three)\d{4}(?!\w|[.-]\w))")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
# Calling codes of two digits. Those that begin with 1 or 7 have one digit, all others three.
_TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_DIGIT = re.compile(r"[0-9]")


class Permutation:
    """Keyed permutations of 0 .. size-1, one for each kind and size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.of = lru_cache(maxsize=4096)(self._of)

    def _of(self, kind: str, x: int, size: int) -> int:
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        tweak = f"{kind}:{size}".encode()
        while True:
            a, b = x >> half, x & mask
            for r in range(ROUNDS):
                h = hashlib.blake2b(tweak + bytes([r]) + b.to_bytes(width, "big"), key=self.key, digest_size=64)
                a, b = b, a ^ (int.from_bytes(h.digest(), "big") & mask)
            x = (a << half) | b
            if x < size:
                return x


def luhn_digit(digits: str) -> str:
    """The digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country) + "00") % 97


def _fill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _scramble(p: Permutation, kind: str, value: str) -> str:
    """Letters become letters of the same case, digits digits; the rest stays."""
    x, size = 0, 1
    for c in value:
        if c.isalnum():
            base = 10 if c.isdigit() else 26
            x, size = x * base + (int(c) if c.isdigit() else ord(c.lower()) - 97), size * base
    x = p.of(kind + ":" + "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in value), x, size)
    out = []
    for c in reversed(value):
        if c.isalnum():
            x, d = divmod(x, 10 if c.isdigit() else 26)
            c = str(d) if c.isdigit() else chr(d + (65 if c.isupper() else 97))
        out.append(c)
    return "".join(reversed(out))


def _email(p: Permutation, value: str) -> str:
    local, domain = value.rsplit("@", 1)
    labels, top = domain.rsplit(".", 1)
    return f"{_scramble(p, 'local', local)}@{_scramble(p, 'domain', labels)}.{top}"


def _ip(p: Permutation, value: str) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    x = p.of("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _card(p: Permutation, value: str) -> str | None:
    digits = "".join(c for c in value if c.isdigit())
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    body = str(p.of("card", int(digits[:-1]), 10 ** n)).zfill(n)
    return _fill(value, body + luhn_digit(body))


def _country_digits(digits: str) -> int:
    """Length of the calling code that an international number begins with; no code begins another."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGIT_CODES else 3


def _phone(p: Permutation, value: str) -> str | None:
    digits = "".join(c for c in value if c.isdigit())
    if not 8 <= len(digits) <= 15:
        return None
    kept = _country_digits(digits) if value[0] == "+" else 0  # the calling code stays, however the number is written
    places = [i for i, c in enumerate(value) if c.isdigit()]
    keep, body = places[kept], digits[kept:]
    return value[:keep] + _fill(value[keep:], str(p.of("phone", int(body), 10 ** len(body))).zfill(len(body)))


def _ssn(p: Permutation, value: str) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = area - 1 - (area > 666)
    x = p.of("ssn", (areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    x, serial = divmod(x, 9999)
    areas, group = divmod(x, 99)
    return f"{areas + 1 + (areas >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(p: Permutation, value: str) -> str | None:
    plain = value.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != int(check):
        return None
    rest = _scramble(p, "iban" + country, rest)
    return _fill(value, f"{country}{_iban_check(country, rest):02d}{rest}")


def _day(value: str) -> tuple[date, Callable[[date], str]] | None:
    if value[4] == "-" and value[:4].isdigit():
        order, sep, parts = "ymd", "-", value.split("-")
    else:
        sep = next(c for c in value if not c.isdigit())
        parts = value.split(sep)
        order = "mdy" if sep == "/" and 1 <= int(parts[0]) <= 12 else "dmy"
    by = dict(zip(order, map(int, parts)))
    try:
        day = date(by["y"], by["m"], by["d"])
    except ValueError:
        return None
    if not DATES_FROM <= day <= DATES_UPTO:
        return None
    bare = any(len(x) == 1 for x in parts)

    def write(d: date) -> str:
        new = {"y": f"{d.year:04d}", "m": str(d.month) if bare else f"{d.month:02d}", "d": str(d.day) if bare else f"{d.day:02d}"}
        return sep.join(new[k] for k in order)

    return day, write


def _date(p: Permutation, value: str) -> str | None:
    found = _day(value)
    if found is None:
        return None
    x = p.of("date", (found[0] - DATES_FROM).days, (DATES_UPTO - DATES_FROM).days + 1)
    return found[1](DATES_FROM + timedelta(days=x))


_WRITE = {"ip": _ip, "card": _card, "phone": _phone, "ssn": _ssn, "date": _date}


def find(text: str, p: Permutation) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every valid value, in order and without overlaps."""
    found = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start < at and text[start] in ".%+-":
            start += 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and start < at:
            found.append((start, domain.end(), "email", _email(p, text[start:domain.end()])))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            kind = next(k for k in _WRITE if m[k])
            new = _WRITE[kind](p, m[0])
            if new is not None:
                found.append((m.start(), m.end(), kind, new))
        for m in _IBAN.finditer(text):
            new = _iban(p, m[0])
            if new is not None:
                found.append((m.start(), m.end(), "iban", new))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, upto = [], 0
    for span in found:
        if span[0] >= upto:
            out.append(span)
            upto = span[1]
    return out


def pseudonymise(text: str, p: Permutation) -> tuple[str, dict[str, int]]:
    out, upto, seen = [], 0, {}
    for start, end, kind, new in find(text, p):
        out += [text[upto:start], new]
        upto = end
        seen[kind] = seen.get(kind, 0) + 1
    return ("".join([*out, text[upto:]]) if out else text), seen


def pseudonym_column(column: Column, key: bytes) -> Column:
    """struct(text, count per kind) of a text column; null stays null with counts of 0."""

    @F.arrow_udf("text string, " + ", ".join(f"{k} int" for k in KINDS))
    def apply(values: pa.Array) -> pa.Array:
        p = Permutation(key)
        texts, counts = [], {k: [] for k in KINDS}
        for t in values.to_pylist():
            new, seen = pseudonymise(t, p) if t else (t, {})
            texts.append(new)
            for k in KINDS:
                counts[k].append(seen.get(k, 0))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int32()) for k in KINDS]],
                                          names=["text", *KINDS])

    return apply(column)


def mask(docs: DataFrame, key: bytes = TRIAL_KEY, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and pii_<kind> and pii_total counts per row.

    Numbers that fail their check, and all other characters, stay as they are. Null and empty texts stay
    so. Input columns named like a count are replaced; ``counts=False`` adds none. Every row is handled alone, so repeated rows agree.
    """
    need(docs, text)
    lean_batches(docs.sparkSession)
    made = own_name(docs, "_made")
    out = docs.withColumn(made, pseudonym_column(F.col(text).cast("string"), key)).withColumn(text, F.col(f"{made}.text"))
    if counts:
        out = out.withColumns({f"pii_{k}": F.col(f"{made}.{k}") for k in KINDS})
        out = out.withColumn("pii_total", sum((F.col(f"pii_{k}") for k in KINDS[1:]), F.col(f"pii_{KINDS[0]}")))
    return out.drop(made)
