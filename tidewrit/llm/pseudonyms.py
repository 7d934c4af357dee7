"""Pseudonyms of personal information (problem 4).

Numbers and dates are permuted within their format by a keyed Feistel network, so that equal values get equal
pseudonyms in all documents and different values different ones. What makes a value valid stays: check digits are
computed anew, dates are permuted by their rank among the days, phone numbers keep their country and trunk prefix, so
that one number with either is linked. Other pieces get a keyed digest of 128 bits of their canonical value.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

#: Country codes of telephone numbers that have one or two digits; all others have three.
SHORT_COUNTRY_CODES = {*"1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
ROUNDS = 10
#: Years that share one permutation of their days.
YEARS = 200
_DATE = re.compile(r"(\d+)(\D)(\d+)\D(\d{4})")


def eleven_proof(digits: str) -> bool:
    """The check of nine-digit national numbers: weights 9 to 2 and -1 give a multiple of 11."""
    return len(digits) == 9 and digits.isascii() and sum(int(d) * w for d, w in zip(digits, [9, 8, 7, 6, 5, 4, 3, 2, -1])) % 11 == 0


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def iban_valid(value: str) -> bool:
    return _iban_rest(re.sub(r"[ -]", "", value).upper()) == 1


def feistel(digits: str, key: bytes, tweak: str, back: bool = False) -> str:
    """A keyed permutation of the digit strings of one length: ten rounds over two halves."""
    n = len(digits)
    if not n:
        return digits
    if n < 2:
        shift = hashlib.blake2b(tweak.encode(), key=key, digest_size=2).digest()[0] % 10
        return "".join(str((int(d) + (-shift if back else shift)) % 10) for d in digits)
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    size = (10**u, 10 ** (n - u))
    rounds = range(ROUNDS)
    for r in reversed(rounds) if back else rounds:
        side = r % 2
        source, modulus = (b, size[0]) if side == 0 else (a, size[1])
        h = int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{r}|{source}".encode(), key=key, digest_size=16).digest(), "big") % modulus
        h = -h if back else h
        if side == 0:
            a = (a + h) % modulus
        else:
            b = (b + h) % modulus
    return f"{a:0{u}d}{b:0{n - u}d}"


def walked(digits: str, key: bytes, tweak: str, same: Callable[[str], object], back: bool = False) -> str:
    """The permutation among the digit strings of one class: the cycle is walked until ``same`` is as it was."""
    kind, new = same(digits), feistel(digits, key, tweak, back)
    while same(new) != kind:
        new = feistel(new, key, tweak, back)
    return new


def _filled(value: str, digits: str) -> str:
    """The value with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _iban(value: str, key: bytes, back: bool) -> str:
    """Permutes the digits after the check digits, which are set so that a valid number stays valid, any other not."""
    compact = re.sub(r"[ -]", "", value).upper()
    rest = compact[4:]
    due = lambda body: 98 - _iban_rest(compact[:2] + "00" + body)
    letters = re.sub(r"\d", "0", rest)
    body = _filled(rest, feistel(re.sub(r"\D", "", rest), key, f"iban|{compact[:2]}|{letters}", back))
    check = (due(body) + int(compact[2:4]) - due(rest)) % 100
    return _filled(value, f"{check:02d}" + re.sub(r"\D", "", body))


def _eleven(digits: str, key: bytes, back: bool) -> str:
    """Valid nine-digit numbers among each other, by their first eight digits; the check digit follows."""
    check = lambda d: sum(int(c) * w for c, w in zip(d, [9, 8, 7, 6, 5, 4, 3, 2])) % 11
    new = walked(digits[:8], key, "eleven", lambda d: check(d) < 10, back)
    return new + str(check(new))


def _birth_number(digits: str, key: bytes, back: bool) -> str | None:
    """Eleven digits of year, month, day, serial number and a check of 97; None if it has no such meaning."""
    for century in (1900, 2000):
        due = lambda d, c=century: 97 - int(("2" if c == 2000 else "") + d) % 97
        if due(digits[:9]) != int(digits[9:]):
            continue
        try:
            day = datetime.date(century + int(digits[:2]), int(digits[2:4]), int(digits[4:6]))
        except ValueError:
            continue
        first = datetime.date(century, 1, 1)
        days = (datetime.date(century + 100, 1, 1) - first).days

        def body(rank: int, serial: str, first=first) -> str:
            d = first + datetime.timedelta(rank)
            return f"{d.year % 100:02d}{d.month:02d}{d.day:02d}{serial}"

        rank = int(walked(f"{(day - first).days:05d}", key, f"born|{century}", lambda d, n=days: int(d) < n, back))
        new = body(rank, feistel(digits[6:9], key, "born", back))
        return new + f"{due(new):02d}"
    return None


def _number(value: str, key: bytes, back: bool) -> str:
    digits, letters = re.sub(r"\D", "", value), re.sub(r"[^A-Za-z]", "", value).upper()
    if re.match(r"[A-Za-z]{2}\d\d", value) and len(digits) >= 9:
        return _iban(value, key, back)
    if not letters and len(digits) == 11 and (new := _birth_number(digits, key, back)):
        return _filled(value, new)
    if not letters and len(digits) == 9 and re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        given_out = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        return _filled(value, walked(digits, key, "social", given_out, back))
    if not letters and len(digits) == 9:
        return _filled(value, _eleven(digits, key, back) if eleven_proof(digits) else walked(digits, key, "national", eleven_proof, back))
    return _filled(value, feistel(digits, key, f"id|{letters}", back))


def _phone(value: str, key: bytes, back: bool) -> str:
    """Prefix and first digit stay, the rest of the subscriber's number is permuted, however the prefix is written."""
    digits = re.sub(r"\D", "", value)
    skip = 0
    if value.lstrip().startswith("+") or digits.startswith("00"):
        skip = 0 if value.lstrip().startswith("+") else 2
        skip += next((n for n in (1, 2) if digits[skip : skip + n] in SHORT_COUNTRY_CODES), 3)
        if "(0)" in value:
            skip += 1
    elif digits.startswith("0"):
        skip = 1
    keep = min(skip + 1, len(digits))
    own = digits[keep:]
    return _filled(value, digits[:keep] + feistel(own, key, f"phone|{digits[skip:keep]}", back))


def _date(value: str, key: bytes, back: bool) -> str:
    """A day among the days of the same two centuries; what is no day stays as it is.

    A date is read with its day first unless only the month can be. Days up to the 12th and later ones are permuted
    apart, so that both notations of a day have the same pseudonym and read back alike.
    """
    m = _DATE.fullmatch(value)
    if not m:
        return value
    a, b, year = int(m[1]), int(m[3]), int(m[4])
    month_first = b > 12
    day, month = (b, a) if month_first else (a, b)
    try:
        date = datetime.date(year, month, day)
        first = datetime.date(max(1, year // YEARS * YEARS), 1, 1)
    except ValueError:
        return value
    low = day <= 12

    def same(digits: str) -> bool:
        try:
            d = first + datetime.timedelta(int(digits))
        except OverflowError:
            return False
        return d.year // YEARS == year // YEARS and (d.day <= 12) == low

    new = first + datetime.timedelta(int(walked(f"{(date - first).days:05d}", key, f"date|{first.year}", same, back)))
    x, y = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{x:0{len(m[1])}d}{m[2]}{y:0{len(m[3])}d}{m[2]}{new.year:04d}"


def canonical(kind: str, value: str) -> str:
    """What makes two pieces of a kind the same value."""
    v = " ".join(value.split()).casefold()
    if kind == "email":
        v = re.sub(r"\s?[\[({]\s?(?:at|@|arroba|apenstaartje|a)\s?[\])}]\s?|\s(?:at|arroba|apenstaartje)\s|\s?@\s?", "@", v)
        return re.sub(r"\s?[\[({]\s?(?:dot|punt|punto|point|\.)\s?[\])}]\s?|\s(?:dot|punt|punto|point)\s", ".", v)
    v = v.replace("’", "'")
    if kind == "person_name":
        last, comma, given = v.partition(",")
        return " ".join(f"{given} {last}".split()) if comma else v
    return " ".join(re.sub(r"[,.]", " ", v).split())


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a piece. Those of numbers and dates are values of the same format, and ``back`` undoes them."""
    if not value.isascii() and kind in ("phone", "id_number", "date"):
        value = "".join(str(int(c)) if c.isdecimal() else c for c in value)
    if kind == "phone":
        return _phone(value, key, back)
    if kind == "id_number":
        return _number(value, key, back)
    if kind == "date":
        return _date(value, key, back)
    return hashlib.blake2b(f"{kind}|{canonical(kind, value)}".encode(), key=key, digest_size=16).hexdigest()


def replaced(text: str, pieces: list[tuple[str, int, int]], key: bytes) -> str:
    """The text with each piece replaced by ``[kind pseudonym]``; the rest is unchanged."""
    out, at = [], 0
    for kind, a, b in pieces:
        out += [text[at:a], f"[{kind} {pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])
