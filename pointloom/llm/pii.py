"""Operator 9: format-preserving Feistel pseudonyms for personal data."""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

KINDS = ("email", "iban", "card", "ip", "ssn", "phone", "date")
_ROUNDS = 10

# The shapes that are looked for. Each find is validated before it is replaced.
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])")
_BOUND = r"(?!\w|[.-][0-9])"
#: Nothing that a card might be made of on either side, so digits written like this aren't a part of one.
_APART, _END = r"(?<![0-9][ -])", r"(?!\w|[ .-]?[0-9])"
# The months' names; an abbreviation is the first three letters.
_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS)
#: Where a find may start: IBANs and cards by their head, as each of their lengths is tried.
_START = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})|[a-z]{2}[0-9]{2}(?= ?[a-z0-9]{4}))"
    rf"|(?P<date>[0-9]{{4}}(?P<first>[./-])[0-9]{{1,2}}(?P=first)[0-9]{{1,2}}{_BOUND}|[0-9]{{1,2}}(?P<sep>[./-])[0-9]{{1,2}}(?P=sep)[0-9]{{4}}{_BOUND}"
    rf"|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}(?![\w/]|[.-][0-9])|[0-9]{{1,2}} (?:{_MONTH}) [0-9]{{4}}{_BOUND}|(?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}}{_BOUND})"
    rf"|(?P<ip>(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_BOUND}|(?<!:)(?:[0-9a-fA-F]{{0,4}}:){{2,7}}[0-9a-fA-F]{{0,4}}(?![\w:]|[.-][0-9]))"
    rf"|(?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_BOUND}|{_APART}[0-9]{{3}} [0-9]{{2}} [0-9]{{4}}{_END})"
    rf"|(?P<phone>(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[.-])[0-9]{{3}}[.-][0-9]{{4}}{_BOUND}"
    rf"|{_APART}(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}} )[2-9][0-9]{{2}} [0-9]{{4}}{_END}|{_APART}[2-9][0-9]{{2}}[2-9][0-9]{{6}}{_END}|\+[0-9](?:[ .-]?\(?[0-9]\)?){{7,14}}{_BOUND})"
    r"|(?P<card>[0-9](?=(?:[ -]?[0-9]){12}))"
    r")"
)
_CARD_END = re.compile(r"(?!\w|\.[0-9])")
#: Lengths of IBANs by country; of others the longest that fits is tried.
_IBAN_LENGTH = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_IBAN_TRY = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + _BOUND) for n in range(15, 35)}
_IBAN_TRY |= {-n: re.compile(p.pattern.replace("A-Z", "a-z", 1).replace("A-Z0-9", "a-z0-9")) for n, p in _IBAN_TRY.items()}  # in lower case
# The country codes of telephone numbers of one and two digits; all others have three.
_COUNTRY = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: Letters and digits of a name above which it is permuted by halves of its letters.
LONG = 100
#: Times that the values of finds which might be read otherwise are permuted on.
_MOST_WALKS = 2000
_DIGIT, _NUMBER = re.compile("[0-9]"), re.compile("[0-9]+")
# The alphabets that stay within themselves.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ")
_PLACE = {c: (k, i) for k, letters in enumerate(_ALPHABETS) for i, c in enumerate(letters)}
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _half(value: int, bits: int, turn: int, key: bytes, tweak: bytes) -> int:
    size = max(8, -(-bits // 8))
    mixed = hashlib.blake2b(value.to_bytes(-(-max(value.bit_length(), 1) // 8), "big") + bytes([turn]), digest_size=min(size, 64), key=key, person=tweak[:16]).digest()
    if size > 64:
        mixed = hashlib.shake_256(mixed).digest(size)
    return int.from_bytes(mixed, "big") & ((1 << bits) - 1)


def _feistel(value: int, low: int, high: int, key: bytes, tweak: bytes, back: bool) -> int:
    """One keyed permutation of numbers of high + low bits; each round changes one part by a hash of the other."""
    left, right = value >> low, value & ((1 << low) - 1)
    for turn in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
        if turn % 2:
            right ^= _half(left, low, turn, key, tweak)
        else:
            left ^= _half(right, high, turn, key, tweak)
    return left << low | right


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the valid numbers in 0..size-1: values that fall outside are permuted on until they don't,
    which keeps it one to one. back inverts it."""
    bits = max(2, (size - 1).bit_length())
    low = bits // 2
    tweak_bytes = hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()
    while True:
        value = _feistel(value, low, bits - low, key, tweak_bytes, back)
        if value < size and valid(value):
            return value


def _paired(c: str) -> bool:
    """Whether a letter has one of the other case that leads back to it."""
    other = c.lower() if c.isupper() else c.upper()
    return len(other) == 1 and other != c and (other.upper() if c.isupper() else other.lower()) == c


@functools.cache
def _letters(block: int, category: str, paired: bool) -> str:
    """The letters of a block of 128 code points that are of one category, those of two cases or those of one; what the fixed
    alphabets have is left to them."""
    own = (chr(c) for c in range(block << 7, (block + 1) << 7))
    return "".join(c for c in own if unicodedata.category(c) == category and _paired(c) == paired and c not in _PLACE)


@functools.lru_cache(10_000)
def _place(c: str) -> tuple[str, str, int] | None:
    """A name and the letters of the alphabet that c stays in, and c's place there; None if c stays as it is."""
    if c in _PLACE:
        k, i = _PLACE[c]
        return str(k), _ALPHABETS[k], i
    category = unicodedata.category(c)
    if c.isascii() or category not in ("Ll", "Lu", "Lo"):
        return None
    paired = _paired(c)
    letters = _letters(ord(c) >> 7, category, paired)
    return (f"({ord(c) >> 7:x}{category}{paired:d})", letters, letters.index(c)) if len(letters) > 1 else None


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str | None:
    """Permute the letters and digits of a text within their alphabets; None if it has none. Short texts are permuted as one
    number in mixed radix; of long ones, halves of the letters are shifted in turns by a hash of the other half, in time
    that follows the length."""
    places = [_place(c) for c in text]
    found = [p for p in places if p]
    if not found:
        return None
    shape = tweak + "".join("." if p is None else p[0] for p in places)
    sizes, at = [len(p[1]) for p in found], [p[2] for p in found]
    if len(found) > LONG:
        at = _shifted(np.array(at), np.array(sizes), key, hashlib.blake2b(shape.encode(), digest_size=16).digest(), back)
    else:
        value = permute(functools.reduce(lambda v, x: v * x[1] + x[0], zip(at, sizes, strict=True), 0), math.prod(sizes), key, shape, back)
        for i in range(len(at) - 1, -1, -1):
            value, at[i] = divmod(value, sizes[i])
    new = iter(p[1][i] for p, i in zip(found, at, strict=True))
    return "".join(c if p is None else next(new) for c, p in zip(text, places, strict=True))


def _shifted(at: np.ndarray, sizes: np.ndarray, key: bytes, tweak: bytes, back: bool) -> list[int]:
    """A Feistel network over letters instead of bits: each round moves every letter of one half within its alphabet."""
    half = len(at) // 2
    sides = slice(0, half), slice(half, len(at))
    for turn in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
        own, other = sides if turn % 2 else sides[::-1]
        seed = hashlib.blake2b(at[other].astype("<u4").tobytes() + bytes([turn]), key=key, person=tweak).digest()
        step = np.frombuffer(hashlib.shake_256(seed).digest(4 * len(at[own])), "<u4").astype(np.int64)
        at[own] = (at[own] + (-step if back else step)) % sizes[own]
    return at.tolist()


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The last digit that makes a number pass the Luhn check."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[ -]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    n = len(digits) - 1
    # the sum of the other digits doubled stays, so whether the card with more digits passes stays too
    other = luhn_digit(digits)
    full = lambda v: (p := f"{v:0{n}d}") + luhn_digit(p)
    new = f"{permute(int(digits[:-1]), 10**n, key, 'card', back, lambda v: luhn_digit(full(v)) == other):0{n}d}"
    return _fill(text, new + luhn_digit(new))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    rest = _mixed(plain[4:], key, "iban" + plain[:2], back)
    new = iter(plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + rest):02d}" + rest)
    return "".join(c if c == " " else n.lower() if c.islower() else n for c in text for n in ([""] if c == " " else [next(new)]))


def _ip(text: str, key: bytes, back: bool) -> str | None:
    """Of version 4 as a number; of version 6 the digits and the letters as they are written, each where they stand, so that
    what is read beside an address stays."""
    if ":" in text:
        digits = text.replace(":", "")
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        if len(digits) < 2 or not _DIGIT.search(digits) or digits not in (digits.lower(), digits.upper()):
            return None
        letters = "ABCDEF" if digits != digits.lower() else "abcdef"
        own = [("0123456789" if c.isdigit() else letters) for c in digits]
        value = functools.reduce(lambda v, x: v * len(x[1]) + x[1].index(x[0]), zip(digits, own, strict=True), 0)
        value, new = permute(value, math.prod(map(len, own)), key, "ip" + re.sub("[a-f]", "a", _DIGIT.sub("0", text.lower())), back), []
        for signs in reversed(own):
            value, i = divmod(value, len(signs))
            new.append(signs[i])
        return "".join(c if c == ":" else new.pop() for c in text)
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn_ok(value: int) -> bool:
    area, group, serial = value // 10**6, value // 10**4 % 100, value % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    value = int(re.sub("[ -]", "", text))
    return _fill(text, f"{permute(value, 10**9, key, 'ssn', back, _ssn_ok):09d}") if _ssn_ok(value) else None


def _american(value: int) -> bool:
    """Whether area and exchange of a ten-digit number begin with 2 to 9."""
    return value >= 2 * 10**9 and value // 10**6 % 10 >= 2


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country's code stays; so does whether a number of the country 1 could be dialled. Ten digits without a code are
    of the country 1."""
    digits = "".join(_DIGIT.findall(text))
    if text[0] == "+" and digits[0] == "0":
        return None
    code = next(digits[:n] for n in (1, 2, 3) if n == 3 or digits[:n] in _COUNTRY) if text[0] == "+" else digits[:-10]
    own, country = digits[len(code) :], code if text[0] == "+" else "1"
    if country == "1" and len(own) == 10:
        like = _american(int(own))
        new = permute(int(own), 10**10, key, "phone", back, lambda v: _american(v) == like)
    else:
        new = permute(int(own), 10 ** len(own), key, "phone" + country, back)
    return _fill(text, code + f"{new:0{len(own)}d}")


def _date_kind(day: datetime.date) -> tuple[bool, bool, bool]:
    """What a date must keep to be written in the same way: one or two digits, and whether its day could be a month."""
    return day.day < 10, day.month < 10, day.day > 12


def _written_date(text: str, key: bytes, back: bool) -> str | None:
    """A month's name gets another of its length, so an abbreviation an abbreviation."""
    name = re.search("[A-Z][a-z]+", text).group()
    day, year = _NUMBER.findall(text)
    names = [m[: len(name)] if len(name) == 3 else m for m in _MONTHS]
    try:
        old = datetime.date(int(year), names.index(name) + 1, int(day))
    except ValueError:
        return None
    if len(day) != len(str(old.day)) or not _FIRST_DAY <= old.toordinal() <= _LAST_DAY:
        return None
    new = _other_day(old, key, "date", back, lambda d: len(names[d.month - 1]) == len(name))
    it = iter((str(new.day), str(new.year)))
    return _NUMBER.sub(lambda _: next(it), text.replace(name, names[new.month - 1]))


def _other_day(old: datetime.date, key: bytes, tweak: str, back: bool, like: Callable[[datetime.date], bool] = lambda _: True) -> datetime.date:
    of, kind = lambda v: datetime.date.fromordinal(_FIRST_DAY + v), _date_kind(old)
    return of(permute(old.toordinal() - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, tweak, back, lambda v: _date_kind(of(v)) == kind and like(of(v))))


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Year first, or day first, or month first where the second number can only be a day. Two digits of a year are of this
    century, and stay so."""
    if re.search("[A-Z]", text):
        return _written_date(text, key, back)
    a, b, c = re.split("[-./]", text)
    orders = ((a, b, c),) if len(a) == 4 else ((c, b, a), (c, a, b))
    short = len(a) < 4 and len(c) == 2
    for number, order in enumerate(orders):
        try:
            old = datetime.date(int(order[0]) + 2000 * short, *map(int, order[1:]))
        except ValueError:
            continue
        if not _FIRST_DAY <= old.toordinal() <= _LAST_DAY:
            return None
        new = _other_day(old, key, "date of two digits" if short else "date", back, lambda d: d.year >= 2000 * short)
        year = new.year % 100 if short else new.year
        parts = [new.year, new.month, new.day] if len(a) == 4 else [new.day, new.month, year] if number == 0 else [new.month, new.day, year]
        it = iter(f"{p:0{len(x)}d}" for p, x in zip(parts, (a, b, c), strict=True))
        return _NUMBER.sub(lambda _: next(it), text)
    return None


def _email(text: str, key: bytes, back: bool) -> str | None:
    """The local part changes, without regard to case, and the domain stays. A local part without letters and digits is none."""
    local, _, domain = text.partition("@")
    lowered = [c.lower() if c.isupper() and _paired(c) else c for c in local]
    new = _mixed("".join(lowered), key, "email" + domain.lower(), back)
    return new and "".join(n if o == c else n.upper() for o, c, n in zip(local, lowered, new, strict=True)) + "@" + domain


_CHANGE = {"email": _email, "iban": _iban, "card": _card, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date}


@functools.lru_cache(100_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """What stands for a find, or None if it isn't valid. The same value written otherwise gets the same pseudonym,
    written in its way."""
    return _CHANGE[kind](text, key, back)


def _ends(text: str, kind: str, start: int) -> list[int]:
    """Where an IBAN or card that starts there may end, the longest first. An IBAN has one length."""
    if kind == "iban":
        country = text[start : start + 2]
        n = _IBAN_LENGTH.get(country.upper())
        if country.islower():  # words and hexadecimal numbers begin like this too, so only in a country's length
            return [m.end()] if n and (m := _IBAN_TRY[-n].match(text, start)) else []
        return [m.end() for k in ([n] if n else range(34, 14, -1)) if (m := _IBAN_TRY[k].match(text, start))][:1]
    out, digits = [], 0
    for i in range(start, min(len(text), start + 37)):
        if "0" <= text[i] <= "9":
            digits += 1
            if digits > 19:
                break
            if digits > 12 and _CARD_END.match(text, i + 1):
                out.append(i + 1)
        elif text[i] not in " -" or not "0" <= text[i - 1] <= "9":
            break
    return out[::-1]


def scan(text: str, key: bytes, back: bool = False, at: int = 0) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The valid finds but e-mails (kind, start, end), and what was read in vain, from start to end. At each start the longest
    that is valid is taken, and the next start is behind it; where none is, later starts are tried."""
    finds, vain = [], []
    while m := _START.search(text, at):
        first = next(k for k in KINDS if k != "email" and m[k] is not None)
        at = m.start()
        if text[at] == "+":  # a sign before a card
            cards = [e for e in _ends(text, "card", at + 1) if e <= m.end() + 5]
            card = next((e for e in cards if pseudonym("card", text[at + 1 : e], key, back) is not None), None)
            vain += [(at, e) for e in cards]
            if card:
                at += 1
                continue
        tries = [(k, e) for k in dict.fromkeys([first] if first == "iban" else [first, "card"]) for e in (_ends(text, k, at) if k in ("iban", "card") else [m.end()])]
        found = next(((k, e) for k, e in tries if pseudonym(k, text[at:e], key, back) is not None), None)
        vain += [(at, e) for k, e in tries[: tries.index(found) if found else None]]
        if found:
            finds.append((found[0], at, found[1]))
        at = found[1] if found else at + 1
    return finds, vain


def _replace_numbers(text: str, key: bytes, back: bool, count: dict[str, int]) -> str:
    """The text with its finds but e-mails replaced. Finds that touch what was read in vain are permuted on together until
    they are read as they were, so that the way back finds the same."""
    finds, vain = scan(text, key, back)
    groups: list[list] = []  # start, end, finds, whether something was read in vain
    for start, end, find in sorted([(a, b, (k, a, b)) for k, a, b in finds] + [(a, b, None) for a, b in vain], key=lambda x: x[:2]):
        if not groups or start >= groups[-1][1]:
            groups.append([start, end, [], False])
        groups[-1][1] = max(groups[-1][1], end)
        groups[-1][2] += [find] if find else []
        groups[-1][3] |= find is None
    out, done = [], 0
    for start, end, own, unsure in groups:
        # what follows counts by its shape alone, and nothing reaches into it
        before, after = text[max(0, start - 1) : start], _DIGIT.sub("0", text[end : end + 2]) + "a" * (end < len(text))
        now, shape = text[start:end], [(k, a - start, b - start) for k, a, b in own]
        for _ in range(_MOST_WALKS if unsure else 1):
            parts, at = [], 0
            for k, a, b in shape:
                parts += [now[at:a], pseudonym(k, now[a:b], key, back)]
                at = b
            now = "".join([*parts, now[at:]])
            if not unsure or [(k, a - len(before), b - len(before)) for k, a, b in scan(before + now + after, key, back, len(before))[0]] == shape:
                break
        for k, _, _ in own:
            count[k] += 1
        out += [text[done:start], now]
        done = end
    return "".join([*out, text[done:]])


def pseudonymize_text(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its finds replaced, and how many there were of each kind."""
    count = dict.fromkeys(KINDS, 0)
    numbers = lambda part: _replace_numbers(part, key, back, count) if _DIGIT.search(part) else part
    if "@" not in text:
        return numbers(text), count
    out, at = [], 0
    for m in _EMAIL.finditer(text):
        new = pseudonym("email", m.group(), key, back)
        count["email"] += new is not None
        out += [numbers(text[at : m.start()]), m.group() if new is None else new]
        at = m.end()
    return "".join([*out, numbers(text[at:])]), count


def pseudonymize(docs: DataFrame, key: bytes, back: bool = False, example: bool = False) -> DataFrame:
    """doc_id, text, and n_<kind> for each kind of find: cards that pass Luhn, IBANs that pass mod 97, IP addresses,
    US social security numbers, ten-digit phone numbers and those with a country's code, calendar dates of 1900 to 2099,
    and e-mail addresses. Ten digits without signs are a phone number if area and exchange begin with 2 to 9.

    Each value is permuted within its format under the secret key, so documents stay linked by equal values, valid
    values stay valid, and back=True with the same key restores the texts. Cards are tried at every start and
    length that begins and ends with a group of digits, IBANs at every start in their country's length; where digits before or behind would make a
    pseudonym read otherwise, it is permuted on, and isn't linked then; past 2,000 times it isn't restored either. No shuffle and no table of pseudonyms:
    each row is done on its own, repeated rows alike, and texts of any length as a whole. A null text stays null with no
    finds, an empty one empty, and an empty table gives an empty one; a null doc_id is kept. Other columns are ignored."""
    if not key or key == EXAMPLE_KEY and not example:
        raise ValueError("pass a secret key of your own")
    names = [f"n_{k}" for k in KINDS]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in words.chunks(batches):
            texts, counts = [], []
            for text in batch.column("text").to_pylist():
                new, count = (None, dict.fromkeys(KINDS, 0)) if text is None else pseudonymize_text(text, key, back)
                texts.append(new)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]], names=["doc_id", "text", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


#: A stand-in for the secret: pass your own key to pseudonymize, from a secret store.
EXAMPLE_KEY = b"replace this key"


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), EXAMPLE_KEY, example=True)
