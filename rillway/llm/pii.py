"""Format-preserving pseudonyms: validated numbers and dates keyed-permuted within their format.

The permutation is an alternating Feistel network over mixed radices with a keyed BLAKE2 round function;
it depends on the kind and the value alone, so equal values get equal pseudonyms in every document.
Check digits are recomputed, calendar days stay calendar days of their century, punctuation stays. Phone numbers
are those of a numbering plan: with a country code and the number of digits of its country, with an area code in
American signs, with a trunk 0 in common groups, or plain digits after a word that calls them a number. Letters of
an address beyond the alphabets of LETTERS stay. Every text is read in time near linear in its length.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.store import bounded

ROUNDS = 10
KINDS = ("iban", "card", "email", "ip", "ssn", "date", "phone")
PATTERNS = {
    "iban": re.compile(r"(?a)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?a)(?<![\d.+-])(?:\d{13,19}(?![\d-])|(?<!\d\x20)(?:\d{4}([\x20-])\d{4}\1\d{4}\1(?:\d{4}\1\d{1,3}|\d{1,4})|\d{4}([\x20-])\d{6}\2\d{4,5})(?![\d-]|\x20\d))"),
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?a:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)"),
    "ip": re.compile(r"(?a)(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d|-\d\b)"),
    "ssn": re.compile(r"(?a)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "date": re.compile(r"(?a)(?<![\d./-])(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?![\d/-]|\.\d)"),
    # with a country code, an American number with its signs, a number with a trunk 0, or digits after what calls them a number
    "phone": re.compile(
        r"""(?ai)(?<![\w+(.-])(?:\+\d{1,15}+(?:[\x20.-]?\(\d{1,5}\)|[\x20.-]\d{1,12}+(?!\w)){0,6}+(?!\w)
        |(?:\(\d{3}\)\x20?\d{3}|[2-9]\d\d[\x20.-][2-9]\d\d)[.-]\d{4}(?![\w-]|\.\d)
        |0[1-9](?:(?:[\x20.-]\d\d){4}|\d{1,4}[\x20/-]\d{5,8}|\d{1,3}[\x20-]\d{3,4}[\x20-]\d{4})(?![\w-]|[.\x20]\d)
        |(?<=\x20)(?:[2-9]\d\d[\x20.-]?\d{4}|\d{3}(?:[\x20.-]\d{3}){2}|\d{9,11})(?![\w-]|[.\x20]\d))""",
        re.VERBOSE,
    ),
}
#: What calls the digits after it a phone number, with up to three small words between.
_CALLED = re.compile(r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|ring|dial|sms|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|m[oó]vil|handy)[.:#]?\x20(?:(?:me|us|at|on|is|no|nr|num|number)[.:]?\x20){0,3}$")
_CALLED_WITHIN = 48
#: Country codes of one digit, and the first two digits that begin codes of two; all others have three.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
NO_CODES = ("0", "210", "214", "215", "217", "219", "28", "83", "89", "99")
#: Least and greatest number of digits after the country code, where the plan has them narrower than 6 to 12.
NATIONAL_DIGITS = {"1": (10, 10), "7": (10, 10), "31": (9, 9), "33": (9, 9), "34": (9, 9), "39": (6, 11), "41": (9, 9), "44": (9, 10), "45": (8, 8), "47": (8, 8), "48": (9, 9), "49": (6, 11), "61": (9, 9), "81": (9, 10), "86": (10, 11), "91": (10, 10)}
#: Alphabets of letters beyond ASCII, by first letter and number: a letter is replaced by one of its alphabet.
LETTERS = ((0xDF, 24), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x3B1, 17), (0x3C3, 7), (0x391, 17), (0x3A3, 7), (0x430, 32), (0x410, 32), (0x5D0, 27), (0x621, 26), (0x641, 10), (0x904, 54), (0x3041, 86), (0x30A1, 90), (0x4E00, 20_902), (0xAC00, 11_172))


def permute(values: list[int], radices: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of all value lists of these radices; ``back`` inverts it. One value alone walks the
    cycle of a square domain."""
    if len(values) == 1:
        return [permute_below(values[0], radices[0], key, tweak, back)]
    half = len(values) // 2
    mod, num = [1, 1], [0, 0]
    for i, (v, r) in enumerate(zip(values, radices, strict=True)):
        s = i >= half
        num[s] = num[s] * r + v
        mod[s] *= r
    size = [max(1, (m.bit_length() + 7) // 8) for m in mod]
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        s = i & 1
        seed = b"%d|%d|%d|" % (i, mod[0], mod[1]) + tweak.encode() + b"|" + num[1 - s].to_bytes(size[1 - s], "big")
        f = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=min(64, size[s] + 8)).digest(), "big")
        num[s] = (num[s] - f if back else num[s] + f) % mod[s]
    out = []
    for i in reversed(range(len(values))):
        s = i >= half
        num[s], v = divmod(num[s], radices[i])
        out.append(v)
    return out[::-1]


def permute_below(value: int, bound: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The same on 0..bound-1, by walking the cycle of a square domain until it is inside."""
    side = max(2, math.isqrt(max(0, bound - 1)) + 1)
    while True:
        a, b = permute([value // side, value % side], [side, side], key, tweak, back)
        value = a * side + b
        if value < bound:
            return value


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _put(text: str, chars: list[str], where: list[int]) -> str:
    out = list(text)
    for i, c in zip(where, chars, strict=True):
        out[i] = c
    return "".join(out)


def _class_of(c: str) -> tuple[int, int] | None:
    """(first, number) of the characters that may stand for this one: digits, letters of its case or alphabet."""
    if c.isascii():
        return (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else None
    return next(((first, n) for first, n in LETTERS if first <= ord(c) < first + n), None)


def _by_class(text: str, where: list[int], key: bytes, tweak: str, back: bool) -> str:
    """Permutes the letters and digits at ``where``, each within its class."""
    kinds = [_class_of(text[i]) for i in where]
    got = permute([ord(text[i]) - first for i, (first, _) in zip(where, kinds, strict=True)], [n for _, n in kinds], key, tweak, back)
    return _put(text, [chr(first + v) for (first, _), v in zip(kinds, got, strict=True)], where)


def country_code(digits: str) -> str:
    """The country code that these digits begin with; empty if there is none."""
    if digits.startswith(NO_CODES) or len(digits) < 7:
        return ""
    return digits[:1] if digits[0] in ONE_DIGIT_CODES else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def phone_digits(text: str) -> tuple[int, list[tuple[int, int]]] | None:
    """(digits that stay, first and number of what may stand for each other digit), or None if it is no number of
    its plan."""
    digits = [c for c in text if c.isdigit()]
    free = [(0, 10)] * len(digits)
    if text[0] == "+":
        code = country_code("".join(digits))
        least, most = NATIONAL_DIGITS.get(code, (6, 12))
        return (len(code), free[len(code) :]) if code and least <= len(digits) - len(code) <= most and len(digits) <= 15 else None
    if text[0] == "0":
        return (1, [(1, 9), *free[2:]]) if 9 <= len(digits) <= 12 and digits[1] != "0" else None
    if text[0] != "(" and len(digits) == 10 and not text.isdigit():
        return (0, [(2, 8), *free[1:3], (2, 8), *free[4:]])
    return (0, [(2, 8), *free[1:]]) if len(digits) == 7 else (0, free)


def pieces(text: str) -> list[int]:
    """Ends of the groups of digits of a number with a country code, longest first."""
    return [m.end() for m in re.finditer(r"\d+\)?", text)][::-1]


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one match, or None where it doesn't hold against its format's rule."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isdigit()]
    digits = [int(text[i]) for i in at]
    if kind == "card":
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        new = permute(digits[:-1], [10] * (len(digits) - 1), key, "card", back)
        return _put(text, [str(d) for d in [*new, next(c for c in range(10) if luhn([*new, c]))]], at)
    if kind == "iban":
        solid = [i for i, c in enumerate(text) if c != " "]
        plain = "".join(text[i] for i in solid)
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = _by_class(plain, list(range(4, len(plain))), key, plain[:2], back)
        return _put(text, list(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body[4:]):02d}" + body[4:]), solid)
    if kind == "ip":
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        return ".".join(map(str, permute(parts, [256] * 4, key, "ip", back)))
    if kind == "ssn":
        if text[:3] in ("000", "666") or text[4:6] == "00" or text[7:] == "0000" or text[0] == "9":
            return None
        a = [*range(1, 666), *range(667, 900)]
        x = permute([a.index(int(text[:3])), int(text[4:6]) - 1, int(text[7:]) - 1], [len(a), 99, 9999], key, "ssn", back)
        return f"{a[x[0]]:03d}-{x[1] + 1:02d}-{x[2] + 1:04d}"
    if kind == "date":
        m = PATTERNS["date"].fullmatch(text)
        y, mo, d = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
        swap = not m[1] and int(mo) > 12 and int(d) <= 12  # month first
        try:
            day = dt.date(int(y), int(d if swap else mo), int(mo if swap else d))
        except ValueError:
            return None
        first = dt.date(max(1, day.year // 100 * 100), 1, 1)
        last = dt.date(day.year // 100 * 100 + 99, 12, 31)
        span = (last - first).days + 1
        new = first + dt.timedelta(permute_below((day - first).days, span, key, f"date{first.year}", back))
        if m[1]:
            return f"{new.year:04d}{m[2]}{new.month:0{len(m[3])}d}{m[2]}{new.day:0{len(m[4])}d}"
        one, two = (new.month, new.day) if swap else (new.day, new.month)
        return f"{one:0{len(m[5])}d}{m[6]}{two:0{len(m[7])}d}{m[6]}{new.year:04d}"
    if kind == "email":
        local = text.index("@")
        where = [i for i in range(local) if _class_of(text[i])]
        return _by_class(text, where, key, "email" + text[local:], back) if where else None
    plan = phone_digits(text)
    if plan is None:
        return None
    stay, kinds = plan
    if any(not first <= d < first + n for d, (first, n) in zip(digits[stay:], kinds, strict=True)):
        return None
    new = permute([d - first for d, (first, _) in zip(digits[stay:], kinds, strict=True)], [n for _, n in kinds], key, "phone", back)
    return _put(text, [str(d) for d in [*digits[:stay], *(first + v for v, (first, _) in zip(new, kinds, strict=True))]], at)


#: Equal values are common; what a process has worked out last is kept.
_pseudonym = lru_cache(maxsize=65_536)(pseudonym)


def matches(kind: str, text: str, key: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the values of one kind that hold against its rule, by start."""
    for m in PATTERNS[kind].finditer(text):
        s, e = m.span()
        if kind == "phone" and text[s] == "+":
            # the longest run of groups that is a number of its country
            e = next((s + n for n in pieces(m[0]) if phone_digits(text[s : s + n])), s)
        elif kind == "phone" and text[s] not in "(0" and not (sum(c.isdigit() for c in m[0]) == 10 and not m[0].isdigit()) and not _CALLED.search(text, max(0, s - _CALLED_WITHIN), s):
            continue
        if e > s and (new := _pseudonym(kind, text[s:e], key)) is not None:
            yield s, e, new


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all values, earlier kinds of KINDS first where they overlap.

    Spans never overlap, so those found before that are nearest to a match tell whether it is free."""
    out: list[tuple[int, int, str, str]] = []
    if not any(c in text for c in "0123456789@"):
        return out
    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        starts, more = [x[0] for x in out], []
        for s, e, new in matches(kind, text, key):
            i = bisect_right(starts, s)
            if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or out[i][0] >= e):
                more.append((s, e, kind, new))
        out = list(merge(out, more))
    return out


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    out, at, found = [], 0, find(text, key)
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [x[:3] for x in found]


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the rewritten whole text, the number of values per kind, and their spans in the input.

    Spans are kind:start:end in code points, by start, comma-joined. A null text stays null and has no
    values; repeated rows give repeated results. Whoever has the key can invert the pseudonyms, so there is
    no default; an empty key is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, count = [], [], [[] for _ in KINDS]
            for value in batch.column(1):
                value = value.as_py()
                new, found = (None, []) if value is None else replaced(value, key)
                texts.append(new)
                spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in found))
                for c, kind in zip(count, KINDS, strict=True):
                    c.append(sum(k == kind for _, _, k in found))
            cols = [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.string()), *(pa.array(c, pa.int64()) for c in count)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "spans", *(f"n_{k}" for k in KINDS)])

    schema = "doc_id long, text string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
