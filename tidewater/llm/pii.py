"""Operator 10: format-preserving Feistel pseudonyms for private data.

Numbers and dates that pass their format's check (Luhn, mod 97 and the country's
length, address rules, the calendar) are permuted within that format by a keyed
Feistel network, and so are phone numbers, the local parts of e-mail addresses and
secrets. Equal values get equal pseudonyms under one key, in all documents and
without any shared table, and who has the key can restore the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address
from math import isqrt
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import appended, fresh, per_worker, quoted, texts_of

ROUNDS = 10
KINDS = ("email", "secret", "iban", "date", "ssn", "ip", "phone", "card")
LOWER, UPPER, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
#: Lengths of account numbers by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """What a character may become: digits, letters of its script's neighbourhood and case, or itself."""
    for known in (LOWER, UPPER, DIGIT):
        if c in known:
            return known
    if c.isascii() or category(c) not in ("Lu", "Ll", "Lo"):
        return c
    first = ord(c) & ~0x7F
    return "".join(x for x in map(chr, range(first, first + 128)) if category(x) == category(c))


class Feistel:
    """A keyed permutation of range(n) for any n, apart for each tweak."""

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _round(self, tweak: str, n: int, r: int, half: int) -> int:
        data = f"{tweak}|{n}|{r}|{half}".encode()
        size = min(64, (n.bit_length() + 7) // 8 + 8)
        out = blake2b(data, key=self.key, digest_size=size).digest()
        if n.bit_length() > 400:
            out += blake2b(out + data, key=self.key, digest_size=64).digest() * (n.bit_length() // 512 + 1)
        return int.from_bytes(out)

    def _pass(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for r in range(ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * self._round(tweak, n, r, left)) % b
            else:
                left = (left + sign * self._round(tweak, n, r, right)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False, valid: Callable[[int], bool] | None = None) -> int:
        """The image of x, by walking on until it is below n and ``valid``, as x must be."""
        if n < 2:
            return x
        while True:
            x = self._pass(x, n, tweak, back)
            if x < n and (valid is None or valid(x)):
                return x

    def characters(
        self, text: str, kind: str, back: bool = False, sets: list[str] | None = None, valid: Callable[[str], bool] | None = None
    ) -> str:
        """Permute each character within its alphabet (or ``sets``), by walking on until ``valid``, as text must be."""
        sets = sets or [alphabet(c) for c in text]
        n, x = 1, 0
        for c, s in zip(text, sets, strict=True):
            n, x = n * len(s), x * len(s) + s.index(c)
        shape = kind + "".join(f"{len(s)}:{s[0]}," if len(s) > 1 else s for s in sets)

        def spelt(x: int) -> str:
            out = []
            for s in reversed(sets):
                x, i = divmod(x, len(s))
                out.append(s[i])
            return "".join(reversed(out))

        return spelt(self.permute(x, n, shape, back, valid and (lambda y: valid(spelt(y)))))

    def hexadecimal(self, text: str, kind: str, back: bool, keep: int = 0, valid: Callable[[str], bool] | None = None) -> str:
        """Permute the hexadecimal digits behind the first ``keep`` characters; the text stays in upper or lower case."""
        upper = any(c in UPPER for c in text)
        if upper and any(c in LOWER for c in text):
            of = {**dict.fromkeys("abcdef", "abcdef"), **dict.fromkeys("ABCDEF", "ABCDEF"), **dict.fromkeys(DIGIT, DIGIT)}
        else:
            digits = HEX.upper() if upper else HEX
            of = dict.fromkeys(digits, digits)
        sets = [c if i < keep else of.get(c, c) for i, c in enumerate(text)]
        cased = lambda t: (not upper or any(c in UPPER for c in t)) and (valid is None or valid(t))
        return self.characters(text, kind, back, sets, cased)


def luhn_digit(payload: str) -> str:
    """The check digit behind a payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _with_digits(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(f: Feistel, text: str, back: bool) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = 10 ** (len(d) - 2)
    plain = lambda x: len(set((p := d[0] + str(x).zfill(len(d) - 2)) + luhn_digit(p))) > 1
    payload = d[0] + str(f.permute(int(d[1:-1]), n, f"card{d[0]}", back, plain)).zfill(len(d) - 2)
    return _with_digits(text, payload + luhn_digit(payload))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """Country codes and leading zeros stay; the rest is one number, however it is written."""
    d = _digits(text)
    if not 7 <= len(d) <= 15:
        return None
    if "+" in text:
        first = re.match(r"[0-9]{1,3}(?![0-9])", text[text.index("+") + 1 :])
        keep = 1 if d[0] in "17" else len(first.group()) if first else 2
    elif country := re.match(r"00[1-9][0-9]{0,2}(?![0-9])", text):
        keep = len(country.group())
    else:
        keep = len(d) - len(d.lstrip("0"))
    rest = d[keep:]
    if not rest:
        return None
    zero, width = rest[0] == "0", len(rest)
    x = f.permute(int(rest), 10**width, f"phone{width}", back, lambda x: (x < 10 ** (width - 1)) == zero)
    return _with_digits(text, d[:keep] + str(x).zfill(width))


def _ipv6(f: Feistel, text: str, back: bool) -> str | None:
    def real(t: str) -> bool:
        return sum(map(bool, t.split(":"))) > 2 or t[:4].lower() == "fe80" or t[:2].lower() in ("fc", "fd") or t[:1] in ("2", "3")

    try:
        value = int(IPv6Address(text))
    except ValueError:
        return None
    if not real(text):
        return None
    usual = lambda t: t == str(IPv6Address(t))
    if usual(text):
        top, low = value >> 112, 2**112
        spelt = lambda x: str(IPv6Address((top << 112) + x))
        return spelt(f.permute(value % low, low, f"ip6{top}", back, lambda x: real(spelt(x)) and "." not in spelt(x)))
    return f.hexadecimal(text, "ip6", back, text.index(":"), lambda t: not usual(t))


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    if ":" in text:
        return _ipv6(f, text, back)
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts))), 2**32, "ip", back)
    return ".".join(map(str, x.to_bytes(4)))


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    ok = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 > 0 and x % 10**4 > 0
    x = int(_digits(text))
    return _with_digits(text, str(f.permute(x, 10**9, "ssn", back, ok)).zfill(9)) if ok(x) else None


def _iban_part(text: str) -> str:
    """What of a candidate its country's length leaves: the groups behind it may be other words."""
    length, at = IBAN_LENGTHS.get(text[:2].upper(), 0), 0
    for i, c in enumerate(text):
        at += c not in " -"
        if at == length:
            return text[: i + 1]
    return text


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    """Spaces, hyphens and the case of letters stay; small letters are only read in a known country's number."""
    written = "".join(c for c in text if c not in " -")
    compact = written.upper()
    if written != compact and compact[:2] not in IBAN_LENGTHS:
        return None
    if len(compact) != IBAN_LENGTHS.get(compact[:2], len(compact)) or not 2 <= int(compact[2:4]) <= 98:
        return None
    if _iban_number(compact[4:] + compact[:4]) % 97 != 1:
        return None
    body = f.characters(compact[4:], "iban" + compact[:2], back)
    new = iter(compact[:2] + str(98 - _iban_number(body + compact[:2] + "00") % 97).zfill(2) + body)
    return "".join(c if c in " -" else next(new).lower() if c.islower() else next(new) for c in text)


#: Names of months by language (fixed values).
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_MONTH = "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m)))
_NAMED = re.compile(rf"(?P<d>[0-9]{{1,2}})(?P<a>\.? | de )(?P<m>(?i:{_MONTH}))(?P<b> de | )(?P<y>[0-9]{{4}})|(?P<M>(?i:{_MONTH})) (?P<D>[0-9]{{1,2}})(?P<B>,? )(?P<Y>[0-9]{{4}})")


def _language(month: str, before: str) -> str | None:
    """The language of a month's name, told by what stands before it where several have it."""
    order = ("de", "en", "fr", "es") if before == ". " else ("es", "en", "fr", "de") if before == " de " else ("en", "fr", "de", "es")
    return next((k for k in order if month.lower() in MONTHS[k]), None)


def _named_date(f: Feistel, text: str, back: bool) -> str | None:
    """A date with a month's name: language, capitals, and a day of one digit stay as they are."""
    if not (m := _NAMED.fullmatch(text)):
        return None
    day, name, year, before = m["d"] or m["D"], m["m"] or m["M"], m["y"] or m["Y"], m["a"] or ""
    names = MONTHS[language := _language(name, before)]
    if (x := _ordinal(year, str(names.index(name.lower()) + 1), day)) is None:
        return None

    def fits(v: int) -> bool:
        p = date.fromordinal(v + FIRST_DAY)
        return (len(day) > 1 or p.day < 10) and _language(names[p.month - 1], before) == language

    p = date.fromordinal(f.permute(x, DAYS, "date", back, fits) + FIRST_DAY)
    new = names[p.month - 1]
    new = new.upper() if name.isupper() else new.capitalize() if name[0].isupper() else new
    d = f"{p.day:0{len(day)}}"
    return f"{d}{m['a']}{new}{m['b']}{p.year:04}" if m["d"] else f"{new} {d}{m['B']}{p.year:04}"


def _ordinal(y: str, m: str, d: str) -> int | None:
    try:
        x = date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return x if 0 <= x < DAYS else None


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """Year first, else day first, else (where that is no date) month first.

    A day or month of one digit stays one of one digit; two digits otherwise.
    """
    if any(c.isalpha() for c in text):
        return _named_date(f, text, back)
    sep = next(c for c in text if not c.isdigit())
    a, b, c = text.split(sep)
    orders = [("ymd", a, b, c)] if len(a) == 4 else [("dmy", c, b, a), ("mdy", c, a, b)]
    for order, y, m, d in orders:
        if (x := _ordinal(y, m, d)) is None:
            continue
        short_d, short_m = len(d) == 1, len(m) == 1

        def fits(v: int, order: str = order, short_d: bool = short_d, short_m: bool = short_m) -> bool:
            p = date.fromordinal(v + FIRST_DAY)
            # Month first was only read because the day is above 12; it stays so.
            return (not short_d or p.day < 10) and (not short_m or p.month < 10) and (order != "mdy" or p.day > 12)

        p = date.fromordinal(f.permute(x, DAYS, "date", back, fits) + FIRST_DAY)
        parts = {"y": f"{p.year:04}", "m": str(p.month) if short_m else f"{p.month:02}", "d": str(p.day) if short_d else f"{p.day:02}"}
        return sep.join(parts[k] for k in order)
    return None


def _email(f: Feistel, text: str, back: bool) -> str | None:
    local, at, domain = text.partition("@")
    return f.characters(local, "email", back) + at + domain


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    """Key names, known prefixes, quotes and frames stay."""
    if text.startswith("-----BEGIN"):
        return "\n".join(t if "-----" in t else f.characters(t, "secret", back) for t in text.split("\n"))
    if known := re.match(_PREFIXES, text):
        return known.group() + f.characters(text[known.end() :], "secret", back)
    head, mark, tail = re.fullmatch(r"([\w -]+?[\"']?\s*[=:]\s*(?:[\"']?(?i:basic)\s+)?|\w+\s+)([\"']?)(.*)", text, re.S).groups()
    body = tail.removesuffix(mark) if mark else tail
    digit = lambda t: any(c in DIGIT for c in t)
    if re.fullmatch("[0-9a-f]+", body) and digit(body):
        return head + mark + f.hexadecimal(body, "secret", back, 0, digit) + mark
    # The image of another body must not look hexadecimal.
    return head + mark + f.characters(body, "secret", back, None, lambda t: not (re.fullmatch("[0-9a-f]+", t) and digit(t))) + mark


#: What known kinds of secrets begin with (fixed values).
_PREFIXES = r"AKIA|gh[pousr]_|github_pat_|glpat-|sk-(?:proj-|live-|test-)?|xox[abprs]-|AIza|eyJ"
_KEYS, _PASSWORD = r"token|secret(?:[ _-]?key)?|(?:api|access|private)[ _-]?key", r"password|passwd|passphrase|pwd"
_SECRET = "|".join((
    r"\bAKIA[A-Z0-9]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"\bgithub_pat_\w{20,}", r"\bglpat-[\w-]{16,}", r"\bsk-[A-Za-z0-9_-]{16,}",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"\bAIza[A-Za-z0-9_-]{30,}", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]*PRIVATE KEY-----",
    r"\b(?i:bearer)\s+[A-Za-z0-9._~+/-]{20,}",
    r"\b(?i:authorization)[\"']?\s*[=:]\s*[\"']?(?i:basic)\s+[A-Za-z0-9+/]{8,}={0,2}",
    rf"(?<![^\W_])(?i:{_PASSWORD}|{_KEYS})[\"']?\s*[=:]\s*(?:\"[^\"\s]{{6,}}\"|'[^'\s]{{6,}}'|(?=[A-Za-z+/_~.-]*[0-9])[A-Za-z0-9+/_~.-]{{7,}}[A-Za-z0-9+/_~-]={{0,2}})",
    rf"(?<![^\W_])(?i:{_PASSWORD})[\"']?\s*[=:]\s*[^\s\"'<>(),;{{}}]{{8,}}",
))
_PHONE = "|".join((
    r"(?<![\w+.-])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\w-])",
    r"(?<![\w+.-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])",
    r"(?<![\w+.-])\+[2-9][0-9]{0,2}(?:[ ./-]?\(?[0-9]{1,6}\)?){1,6}(?<=[0-9])(?![\w-])",
    r"(?<![\w+.,/-])(?<!\d )00[1-9][0-9]{0,2}[ /-]\(?[0-9]{1,6}\)?(?:[ /-]?\(?[0-9]{1,6}\)?){0,6}(?<=[0-9])(?![\w-]|[.,/][0-9])",
    r"(?<![\w+.,/-])(?<!\d )0[1-9](?:[ .-][0-9]{2}){4}(?![\w-]|[.,/][0-9])",
    r"(?<![\w+.,/-])(?<!\d )0[1-9][0-9]{1,4}[ ]?[/ -][ ]?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![\w-]|[.,/][0-9])",
    r"\b(?i:tel|telefon|tel[ée]fono|t[ée]l[ée]phone|phone|fax|mobile|mobil|handy|m[óo]vil)[.:]{0,2} ?[0-9](?:[ ./()-]{0,2}[0-9]){6,14}(?![\w-])",
))
_DATE = rf"(?<![\w/.-])(?:[0-9]{{1,2}}(?:\.? | de )(?i:{_MONTH})(?: de | )[0-9]{{4}}|(?i:{_MONTH}) [0-9]{{1,2}},? [0-9]{{4}})(?![\w])|" + r"(?<![\d/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\d/]|[.-]\d)"
_IP = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.\d)|(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)"
_IBAN = r"\b[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|(?:[ -][A-Za-z0-9]{4}){2,7}(?:[ -][A-Za-z0-9]{1,4})?)\b"
#: In order of precedence; each match then has to pass its own check.
FORMATS: dict[str, tuple[str, Callable[[Feistel, str, bool], str | None]]] = {
    "email": (r"(?<![\w.+-])\w[\w.+%-]*@(?:[\w-]+\.)+[^\W\d_]{2,}", _email),
    "secret": (_SECRET, _secret),
    "iban": (_IBAN, _iban),
    "date": (_DATE, _date),
    "ssn": (
        r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])|(?<![\w-])(?<!\d )[0-9]{3} [0-9]{2} [0-9]{4}(?![\w-]| \d)|"
        r"\b(?i:ssn|social security(?: number| no\.?)?)[:#.]{0,2} ?[0-9]{9}(?![\w-])", _ssn,
    ),
    "ip": (_IP, _ip),
    "phone": (_PHONE, _phone),
    "card": (r"(?<![\w.+-])(?:[1-9](?:[ -]?[0-9]){12,18}|[1-9][0-9]{3}(?:\.[0-9]{4}){3})(?![\w-]|\.\d)", _card),
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in FORMATS.items()))
EACH = {k: re.compile(p) for k, (p, _) in FORMATS.items()}
#: A text without any of these holds nothing to find; plain searches are much cheaper than patterns.
MARKS = ("::", "-----BEGIN", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "xox", "AIza", "eyJ")
WORDS = ("password", "passwd", "passphrase", "pwd", "authorization", "token", "secret", "key", "bearer")
_SIGN = re.compile("[0-9@]")


def likely(text: str) -> bool:
    """Whether a text may hold private data."""
    if _SIGN.search(text) or any(m in text for m in MARKS):
        return True
    low = text.lower()
    return any(w in low for w in WORDS)


class Pseudonymiser:
    """Replaces private data in texts under one key."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.one = lru_cache(maxsize=50_000)(self._one)

    def _one(self, kind: str, value: str, back: bool) -> str | None:
        return FORMATS[kind][1](self.feistel, value, back)

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text, and (kind, start, end) of what was replaced; offsets are the old text's."""
        if not likely(text):
            return text, []
        out, spans, at, place = [], [], 0, 0
        while m := PATTERN.search(text, place):
            start = m.start()
            if (hit := self._at(text, start, m.lastgroup, back)) is None:
                place = start + 1
                continue
            kind, place, new = hit
            out += [text[at:start], new]
            spans.append((kind, start, place))
            at = place
        return ("".join([*out, text[at:]]) if spans else text), spans

    def _at(self, text: str, start: int, first: str, back: bool) -> tuple[str, int, str] | None:
        """The first format from ``first`` on whose match at ``start`` passes its check: (kind, end, new value)."""
        for kind in KINDS[KINDS.index(first) :]:
            if m := EACH[kind].match(text, start):
                value = _iban_part(m.group()) if kind == "iban" else m.group()
                if (new := self.one(kind, value, back)) is not None:
                    return kind, start + len(value), new
        return None


@per_worker
def pseudonymiser(key: bytes) -> Pseudonymiser:
    """The pseudonymiser of a worker, for all its tasks."""
    return Pseudonymiser(key)


def pseudonymise(documents: DataFrame, key: bytes, restore: bool = False, column: str = "pii") -> DataFrame:
    """Replace private data in every whole text (or restore it, with the same key).

    Returns the columns of ``documents`` with text replaced, plus ``column``: an
    array of (kind, start, end) in code points of the text given. A null text stays
    null with no finds; an empty table stays empty; repeated rows stay; a column of
    the input that has that name is overwritten, all others pass as they are.
    Values that only look private (a false check digit, the 31st of February)
    stay. One value in two notations (5.3.1980 and 05.03.1980) has two pseudonyms.
    Narrow: no shuffle and no table of values.
    """
    new = fresh(documents, "pseudonymised")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    one = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())

    def replace(part: pa.RecordBatch) -> list:
        p = pseudonymiser(key)
        done = [p.apply(t, restore) for t in texts_of(part)]
        absent = part.column(part.schema.get_field_index("text")).is_null().to_pylist()
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]
        return [[None if a else t for a, (t, _) in zip(absent, done, strict=True)], found]

    fields = [(new, pa.string(), T.StringType()), (column, arrow, T.ArrayType(one))]
    out = appended(documents, fields, replace)
    names = [c for c in documents.columns if c != column]
    return out.select(*[F.col(new).alias(c) if c == "text" else F.col(quoted(c)) for c in names], F.col(quoted(column)))
