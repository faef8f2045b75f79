"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their kind's check (Luhn, mod 97, octets, calendar, ..) are replaced by
others of the same format that pass it too. The replacement is a keyed permutation of all valid
values of that format, so that equal values stay equal across documents, different ones stay
different, and whoever holds the key can go back.
"""

import datetime
import hashlib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lanewise.llm.common import annotate

ROUNDS = 10
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Permutation:
    """A keyed permutation of 0 .. n-1: a Feistel network on two unequal halves, walked until inside."""

    def __init__(self, key: bytes, n: int, tweak: str):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.n = n
        self.low = math.isqrt(n - 1) + 1 if n > 1 else 1
        self.high = -(-n // self.low)
        self.tweak = f"{tweak}:{n}".encode()

    def _pad(self, k: int, half: int, size: int) -> int:
        data = b"%d:%d:" % (k, half) + self.tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=48).digest(), "big") % size

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.low)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                b = (b + sign * self._pad(k, a, self.low)) % self.low
            else:
                a = (a + sign * self._pad(k, b, self.high)) % self.high
        return a * self.low + b

    def __call__(self, x: int, ok: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The image of ``x``; with ``ok``, the permutation of those values for which it holds."""
        while True:
            x = self._once(x, back)
            if x < self.n and (ok is None or ok(x)):
                return x


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` + digit pass."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{body}{country}00".upper()))
    return f"{98 - number % 97:02d}"


def valid_nanp(x: str) -> bool:
    return x[0] in "23456789" and x[3] in "23456789"


def valid_ssn(x: str) -> bool:
    return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"


def borders(text: str, inside: str) -> list[int]:
    """Lengths, falling, at which a run of characters of ``inside`` ends before the text does."""
    return [i for i in range(len(text) - 1, 0, -1) if text[i] not in inside and text[i - 1] in inside]


def refill(shape: str, chars: str, inside: str) -> str:
    """``shape`` with its characters out of ``inside`` replaced in turn by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c in inside else c for c in shape)


def swap_characters(text: str, key: bytes, kind: str) -> str:
    """Permutes ASCII letters and digits, each within its class, all of them as one number."""
    classes = [next((s for s in (DIGITS, LOWER, LOWER.upper()) if c in s), c) for c in text]
    sizes = [len(s) for s in classes]
    x = 0
    for c, s, n in zip(text, classes, sizes, strict=True):
        x = x * n + s.index(c)
    shape = "".join(s[0] for s in classes)
    x = Permutation(key, math.prod(sizes), f"{kind}:{shape}")(x)
    out = []
    for s, n in zip(reversed(classes), reversed(sizes), strict=True):
        x, d = divmod(x, n)
        out.append(s[d])
    return "".join(reversed(out))


def swap_hex(text: str, key: bytes, kind: str) -> str:
    x = Permutation(key, 16 ** len(text), kind)(int(text, 16))
    out = f"{x:0{len(text)}x}"
    return out.upper() if text.upper() == text else out


def swap_number(digits: str, key: bytes, kind: str, ok=None) -> str:
    n = len(digits)
    inside = None if ok is None else lambda x: ok(f"{x:0{n}d}")
    return f"{Permutation(key, 10**n, kind)(int(digits), inside):0{n}d}"


#: A word right before a number that makes it an account; one that makes four numbers with dots a version.
ACCOUNT = (
    r"(?:accounts?|acct|a/c|cards?|konto|kreditkarte|karte|compte|carte|cuenta|tarjeta)"
    r"(?:[ .:#-]{1,3}(?:no|nr|num|number|nummer|numero|id|is))?[ .:#=-]{1,4}"
)
CUE_CHARS = 20
VERSION = re.compile(r"(?:\bv|\bver|version|release|build)\W{0,3}\Z", re.IGNORECASE)

# Each function gets the match and the key and returns the new text, or None if the check fails.


def card(m: re.Match, key: bytes) -> str | None:
    d = "".join(c for c in m[0] if c in DIGITS)
    if luhn_digit(d[:-1]) != d[-1]:
        # A card with more digits behind it is the same card as elsewhere; the rest goes too.
        for n in borders(m[0], DIGITS):
            head = "".join(c for c in m[0][:n] if c in DIGITS)
            if len(head) >= 13 and luhn_digit(head[:-1]) == head[-1]:
                rest = swap_number(d[len(head) :], key, "rest")
                return card(ANY.match(m[0], 0, n), key) + refill(m[0][n:], rest, DIGITS)
        return None
    else:
        body = swap_number(d[:-1], key, "card")
        new = body + luhn_digit(body)
    return refill(m[0], new, DIGITS)


def account(m: re.Match, key: bytes) -> str | None:
    """A number that a word calls an account and that is no card: another that is none."""
    value = m["account_value"]
    d = "".join(c for c in value if c in DIGITS)
    if luhn_digit(d[:-1]) == d[-1] or card(ANY.match(value), key):
        return None
    new = swap_number(d, key, "account", lambda x: luhn_digit(x[:-1]) != x[-1])
    return m["account_head"] + refill(value, new, DIGITS)


def phone(m: re.Match, key: bytes) -> str | None:
    d = "".join(c for c in m[0] if c in DIGITS)
    plus = m[0].startswith("+")
    if not (8 if plus else 10) <= len(d) <= 15:
        return None
    # The leading digit of an international number, its zone, stays.
    head, tail = (d[:1], d[1:]) if plus or len(d) == 11 else ("", d)
    nanp = len(tail) == 10 and head in ("", "1") and valid_nanp(tail)
    new = head + swap_number(tail, key, "nanp" if nanp else "phone", valid_nanp if nanp else None)
    return refill(m[0], new, DIGITS)


def ssn(m: re.Match, key: bytes) -> str | None:
    d = m[0].replace("-", "")
    return refill(m[0], swap_number(d, key, "ssn", valid_ssn), DIGITS) if valid_ssn(d) else None


def iban(m: re.Match, key: bytes) -> str | None:
    d = m[0].replace(" ", "")
    if not 15 <= len(d) <= 34 or iban_digits(d[:2], d[4:]) != d[2:4]:
        return None
    body = swap_characters(d[4:], key, f"iban:{d[:2]}")
    return refill(m[0], d[:2] + iban_digits(d[:2], body) + body, DIGITS + LOWER.upper())


def ip(m: re.Match, key: bytes) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    if VERSION.search(m.string, max(0, m.start() - CUE_CHARS), m.start()):
        return None
    x = Permutation(key, 1 << 32, "ip")(int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def date(m: re.Match, key: bytes) -> str | None:
    text = m[0]
    sep = next(c for c in text if c not in DIGITS)
    parts = text.split(sep)
    iso = len(parts[0]) == 4
    # With slashes both orders are in use: day first, unless only month first is a date.
    orders = [(0, 1, 2)] if iso else [(2, 1, 0), (2, 0, 1)] if sep == "/" else [(2, 1, 0)]
    for order in orders:
        try:
            day = datetime.date(*[int(parts[i]) for i in order])
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        n = (LAST_DAY - FIRST_DAY).days + 1
        new = FIRST_DAY + datetime.timedelta(Permutation(key, n, "date")((day - FIRST_DAY).days))
        out = [""] * 3
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            out[i] = f"{v:0{len(parts[i])}d}"
        return sep.join(out)
    return None


def email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{swap_characters(local, key, f'email:{domain.lower()}')}@{domain}"


def access_key(m: re.Match, key: bytes) -> str | None:
    return m[0][:4] + swap_characters(m[0][4:], key, "access key")


def secret(m: re.Match, key: bytes) -> str | None:
    head, value = m["secret_head"], m["secret_value"]
    hexa = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)
    return head + (swap_hex(value, key, "secret") if hexa else swap_characters(value, key, "secret"))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    swap: Callable[[re.Match, bytes], str | None]


#: Borders of ASCII words: what stands directly against other scripts or accented letters counts too.
WORD = "A-Za-z0-9_"
BEFORE, AFTER = f"(?<![{WORD}])", f"(?![{WORD}])"
#: Where a match whose check fails may end instead, see ``cuts``.
ANY = re.compile("(?s).+")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24"
        " FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21"
        " LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22"
        " RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}

#: In order of priority where two begin at the same place.
KINDS = (
    Kind("email", rf"(?<![{WORD}.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}", email),
    Kind("access_key", rf"{BEFORE}A(?:KIA|SIA)[0-9A-Z]{{16}}{AFTER}", access_key),
    Kind(
        "secret",
        rf"(?P<secret_head>{BEFORE}(?:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?[\"']?)(?P<secret_value>[A-Za-z0-9_\-]{{8,}})",
        secret,
    ),
    Kind("iban", rf"{BEFORE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{AFTER}", iban),
    Kind("ip", rf"(?<![{WORD}.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\.?[0-9]){AFTER}", ip),
    Kind("date", rf"(?<![{WORD}/.-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?=T[0-9])|(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}([/.])[0-9]{{1,2}}\1[0-9]{{4}})(?![{WORD}/-]))", date),
    Kind("ssn", rf"(?<![{WORD}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{WORD}-])", ssn),
    Kind("account", rf"(?P<account_head>{BEFORE}(?i:{ACCOUNT}))(?P<account_value>[0-9](?:[ -]?[0-9]){{12,18}})(?![{WORD}-])", account),
    Kind("card", rf"(?<![{WORD}+-])[0-9](?:[ -]?[0-9]){{12,18}}(?![{WORD}-])", card),
    Kind(
        "phone",
        rf"(?<![{WORD}+])(?:\+[0-9](?:[ .-]?\(?[0-9]{{1,4}}\)?){{2,6}}|\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}){AFTER}",
        phone,
    ),
)


def _combined() -> re.Pattern:
    out, before = [], 0
    for kind in KINDS:
        # Numbered references move by the groups in front of them, the kind's own included.
        shifted = re.sub(r"\\1", lambda m, n=before + 2: f"\\{n}", kind.pattern)
        out.append(f"(?P<{kind.name}>{shifted})")
        before += 1 + re.compile(kind.pattern).groups
    return re.compile("|".join(out))


PATTERN = _combined()
#: A text with neither has nothing to replace but a secret, which follows one of these marks.
GATE = re.compile(r"[0-9@]|[=:]\s?[\"']?[A-Za-z0-9_\-]{8}")
BY_NAME = {k.name: k.swap for k in KINDS}


#: Kinds that may stand where one of higher priority fails its check.
ALONE = [(k.name, re.compile(k.pattern)) for k in KINDS]


def cuts(kind: str, text: str) -> list[int]:
    """Lengths shorter than ``text`` at which it may still be of its kind: IBANs in front of other words."""
    if kind != "iban":
        return []
    ends = borders(text, DIGITS + LOWER.upper())
    known = IBAN_LENGTHS.get(text[:2])
    return [n for n in ends if known in (None, n - text.count(" ", 0, n))]


def replacement(text: str, m: re.Match, key: bytes) -> tuple[str, int, str] | None:
    """The kind of what begins where ``m`` does, its end and what replaces it; None if every check fails."""
    at, first = m.start(), next(i for i, k in enumerate(KINDS) if m[k.name] is not None)
    for name, pattern in ALONE[first:]:
        own = pattern.match(text, at)
        if own is None:
            continue
        new = BY_NAME[name](own, key)
        if new is not None:
            return name, own.end(), new
        for n in cuts(name, own[0]):
            new = BY_NAME[name](ANY.match(text, at, at + n), key)
            if new is not None:
                return name, at + n, new
    return None


def pseudonymise(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with replacements and the kinds of what was replaced, in order."""
    if not GATE.search(text):
        return text, []
    found: list[str] = []
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        hit = replacement(text, m, key)
        if hit is None:  # something else may begin inside
            at = m.start() + 1
            continue
        kind, at, new = hit
        found.append(kind)
        out += [text[done : m.start()], new]
        done = at
    return "".join([*out, text[done:]]), found


FIELDS = [T.StructField("new_text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]


def replace_pii(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """``row`` (the input), ``new_text`` and ``kinds`` (one entry for each replacement, in order).

    Emails, access keys, secrets, IBANs, IPv4 addresses, dates, social security numbers, card and
    account numbers and phone numbers of the whole text; what fails its kind's check stays. A null
    text stays null; repeated rows change alike; no rows give no rows.
    """

    def make():
        def run(texts):
            done = [(None, []) if t is None else pseudonymise(t.decode(), key) for t in texts]
            return [d[0] for d in done], [d[1] for d in done]

        return run

    return annotate(docs, column, make, FIELDS)


def without_pii(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """The documents, all columns, with ``column`` replaced."""
    cols = ["new_text" if c == column else f"row.`{c}`" for c in docs.columns]
    return replace_pii(docs, key, column).select(cols).toDF(*docs.columns)
