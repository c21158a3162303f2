"""Operator 6: personal data by format-preserving Feistel pseudonyms.

Detectors find e-mail addresses, phone, card, account and social-security numbers, IPv4 and IPv6 addresses and dates, and check
them (Luhn, mod 97, calendar, country codes, ranges). What passes is brought to a normal form, so that two spellings of a value
are one, and permuted within its format by a keyed Feistel network with cycle walking: a card number becomes another valid card
number, a date another date, an address another address, written the way the original was. The permutation of a format is one
cycle through all its values, so none is its own pseudonym. Equal values become equal pseudonyms in every document, so links
survive; without the key nothing leads back. Per row, one pass, no exchange.

The key is no part of the program: it is an argument here, and ``deployment_key`` finds or makes the one of a deployment.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import os
import re
import secrets
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_others, give_back, shared_dir

ROUNDS = 8
#: Spark setting and environment variable that hold the key, in hexadecimal.
KEY_SETTING, KEY_VARIABLE = "spark.docloom.pii.key", "DOCLOOM_PII_KEY"
#: Dates move within these years.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "ip6", "date")
#: Values whose pseudonyms a Python worker remembers; the memory is emptied when full.
CACHE_VALUES = 50_000

# Month names, and country calling codes of one and two digits (all others have three).
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
}
ONE_DIGIT_CODES = frozenset("1 7".split())
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def deployment_key(spark: SparkSession, name: str = "pii.key") -> bytes:
    """The key of this deployment: from the Spark setting, the environment, or a file in the shared folder.

    Where none is set, a random key is made once and kept in the shared folder, so that runs over the same folder agree and
    nobody without access to it can lead pseudonyms back.
    """
    given = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING) or os.environ.get(KEY_VARIABLE)
    if given:
        return bytes.fromhex(given)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom/{name}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        draft = jvm.org.apache.hadoop.fs.Path(f"{where}.{secrets.token_hex(8)}")
        out = files.create(draft, False)
        out.write(bytearray(secrets.token_hex(32).encode()))
        out.close()
        files.setPermission(draft, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if not files.rename(draft, where):  # another driver was first
            files.delete(draft, False)
    stream = files.open(where)
    try:
        return bytes.fromhex(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


class Feistel:
    """A keyed permutation of 0 .. size - 1: balanced Feistel rounds over the next even number of bits, walked into range."""

    def __init__(self, key: bytes, size: int, tweak: bytes = b""):
        self.size = size
        self.half = max(1, ((max(2, size) - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(tweak + bytes([r]), key=key[:64], digest_size=16).digest() for r in range(ROUNDS)]

    def _f(self, r: int, x: int) -> int:
        digest = hashlib.blake2b(x.to_bytes(-(-self.half // 8) or 1, "big"), key=self.keys[r], digest_size=-(-self.half // 8)).digest()
        return int.from_bytes(digest, "big") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for r in range(ROUNDS):
            left, right = right, left ^ self._f(r, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for r in reversed(range(ROUNDS)):
            left, right = right ^ self._f(r, left), left
        return left << self.half | right

    def encrypt(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def decrypt(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


class OneCycle:
    """A keyed permutation of 0 .. size - 1 that is a single cycle: steps of a keyed length in the order a Feistel network deals.

    No value of two or more is its own image, and walking on from values outside a subset gives a permutation of the subset
    with the same property.
    """

    def __init__(self, key: bytes, size: int, tweak: bytes = b""):
        self.size = size
        self.order = Feistel(key, size, tweak)
        step = int.from_bytes(hashlib.blake2b(tweak + b"/step", key=key[:64], digest_size=32).digest(), "big") % max(1, size - 1) + 1
        while math.gcd(step, size) != 1:
            step = step % max(1, size - 1) + 1
        self.step = step

    def encrypt(self, x: int) -> int:
        return self.order.decrypt((self.order.encrypt(x) + self.step) % self.size)

    def decrypt(self, x: int) -> int:
        return self.order.decrypt((self.order.encrypt(x) - self.step) % self.size)


def luhn_digit(body: str) -> int:
    """The last digit that makes ``body`` and it pass Luhn's test."""
    total = 0
    for i, c in enumerate(reversed(body)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def iban_ok(text: str) -> bool:
    plain = re.sub(r"\s", "", text)
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _refill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def american(national: str) -> bool:
    """Whether ten digits are a number of the North American plan."""
    return len(national) == 10 and national[0] >= "2" and national[3] >= "2"


# Shapes of what is looked for.
_MONTH_NAMES = "|".join(sorted({n for names in MONTHS.values() for n in names}, key=len, reverse=True))
_DATE = (
    r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
    rf"|(?i:\d{{1,2}}(?:st|nd|rd|th|\.|er)? (?:de |of )?(?:{_MONTH_NAMES})\.?,? (?:de |del )?\d{{4}}|(?:{_MONTH_NAMES})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})"
)
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    rf"|(?P<date>(?<![\w./-])(?:{_DATE})(?![\w/-]|\.\d))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+(?!1\D)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)"
    r"|(?<![\w.+-])[2-9]\d{2} [2-9]\d{2} \d{4}(?![\w]| ?\d|[.-]\d)|(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?![\w]|[.-]\d))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))"
)
_MAYBE = re.compile(r"@|\d")


@dataclass
class Pseudonymizer:
    key: bytes
    kinds: tuple[str, ...] = KINDS

    def __post_init__(self):
        if len(self.key) < 1:
            raise ValueError("a key is needed")
        self._permutations: dict[tuple[str, int], OneCycle] = {}
        self._known: dict[tuple[str, str], str | None] = {}

    def permutation(self, kind: str, size: int) -> OneCycle:
        if (kind, size) not in self._permutations:
            if len(self._permutations) > CACHE_VALUES:
                self._permutations.clear()
            self._permutations[kind, size] = OneCycle(self.key, size, f"{kind}/{size}".encode())
        return self._permutations[kind, size]

    def _digits(self, kind: str, digits: str) -> str:
        if not digits:
            return digits
        return str(self.permutation(kind, 10 ** len(digits)).encrypt(int(digits))).zfill(len(digits))

    def email(self, text: str) -> str:
        """The part before @ keeps its length and its signs; letters and digits are permuted as one number. The domain stays."""
        local, _, domain = text.partition("@")
        alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
        body = [c for c in local.lower() if c in alphabet]
        value = 0
        for c in body:
            value = value * 36 + alphabet.index(c)
        value = self.permutation("email", 36 ** len(body)).encrypt(value)
        out = []
        for _ in body:
            value, r = divmod(value, 36)
            out.append(alphabet[r])
        it = iter(reversed(out))
        return "".join(next(it) if c.lower() in alphabet else c for c in local) + "@" + domain

    def phone(self, text: str) -> str | None:
        """The country code stays, the national number is permuted; ten digits without a country code are North American.

        However it is written, a number has one pseudonym. Numbers of the North American plan stay such numbers.
        """
        digits = re.sub(r"\D", "", text)
        code = ""
        if text[0] == "+":
            code = digits[: 1 if digits[0] in ONE_DIGIT_CODES else 2 if digits[:2] in TWO_DIGIT_CODES else 3]
            if digits[0] == "0" or not 7 <= len(digits) <= 15:
                return None
        national = digits[len(code) :]
        kind = f"phone/{code or '1'}"
        new = self._digits(kind, national)
        if code in ("", "1") and len(national) == 10:
            while american(new) != american(national):
                new = self._digits(kind, new)
        return _refill(text, code + new)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = digits[0] + self._digits("card", digits[1:-1])
        return _refill(text, body + str(luhn_digit(body)))

    def iban(self, text: str) -> str | None:
        if not iban_ok(text):
            return None
        plain = re.sub(r"\s", "", text)
        body = _refill(plain[4:], self._digits("iban", re.sub(r"\D", "", plain[4:])))
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        it = iter(plain[:2] + f"{check:02d}" + body)
        return "".join(c if c.isspace() else next(it) for c in text)

    def ssn(self, text: str) -> str | None:
        area, group, serial = text.split("-")
        if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        index = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
        index = self.permutation("ssn", len(areas) * 99 * 9999).encrypt(index)
        return f"{areas[index // (99 * 9999)]:03d}-{index // 9999 % 99 + 1:02d}-{index % 9999 + 1:04d}"

    def ip(self, text: str) -> str | None:
        """Each octet is permuted by a key of the octets before it, so that networks stay networks."""
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        return ".".join(str(self.permutation(f"ip/{'.'.join(parts[:i])}", 256).encrypt(int(p))) for i, p in enumerate(parts))

    def ip6(self, text: str) -> str | None:
        """Each group that is not zero is permuted by a key of the groups before it; zero groups stay."""
        try:
            groups = ipaddress.IPv6Address(text).exploded.split(":")
        except ValueError:
            return None
        if sum(g != "0000" for g in groups) < 2:
            return None
        new = [g if g == "0000" else f"{self.permutation(f'ip6/{':'.join(groups[:i])}', 0xFFFF).encrypt(int(g, 16) - 1) + 1:04x}" for i, g in enumerate(groups)]
        shown = text.split("::")
        before, after = (shown[0].split(":") if shown[0] else []), (shown[1].split(":") if len(shown) > 1 and shown[1] else [])

        def like(written: list[str], values: list[str]) -> str:
            out = [v if len(w) == 4 and w[0] == "0" or v == "0000" and len(w) == 4 else v.lstrip("0") or "0" for w, v in zip(written, values, strict=True)]
            return ":".join(out).upper() if text.upper() == text and text.lower() != text else ":".join(out)

        head = like(before, new[: len(before)])
        return head if len(shown) == 1 else f"{head}::{like(after, new[8 - len(after) :])}"

    def date(self, text: str) -> str | None:
        """A day of another date, written the same way: order, signs, zeros, and the language and length of a month's name."""
        fields = re.findall(r"\d+", text)
        name = re.search(_MONTH_NAMES, text, re.I)
        if name:
            spoken = next(k for k, names in MONTHS.items() if name[0].lower() in names)
            d, m, y = int(fields[0]), MONTHS[spoken].index(name[0].lower()) + 1, int(fields[1])
            order = None
        else:
            order = ("y", "m", "d") if len(fields[0]) == 4 else ("d", "m", "y") if "." in text else ("m", "d", "y")
            if order[0] == "m" and int(fields[0]) > 12 >= int(fields[1]):
                order = ("d", "m", "y")
            value = dict(zip(order, map(int, fields), strict=True))
            y, m, d = value["y"], value["m"], value["d"]
        try:
            day = dt.date(y, m, d)
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        days = self.permutation("date", (LAST_DAY - FIRST_DAY).days + 1).encrypt((day - FIRST_DAY).days)
        new = FIRST_DAY + dt.timedelta(days=days)
        if order is None:
            word = MONTHS[spoken][new.month - 1]
            word = word.upper() if name[0].isupper() else word.capitalize() if name[0][0].isupper() else word
            out = text[: name.start()] + "\0" + text[name.end() :]
            numbers = iter((str(new.day), f"{new.year:04d}"))
            return re.sub(r"\d+", lambda _: next(numbers), out).replace("\0", word)
        short = any(len(f) == 1 for f in fields)
        parts = {"y": f"{new.year:04d}", "m": str(new.month) if short else f"{new.month:02d}", "d": str(new.day) if short else f"{new.day:02d}"}
        numbers = iter(parts[o] for o in order)
        return re.sub(r"\d+", lambda _: next(numbers), text)

    def pseudonym(self, kind: str, text: str) -> str | None:
        """The stand-in of one value; None where the value fails its checks."""
        known = self._known.get((kind, text), "")
        if known == "":
            if len(self._known) > CACHE_VALUES:
                self._known.clear()
            known = self._known[kind, text] = getattr(self, kind)(text)
        return known

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kind of each value replaced, in order."""
        if not _MAYBE.search(text):
            return text, []
        found: list[str] = []

        def sub(m: re.Match) -> str:
            kind = m.lastgroup
            new = self.pseudonym(kind, m[0]) if kind in self.kinds else None
            if new is None and kind in ("card", "phone", "iban") and " " in m[0]:
                head, _, rest = m[0].partition(" ")  # a shorter value may stand inside
                return _PATTERN.sub(sub, head) + " " + _PATTERN.sub(sub, rest)
            if new is None:
                return m[0]
            found.append(kind)
            return new

        return _PATTERN.sub(sub, text), found


def pseudonymize(docs: DataFrame, key: bytes, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, plus ``n_pii`` and ``pii_kinds`` (array, in order of place).

    Edge cases: null texts stay null and empty ones empty, with no values; equal texts give equal rows; a value that fails
    its checks stays as it is; an empty table gives an empty result. Columns n_pii, pii_kinds and _pii of the input are
    replaced.
    """
    worker = Pseudonymizer(key, kinds)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if t is None else worker.replace(t) for t in texts]
        forget_others(__name__)
        give_back()
        return pd.DataFrame({"text": [t for t, _ in rows], "kinds": [k for _, k in rows]})

    keep = [c for c in docs.columns if c not in ("n_pii", "pii_kinds", "_pii")]
    done = docs.select(*keep).withColumn("_pii", F.pandas_udf(run, "text string, kinds array<string>")(F.col("text")))
    columns = [F.col("_pii.text").alias("text") if c == "text" else F.col(c) for c in keep]
    return done.select(*columns, F.size("_pii.kinds").alias("n_pii"), F.col("_pii.kinds").alias("pii_kinds"))
