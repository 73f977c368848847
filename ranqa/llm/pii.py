"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses in texts.

A value that passes its check (Luhn, mod 97, octets, calendar, number plan) is read as a number below the count of valid
values of its format, permuted by a keyed Feistel network with cycle walking, and written back in the same format.
Equal values get equal pseudonyms in every document, whatever their separators; different values of a kind stay
different; the key's owner can invert them.  Check digits are computed anew, so pseudonyms validate, and
lengths do not change.

=======  ===========================================  ===============================================
kind     found and checked                            permuted
=======  ===========================================  ===============================================
email    local part, domain with a dot                ASCII letters and digits of the local part
phone    +1 (ddd) ddd-dddd and its usual variants     the ten digits
card     13-19 digits, plain or grouped, Luhn         all digits but the last, which is computed
ssn      ddd-dd-dddd, number ranges in use            the number among those in use
iban     country, mod 97, plain or in groups of four  the account part by character class
ip       four octets up to 255                        32 bits
date     yyyy-mm-dd (a time may follow after T),      the day, 1900 to 2099
         dd.mm.yyyy, mm/dd/yyyy
=======  ===========================================  ===============================================

Values that fail their check stay as they are, and so do numbers in other than ASCII digits, phone numbers whose groups
are parted by spaces only or that belong to other number plans, and IBANs in groups of countries without a length below.  Defined results: null text
stays null with no findings; empty and long texts are scanned whole; repeated rows get the same result; an empty table
gives no row; all columns are carried through.  One pass, no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from functools import lru_cache
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranqa.llm.common import append_columns, free_name, table

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

FINDER = re.compile(r"""
    (?P<email>(?<![\w.+%-])[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,}(?!\w))
  | (?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?!\w))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!(?!T[0-9]{2}:)[\w/-]|\.[0-9]))
  | (?P<ip>(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\w|\.[0-9]))
  | (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ ][A-Z0-9]{4}){2,7}(?:[ ][A-Z0-9]{1,4})?)(?!\w))
  | (?P<card>(?<!\w)(?:[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w))
""", re.VERBOSE)


# Characters of a country's IBAN, which end one that is written in groups.
IBAN_LENGTHS = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
                "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
                "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
                "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}


class Feistel:
    """Keyed permutation of the numbers below ``n``, one for every kind."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, kind: str, n: int, i: int, x: int) -> int:
        data = f"{kind}|{n}|{i}|{x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def apply(self, kind: str, x: int, n: int, back: bool = False) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:  # cycle walking: a * b exceeds n by less than a
            hi, lo = divmod(x, b)
            for i in range(ROUNDS)[::-1 if back else 1]:
                sign = -1 if back else 1
                if i % 2 == 0:
                    hi = (hi + sign * self._round(kind, n, i, lo)) % a
                else:
                    lo = (lo + sign * self._round(kind, n, i, hi)) % b
            x = hi * b + lo
            if x < n:
                return x


def luhn(digits: str) -> int:
    """Check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _by_class(perm, kind: str, text: str) -> str:
    """Permute letters and digits of ``text`` within their classes, as one mixed-radix number."""
    pools = [next((p for p in (LOWER, UPPER, DIGITS) if c in p), None) for c in text]
    x, n = 0, 1
    for c, p in zip(text, pools):
        if p:
            x, n = x * len(p) + p.index(c), n * len(p)
    shape = "".join("-" if p is None else p[0] for p in pools)
    x = perm(f"{kind}:{shape}", x, n)
    out = []
    for c, p in zip(reversed(text), reversed(pools)):
        if p:
            x, d = divmod(x, len(p))
            c = p[d]
        out.append(c)
    return "".join(reversed(out))


def _refill(old: str, digits: str) -> str:
    """``old`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in old)


def _iban_mod(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


DATES = (("%Y-%m-%d", re.compile(r"[0-9]{4}-")), ("%d.%m.%Y", re.compile(r"[0-9]{2}\.")), ("%m/%d/%Y", re.compile(r"[0-9]{2}/")))


def pseudonym(kind: str, value: str, perm) -> str | None:
    """Pseudonym of a found value, None when it fails its check."""
    digits = "".join(c for c in value if c in DIGITS)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return f"{_by_class(perm, kind, local)}@{domain}"
    if kind == "phone":
        prefix = value[: len(value) - len(value.lstrip("+1 .-"))] if len(digits) == 11 else ""
        rest = value[len(prefix):]
        number = "".join(c for c in rest if c in DIGITS)
        return prefix + _refill(rest, f"{perm(kind, int(number), 10 ** 10):010d}") if len(number) == 10 else None
    if kind == "card":
        if luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = f"{perm(kind, int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
        return _refill(value, body + str(luhn(body)))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        rank = area - 1 - (area > 666)
        x = perm(kind, (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        x, serial = divmod(x, 9999)
        rank, group = divmod(x, 99)
        return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "date":
        form = next(f for f, p in DATES if p.match(value))
        try:
            day = datetime.datetime.strptime(value, form).date().toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + perm(kind, day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        return new.strftime(form)
    if kind == "ip":
        octets = [int(o) for o in value.split(".")]
        if max(octets) > 255 or value != ".".join(map(str, octets)):
            return None
        return _same_widths(octets, perm)
    plain = value.replace(" ", "")  # iban
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if _iban_mod(country, check, account) != 1:
        return None
    account = _by_class(perm, f"{kind}:{country}", account)
    it = iter(f"{country}{98 - _iban_mod(country, '00', account):02d}{account}")
    return "".join(c if c == " " else next(it) for c in value)


def _own_part(kind: str, value: str) -> str:
    """What of a match is the value: an IBAN in groups ends where its country's length does."""
    if kind != "iban" or " " not in value:
        return value
    n = IBAN_LENGTHS.get(value[:2], 0)
    end = n + (n - 1) // 4 if n else len(value) + 1
    return value[:end] if end == len(value) or value[end:end + 1] == " " else ""


#: octets by their number of digits
WIDTHS = {1: range(0, 10), 2: range(10, 100), 3: range(100, 256)}


def _same_widths(octets: list[int], perm) -> str:
    """The address permuted among those whose octets have the same numbers of digits."""
    pools = [WIDTHS[len(str(o))] for o in octets]
    x, n = 0, 1
    for o, p in zip(octets, pools):
        x, n = x * len(p) + o - p[0], n * len(p)
    x = perm("ip:" + "".join(str(len(str(o))) for o in octets), x, n)
    out = []
    for p in reversed(pools):
        x, d = divmod(x, len(p))
        out.append(str(p[d]))
    return ".".join(reversed(out))


class Pseudonymiser:
    """Replaces the values of a text; remembers recent ones."""

    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key)
        self.one = lru_cache(maxsize=100_000)(
            lambda kind, value: pseudonym(kind, value, lambda k, x, n: feistel.apply(k, x, n, back)))

    def text(self, text: str) -> tuple[str, list[dict]]:
        found: list[dict] = []
        out: list[str] = []
        done = at = 0
        while m := FINDER.search(text, at):
            kind = m.lastgroup if m.lastgroup != "sep" else "card"
            value = _own_part(kind, m.group())
            new = self.one(kind, value) if value else None
            # groups that are no IBAN may begin another value: "AB12 4845 1681 1440 7329"
            at = m.start() + 4 if kind == "iban" and " " in m.group() else m.end()
            if new is not None:
                at = m.start() + len(value)
                out += [text[done:m.start()], new]
                found.append({"kind": kind, "start": m.start(), "length": len(new)})
                done = at
        return "".join([*out, text[done:]]), found


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("length", T.LongType())]))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with the values of ``text`` replaced, plus ``pii``: the kind and 0-based place of each.

    ``back`` inverts the pseudonyms of the same key.
    """
    new = free_name("__text", docs)
    schema = T.StructType([T.StructField(new, T.StringType()), T.StructField("pii", FOUND)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def make():
        p = Pseudonymiser(key, back)

        def run(texts: pa.Array) -> list[pa.Array]:
            maybe = pc.match_substring_regex(pc.fill_null(texts, ""), "[0-9@]").to_pylist()
            got = [p.text(t.as_py()) if m else (t.as_py(), []) for t, m in zip(texts, maybe)]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], arrow)]
        return run

    out = append_columns(docs, [text], schema, make)
    return out.select(*[F.col(new).alias(text) if c == text else F.col(f"`{c}`")
                        for c in docs.columns if c.lower() != "pii"], "pii")


#: setting that holds the key; the default serves tests and must be replaced where pseudonyms matter
KEY_SETTING, DEFAULT_KEY = "ranqa.pii.key", "not a secret"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of each kind were replaced."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms come from the public default key and protect nothing", stacklevel=2)
        key = DEFAULT_KEY
    key = key.encode()
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    kinds = ("email", "phone", "card", "ssn", "iban", "ip", "date")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), *map(count, kinds))
