"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (Luhn, mod 97, calendar, octet and numbering-plan rules) and mapped to their index among
all valid values of the same format; a keyed Feistel network permutes the indices, and the index it gives is written back in
the same format. Equal values therefore get equal pseudonyms in all documents, different ones never share one, and a pseudonym
passes the same validation. A value that fails validation is no personal data and stays.

Formats: card numbers, IBANs, US social security numbers, phone numbers, IPv4 addresses, dates of 1900 to 2099 (one day has one
pseudonym in every notation), e-mail addresses (letters and digits before the top-level domain), access keys and the values of
password-like settings. Days up to the 9th, to the 12th and later ones, and months up to September and later ones, are permuted among
themselves, so a date in numbers keeps its length and is read in the same order after as before, and different days never meet. Phone
numbers keep their country's code and are permuted by their digits, so one number has one pseudonym in every notation. What looks like an
IBAN is tried without its last groups too, as a word in capitals may follow.

The key comes from the caller, or from the setting spark.shoal.pii.key; without either a run draws a key of its own and forgets it,
so its pseudonyms link values within that run alone and nobody can turn them back.

Null and empty texts stay as they are. Rows are judged one by one, repeated ones alike; there is nothing to tie. A text is scanned
whole, however long. An empty table gives an empty table. Other columns ride along, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from shoal.llm.shared import table

KEY_SETTING = "spark.shoal.pii.key"
ROUNDS = 8
KINDS = ("email", "iban", "secret", "ip", "date", "ssn", "card", "phone")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + "|sept"
_DAYS = [datetime.date.fromordinal(n) for n in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())]
_CLASS = lambda d: (d.day > 9) + (d.day > 12) + 3 * (d.month > 9)  # noqa: E731  numbers of digits, and whether the day tells the order of a date in numbers
_CLASSES = [[d for d in _DAYS if _CLASS(d) == k] for k in range(6)]
_PLACE = {d: i for days in _CLASSES for i, d in enumerate(days)}
# The calling codes of two digits; 1 and 7 are the only ones of one digit, all others have three.
_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+%-]{{0,62}}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,24}}(?![\w-]))
  | (?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,4}})?(?!\w))
  | (?P<secret>(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{{16}}(?!\w)|(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:["']?[ ]?[=:][ ]?["']?)[A-Za-z0-9_+/-]{{8,}}|(?<=")[0-9a-f]{{32,64}}(?="))
  | (?P<ip>(?<![\w.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\w|\.[0-9]))
  | (?P<date>(?<![\w/.-])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?=[Tt][0-9]{{2}}(?::?[0-9]{{2}}|(?![0-9A-Za-z_])))
      |(?<![\w/.-])(?:[0-9]{{4}}(?P<sep1>[-/.])[0-9]{{2}}(?P=sep1)[0-9]{{2}}|[0-9]{{1,2}}(?P<sep2>[-/.])[0-9]{{1,2}}(?P=sep2)[0-9]{{4}})(?![\w/-]|\.[0-9])
      |(?<!\w)(?i:[0-9]{{1,2}}(?:st|nd|rd|th)?[ ](?:{_MONTH})\.?[ ,]+[0-9]{{4}}|(?:{_MONTH})\.?[ ][0-9]{{1,2}}(?:st|nd|rd|th)?,?[ ][0-9]{{4}})(?!\w))
  | (?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
  | (?P<card>(?<![\w.-])(?:[0-9]{{13,19}}|[0-9]{{4}}(?P<sep3>[ -])[0-9]{{4}}(?P=sep3)[0-9]{{4}}(?P=sep3)[0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?![\w-]))
  | (?P<phone>(?<![\w(])(?:\+1[ .-]?)?(?:\([1-9][0-9]{{2}}\)[ ]?|[1-9][0-9]{{2}}[ .-])[1-9][0-9]{{2}}[ .-][0-9]{{4}}(?!\w)|(?<!\w)\+[1-9][0-9]{{0,2}}[ .-]?(?:\(?[0-9]{{1,4}}\)?[ .-]?){{2,5}}[0-9]{{2,4}}(?!\w))
    """,
    re.X,
)
_CANDIDATE = re.compile(r"[0-9@]|AKIA|ASIA|(?i:passw|pwd|secret|token|key)|\"[a-f]{32}")  # what every alternative of PATTERN needs


def permute(index: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network on a * b >= size, walked until it lands inside."""
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(index, b)
        for r in range(ROUNDS):
            f = int.from_bytes(hashlib.blake2b(f"{tweak}:{size}:{r}:{right if r % 2 == 0 else left}".encode(), key=key, digest_size=16).digest(), "big")
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        index = left * b + right
        if index < size:
            return index


def _refill(text: str, symbols: list[str]) -> str:
    """Puts symbols into the places of the letters and digits of text."""
    left = iter(symbols)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _by_class(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Permutes the letters and digits of text among all strings with the same class at each place."""
    classes = {c: "0123456789abcdef" for c in "0123456789abcdef"} if hexadecimal else {}
    if not classes:
        for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            classes |= dict.fromkeys(s, s)
    places = [classes[c] for c in text if c in classes]
    index, size = 0, 1
    for c, s in zip((c for c in text if c in classes), places, strict=True):
        index, size = index * len(s) + s.index(c), size * len(s)
    index, out = permute(index, size, key, f"{tweak}:{'.'.join(str(len(s)) for s in places)}"), []
    for s in reversed(places):
        index, at = divmod(index, len(s))
        out.append(s[at])
    fill = iter(reversed(out))
    return "".join(next(fill) if c in classes else c for c in text)


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card")).zfill(len(d) - 1)
    return _refill(text, list(body + luhn_digit(body)))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _by_class(plain[4:], key, f"iban:{plain[:2]}")
    return _refill(text, list(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}"))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index = permute(index, 898 * 99 * 9999, key, "ssn")
    index, serial = divmod(index, 9999)
    area, group = divmod(index, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not text.startswith("+") or d[0] == "1":
        head, d = d[:-10], d[-10:]
        if len(head) > 1 or len(d) < 10 or d[0] == "0" or d[3] == "0":
            return None
        index = ((int(d[:3]) - 100) * 900 + int(d[3:6]) - 100) * 10_000 + int(d[6:])
        index, line = divmod(permute(index, 900 * 900 * 10_000, key, "phone"), 10_000)
        area, office = divmod(index, 900)
        return _refill(text, list(f"{head}{area + 100}{office + 100}{line:04d}"))
    if not 8 <= len(d) <= 15:
        return None
    code = 1 if d[0] == "7" else 2 if d[:2] in _CODES else 3
    rest = d[code:]
    return _refill(text, list(d[:code] + str(permute(int(rest), 10 ** len(rest), key, f"phone:{d[:code]}")).zfill(len(rest))))


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    parts = re.findall(r"[0-9]+|[A-Za-z]{3,}", text)
    words = [p for p in parts if p[0].isalpha()]
    try:
        if words:
            month = next(i for i, m in enumerate(_MONTHS, 1) if m[:3] == words[0][:3].lower())
            numbers = [int(p) for p in parts if p[0].isdigit()]
            order, day = "", datetime.date(numbers[1], month, numbers[0])
        else:
            a, b, c = map(int, parts)
            order = "ymd" if len(parts[0]) == 4 else "dmy" if b <= 12 else "mdy"
            day = datetime.date(*{"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[order])
    except (ValueError, StopIteration):
        return None
    if day not in _PLACE:
        return None
    days = _CLASSES[_CLASS(day)]
    new = days[permute(_PLACE[day], len(days), key, "date")]
    if not words:
        values = {"ymd": (new.year, new.month, new.day), "dmy": (new.day, new.month, new.year), "mdy": (new.month, new.day, new.year)}[order]
        return re.sub(r"[0-9]+", lambda m, left=iter(values): f"{next(left):0{len(m.group())}d}", text)
    whole = len(words[0]) > 3 and words[0].lower() != "sept" or month == 5
    month_word = _MONTHS[new.month - 1] if whole else _MONTHS[new.month - 1][:3]
    month_word = month_word.upper() if words[0].isupper() else month_word.capitalize() if words[0][0].isupper() else month_word
    suffix = "th" if 11 <= new.day % 100 <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    text = re.sub(r"(?i)(?<=[0-9])(st|nd|rd|th)(?![A-Za-z])", suffix, text)
    text = re.sub(r"[A-Za-z]{3,}", month_word, text, count=1)
    return re.sub(r"[0-9]+", lambda m, left=iter((new.day, new.year)): str(next(left)), text)


def _email(text: str, key: bytes) -> str:
    head, dot, top = text.rpartition(".")
    return _by_class(head, key, "email") + dot + top


def _secret(text: str, key: bytes) -> str:
    if text[:4] in ("AKIA", "ASIA") and len(text) == 20:
        return text[:4] + _by_class(text[4:], key, "secret")
    if re.fullmatch("[0-9a-f]+", text):
        return _by_class(text, key, "secret", hexadecimal=True)
    head, value = re.fullmatch(r"(?s)(.*?[=:][ ]?[\"']?)(.*)", text).groups()
    return head + _by_class(value, key, "secret")


_MAKE = {"email": _email, "iban": _iban, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


@lru_cache(1 << 14)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym, None if the value is not valid."""
    return _MAKE[kind](value, key)


def replace(text: str, key: bytes) -> tuple[str, Counter]:
    found: Counter = Counter()
    if not _CANDIDATE.search(text):
        return text, found

    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        kind, value, at = next(k for k in KINDS if m.group(k) is not None), m.group(), m.end()
        new = pseudonym(kind, value, key)
        while new is None and kind == "iban" and " " in value:
            value = value.rpartition(" ")[0]
            new = pseudonym(kind, value, key)
        if new is not None:
            at = m.start() + len(value)
            out += [text[done : m.start()], new]
            done, found[kind] = at, found[kind] + 1
        at += at == m.start()
    return "".join([*out, text[done:]]), found


def run_key(spark: SparkSession) -> bytes:
    """The key that the session sets, else a fresh one."""
    own = spark.conf.get(KEY_SETTING, None)
    return hashlib.blake2b(own.encode(), digest_size=32).digest() if own else secrets.token_bytes(32)


def pseudonymise(docs: DataFrame, key: bytes | None = None, counts: bool = False) -> DataFrame:
    """docs with text replaced; with `counts`, also the number of values of each kind (n_email, n_card, ...), in place of columns so named."""
    key = key or run_key(docs.sparkSession)
    docs = docs.drop(*[f"n_{k}" for k in KINDS]) if counts else docs
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *(StructField(f"n_{k}", LongType()) for k in KINDS if counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text in batch.column(at):
                new, n = replace(text.as_py(), key) if text.is_valid else (None, Counter())
                texts.append(new)
                found.append(n)
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]]
            if counts:
                columns += [pa.array([n[k] for n in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
