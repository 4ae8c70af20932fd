"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses and secrets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts_of

ROUNDS = 10
KINDS = ("card", "date", "email", "iban", "ip", "phone", "secret", "ssn")

_DAY0, _DAY1 = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What may be personal data; each find is validated before it is replaced.
CANDIDATE = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9._%+\-À-ɏ]+@[A-Za-z0-9](?:[A-Za-z0-9\-.]*[A-Za-z0-9])?\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<date>(?<![\w.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?P<sep>[/.])[0-9]{2}(?P=sep)[0-9]{4})(?![\w\-/]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w+\-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ \-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?!\w|-[0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[.\-])[0-9]{3,4}[ .\-][0-9]{4}(?!\w|[.\-][0-9])"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![\w]))"
)
_MAYBE = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of 0 .. n - 1 for any n: a balanced network, walked until it is inside."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        if not key:
            raise ValueError("pseudonyms need a secret key")
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, kind: str, n: int, r: int, half: int, bits: int) -> int:
        data = f"{kind}|{n}|{r}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, kind: str, back: bool = False) -> int:
        """The pseudonym of ``value``, or with ``back`` the value of a pseudonym."""
        if not 0 <= value < n:
            raise ValueError("value outside its format")
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            a, b = value >> bits, value & mask
            for r in reversed(range(self.rounds)) if back else range(self.rounds):
                if back:
                    a, b = b ^ self._round(kind, n, r, a, bits), a
                else:
                    a, b = b, a ^ self._round(kind, n, r, b, bits)
            value = (a << bits) | b
            if value < n:
                return value


# ------------------------------------------------------------------ formats


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _refilled(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in text)


Permute = Callable[[int, int, str], int]


def _card(text: str, p: Permute) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(p(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}")).zfill(len(d) - 1)
    return _refilled(text, body + luhn_digit(body))


def _ip(text: str, p: Permute) -> str | None:
    parts = list(map(int, text.split(".")))
    if max(parts) > 255 or any(str(n) != s for n, s in zip(parts, text.split("."), strict=True)):
        return None
    new = p(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _phone(text: str, p: Permute) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    keep = len(re.match(r"\+?([0-9]*)", text)[1]) if text[0] == "+" and re.match(r"\+[0-9]{1,3}[ .(\-]", text) else 0
    rest = d[keep:]
    if len(rest) < 6:
        return None
    return _refilled(text, d[:keep] + str(p(int(rest), 10 ** len(rest), f"phone{len(rest)}")).zfill(len(rest)))


def _ssn(text: str, p: Permute) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    at = area - 1 - (area > 666)
    new = p((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    new, serial = divmod(new, 9999)
    at, group = divmod(new, 99)
    return f"{at + 1 + (at >= 665):03}-{group + 1:02}-{serial + 1:04}"


def _date(text: str, p: Permute) -> str | None:
    """Day before month with ``/`` and ``.``; a date that is none that way may be month before day."""
    sep = text[4] if text[4] == "-" else text[2]
    a, b, c = map(int, text.split(sep))
    orders = [(a, b, c, "ymd")] if sep == "-" else [(c, b, a, "dmy"), (c, a, b, "mdy")]
    for y, m, d, order in orders:
        try:
            day = date(y, m, d).toordinal()
        except ValueError:
            continue
        if not _DAY0 <= day <= _DAY1:
            return None
        new = date.fromordinal(_DAY0 + p(day - _DAY0, _DAY1 - _DAY0 + 1, "date"))
        parts = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
        return sep.join(parts[k] for k in order)
    return None


def _iban(text: str, p: Permute) -> str | None:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _classes(flat[4:], p, "iban")
    check = 98 - number(body + flat[:2] + "00") % 97
    new = iter(f"{flat[:2]}{check:02}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _classes(text: str, p: Permute, kind: str) -> str:
    """Digits, small and large letters permuted together, each within its class."""
    sets = [next((s for s in ("0123456789", _LOWER, _UPPER) if c in s), c) for c in text]
    value, n = 0, 1
    for c, s in zip(text, sets, strict=True):
        value, n = value * len(s) + s.index(c), n * len(s)
    value = p(value, n, f"{kind}{len(text)}") if n > 1 else value
    out = []
    for s in reversed(sets):
        value, i = divmod(value, len(s))
        out.append(s[i])
    return "".join(reversed(out))


def _email(text: str, p: Permute) -> str | None:
    local, _, domain = text.rpartition("@")
    parts = [_classes(local[i : i + 24], p, f"email{i}") for i in range(0, len(local), 24)]
    return "".join(parts) + "@" + domain


def _secret(text: str, p: Permute) -> str | None:
    if text.isdigit() or text.isalpha():
        return None
    new = f"{p(int(text, 16), 16 ** len(text), f'secret{len(text)}'):0{len(text)}x}"
    return new.upper() if text.upper() == text else new


FORMATS = {"card": _card, "date": _date, "email": _email, "iban": _iban, "ip": _ip, "phone": _phone, "secret": _secret, "ssn": _ssn}


class Pseudonymiser:
    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.feistel = Feistel(key, rounds)

    def text(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and how many of each of KINDS it had."""
        counts = [0] * len(KINDS)
        if not text or not _MAYBE.search(text):
            return text, counts

        def one(m: re.Match) -> str:
            new = FORMATS[m.lastgroup](m[0], self.feistel.permute)
            if new is None:
                return m[0]
            counts[KINDS.index(m.lastgroup)] += 1
            return new

        lines = text.split("\n")
        for i, line in enumerate(lines):
            if _MAYBE.search(line):
                lines[i] = CANDIDATE.sub(one, line)
        return "\n".join(lines), counts


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, n_values and a count of each kind (n_card, n_date, ...).

    Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, social security numbers, telephone
    numbers, calendar dates 1900-2099, e-mail addresses and hexadecimal secrets that pass
    validation are permuted within their format by a keyed Feistel network: pseudonyms pass
    the same validation, separators stay, and equal values have equal pseudonyms everywhere.
    Numbers that fail validation stay as they are. Whoever has ``key`` can reverse pseudonyms, so
    there is no default; an empty one is refused.

    Null text stays null, empty text empty, with counts 0. Repeated rows and null ids get a
    row each; other columns are ignored; an empty table gives an empty result.
    """
    names = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((n, pa.int64()) for n in names)])
    small_batches(docs.sparkSession)
    Feistel(key)  # refuses an empty key here rather than in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Pseudonymiser(key)
        for batch in batches:
            for at, texts in texts_of(batch, "text"):
                done = [maker.text(t) for t in texts]
                counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([t for t, _ in done], pa.string()), *counts], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    return out.select("doc_id", "text", sum((F.col(n) for n in names[1:]), F.col(names[0])).alias("n_values"), *names)
