"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Every value that its check accepts (Luhn for cards, mod 97 for IBANs, real
calendar days, octets, area rules) is numbered within the values of its format
and replaced by the value with the permuted number. So a pseudonym passes the
same check, has the same separators, and equal values get equal pseudonyms in
every document, whatever their separators.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded

KINDS = ("card", "iban", "phone", "ip", "ssn", "date", "email")

PATTERN = re.compile(
    r"(?P<email>[^\W_][\w.%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}[.-][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}(?P<s1>[.-])[0-9]{3}(?P=s1)[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<!\w)(?:[0-9]{4}(?P<s2>[ -])[0-9]{4}(?P=s2)[0-9]{4}(?P=s2)[0-9]{1,7}|[0-9]{4}(?P<s3>[ -])[0-9]{6}(?P=s3)[0-9]{5}|[0-9]{13,19})(?!\w))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<date>(?<![\w/.-])(?:[0-9]{4}(?P<s4>[-/.])[0-9]{1,2}(?P=s4)[0-9]{1,2}|[0-9]{1,2}(?P<s5>[-/.])[0-9]{1,2}(?P=s5)[0-9]{4})(?!\w|[-/.][0-9]))"
)
_HINT = re.compile(r"[0-9]|@")
_TOKEN = re.compile(r"\w+")
#: Letters that a mail name may hold; a letter stays within its row.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
)
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: ten Feistel rounds on a near-square grid, walked until inside."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right, p, q = x // b, x % b, a, b
        for r in range(10):
            h = hashlib.blake2b(f"{tweak}|{size}|{r}|{right}".encode(), key=key, digest_size=32).digest()
            left, right, p, q = right, (left + int.from_bytes(h, "big")) % p, q, p
        x = left * b + right
        if x < size:
            return x


def luhn_digit(payload: str) -> str:
    """The digit that makes payload and digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(template: str, chars: str, digits_only: bool = True) -> str:
    """The template with its digits (or letters and digits) replaced in order."""
    it = iter(chars)
    return "".join(next(it) if (c in ALPHABETS[0] if digits_only else c.isalnum()) else c for c in template)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in ALPHABETS[0])


def _mixed(chars: str, key: bytes, tweak: str) -> str:
    """Characters permuted together, each within its alphabet; others stay and are part of the tweak."""
    spots = [(i, *_PLACE[c]) for i, c in enumerate(chars) if c in _PLACE]
    number = 0
    for _, alphabet, at in spots:
        number = number * len(alphabet) + at
    shape = "".join(alphabet[0] for _, alphabet, _ in spots)
    number = permute(number, math.prod(len(a) for _, a, _ in spots), key, f"{tweak}|{shape}")
    out = list(chars)
    for i, alphabet, _ in reversed(spots):
        number, at = divmod(number, len(alphabet))
        out[i] = alphabet[at]
    return "".join(out)


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if luhn_digit(d[:-1]) != d[-1]:
        return None
    new = f"{permute(int(d[:-1]), 10 ** (len(d) - 1), key, 'card'):0{len(d) - 1}d}"
    return _fill(s, new + luhn_digit(new))


def _iban(s: str, key: bytes) -> str | None:
    raw = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = _mixed(raw[4:], key, "iban" + raw[:2])
    return _fill(s, f"{raw[:2]}{98 - number(body + raw[:2] + '00') % 97:02d}{body}", False)


def _phone(s: str, key: bytes) -> str | None:
    d = _digits(s)[-10:]
    new = f"{permute(int(d), 10**10, key, 'phone'):010d}"
    return _fill(s, _digits(s)[:-10] + new)


def _ip(s: str, key: bytes) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not _ssn_ok(d):
        return None
    while True:  # walk on until the pseudonym is a possible number
        d = f"{permute(int(d), 10**9, key, 'ssn'):09d}"
        if _ssn_ok(d):
            return _fill(s, d)


def _date(s: str, key: bytes) -> str | None:
    sep = next(c for c in s if c not in ALPHABETS[0])
    parts = s.split(sep)
    year_first = len(parts[0]) == 4
    try:  # day before month, unless only the other order is a date
        y, m, d = map(int, parts if year_first else parts[::-1])
        swapped = not year_first and m > 12
        day = dt.date(y, d, m) if swapped else dt.date(y, m, d)
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    n = permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
    new = dt.date.fromordinal(FIRST_DAY + n)
    while swapped and new.day <= 12:  # else it would be read in the other order
        n = permute(n, LAST_DAY - FIRST_DAY + 1, key, "date")
        new = dt.date.fromordinal(FIRST_DAY + n)
    if year_first:
        order = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
    else:
        order = (f"{new.month:02d}", f"{new.day:02d}", f"{new.year:04d}") if swapped else (f"{new.day:02d}", f"{new.month:02d}", f"{new.year:04d}")
    return sep.join(order)


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.rpartition("@")
    return f"{_mixed(local, key, 'email')}@{domain}"


REPLACE: dict[str, Callable[[str, bytes], str | None]] = {
    "card": _card, "iban": _iban, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "email": _email
}


def _accepted(kind: str, s: str, key: bytes) -> tuple[str, int] | None:
    """The pseudonym and the length of the value; an IBAN may have taken in tokens that follow it."""
    while (new := REPLACE[kind](s, key)) is None:
        if kind != "iban" or " " not in s:
            return None
        s = s[: s.rindex(" ")]
    return new, len(s)


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and what was replaced: kind, first and last character in the old text.

    After a value that fails its check the search goes on behind its first token.
    """
    if not text or not _HINT.search(text):
        return text, []
    found, out, at, seek = [], [], 0, 0
    while m := PATTERN.search(text, seek):
        kind = next(k for k in KINDS if m[k] is not None)
        got = _accepted(kind, m.group(), key)
        if got is not None:
            new, length = got
            out += [text[at : m.start()], new]
            at = seek = m.start() + length
            found.append((kind, m.start(), at))
        else:
            token = _TOKEN.match(text, m.start())
            seek = token.end() if token else m.start() + 1
    return "".join([*out, text[at:]]), found


@dataclass(frozen=True)
class Params:
    """``key``: the secret that fixes the permutations, up to 64 bytes; there is no default."""

    key: bytes


def pseudonymise_documents(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``, ``n_<kind>`` for each kind, ``n_found`` and ``spans`` for every row.

    Null texts stay null, empty ones empty, both with nothing found; texts
    without a value that passes its check come back unchanged. Repeated rows
    and null ids are rows of their own; an empty table gives an empty result;
    other columns are ignored. Of a mail address the name is replaced, the
    domain stays. One pass, no shuffle.
    """
    key = params.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [pseudonymise(t, key) for t in part.column(1).to_pylist()]
                spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in found] for _, found in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in got], pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"]
                )

    own = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    out = own.mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<kind:string,start:long,end:long>>")
    return out.select("doc_id", "text", *[_count(k) for k in KINDS], F.size("spans").cast("long").alias("n_found"), "spans")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
