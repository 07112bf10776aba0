"""Format-preserving pseudonyms for personal data (operator 5).

Card numbers, bank accounts, telephone numbers, IPv4 and e-mail addresses and
dates are found by pattern and validated (Luhn, mod 97, numbering plan, octets,
calendar). A card ends at the first border of its groups where it is valid, an
IBAN where its country's length says; if neither is found, the search goes on
at the next group. A valid value becomes a number within its format's range, a keyed
Feistel network permutes that range, and the result is written back with the
same separators and width. Check digits are recomputed, so a pseudonym is a
valid value too. Equal values get equal pseudonyms in all documents, different
values different ones, and whoever has the key can turn them back.

A Feistel network permutes a power of four; a range in between is walked: the
permutation is applied again until the value falls within the range, which
takes fewer than four rounds on average. In the same way a card's pseudonym is
walked past those that are valid at an earlier border. A date is one value
however it is written: it is permuted among dates that every written order and
width can tell in the same way. Where groups of digits stand before a card, a
pseudonym may make them a card too (one in ten); such a text cannot be turned
back without its spans. The round function is keyed BLAKE2,
with format and range as its context.

Plan: one pass over the table, no shuffle; a text without digits is passed on
as it is. Rows hold whole texts and nothing else is kept.

Left alone: national identity numbers, IPv6 addresses, names; and of a mail
address its domain stays in clear.

Defined results: a null text stays null with no spans; values that fail
validation stay; an empty table gives an empty table; repeated rows get equal
results; further columns are not read. Offsets count code points of the input.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Pseudonyms under this key are for tests and checks; production passes its own.
DEMO_KEY = b"demonstration key"


class Permutation:
    """A keyed permutation of [0, size)."""

    def __init__(self, key: bytes, context: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.seed = hashlib.blake2b(f"{context}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, k: int, x: int) -> int:
        h = hashlib.blake2b(x.to_bytes((self.half + 7) // 8, "big"), key=self.seed, salt=bytes([k]) * 16, digest_size=32).digest()
        return int.from_bytes(h, "big") & ((1 << self.half) - 1)

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & ((1 << self.half) - 1)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ self._f(k, left), left) if back else (right, left ^ self._f(k, right))
        return left << self.half | right

    def apply(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


@lru_cache(maxsize=4096)
def permutation(key: bytes, context: str, size: int) -> Permutation:
    return Permutation(key, context, size)


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` and it pass."""
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _spread(digits: str, shape: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


Permuter = Callable[[str, int, int], int]


def _is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(m: re.Match, p: Permuter) -> str | None:
    text = m[0]
    digits = re.sub(r"\D", "", text)
    if not _is_card(text):
        return None
    n, x = len(digits) - 2, int(digits[1:-1])
    while True:
        x = p("card", 10**n, x)
        body = digits[0] + str(x).zfill(n)
        new = _spread(body + luhn_digit(body), text)
        # Read back, the pseudonym must end where the value does, and be one.
        if len(set(body + luhn_digit(body))) > 1 and not any(_is_card(new[:e]) for e in range(len(new)) if new[e] in " -"):
            return new


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(m: re.Match, p: Permuter) -> str | None:
    text = re.sub(" ", "", m[0])
    if not 15 <= len(text) <= 34 or _iban_number(text[4:] + text[:4]) % 97 != 1:
        return None
    account = text[4:]
    digits = re.sub(r"\D", "", account)
    if len(digits) < 4:
        return None
    account = _spread(str(p("iban", 10 ** len(digits), int(digits))).zfill(len(digits)), account)
    check = 98 - _iban_number(account + text[:2] + "00") % 97
    it = iter(f"{text[:2]}{check:02d}{account}")
    return "".join(c if c == " " else next(it) for c in m[0])


def _phone(m: re.Match, p: Permuter) -> str | None:
    text = m[0]
    digits = re.sub(r"\D", "", text)
    if text.startswith("+") and digits[0] != "1":
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 3
        return _spread(digits[:3] + str(p("phone", 10**n, int(digits[3:]))).zfill(n), text)
    own = digits[-10:]
    if len(digits) not in (10, 11) or (len(digits) == 11 and digits[0] != "1") or own[0] in "01" or own[3] in "01":
        return None
    x = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 8 * 10**6 + (int(own[3]) - 2) * 10**6 + int(own[4:])
    a, b = divmod(p("phone", 64 * 10**8, x), 8 * 10**6)
    return _spread(digits[:-10] + f"{a // 100 + 2}{a % 100:02d}{b // 10**6 + 2}{b % 10**6:06d}", text)


def _address(m: re.Match, p: Permuter) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    x = p("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


#: The characters that a local part's letters and digits are permuted among, by kind.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _mail(m: re.Match, p: Permuter) -> str:
    """Letters and digits of the local part; its marks and the domain stay."""
    local, domain = m[0].rsplit("@", 1)
    alphabets = [next((a for a in KINDS if c in a), "") for c in local]
    x, size = 0, 1
    for c, a in zip(local, alphabets, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join(a[:1] or c for c, a in zip(local, alphabets, strict=True))
    x, out = p(f"mail:{shape}@{domain.lower()}", size, x), []
    for c, a in zip(reversed(local), reversed(alphabets), strict=True):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


def _other_date(d: date, p: Permuter) -> date:
    """The pseudonym of a date, however it is written.

    Dates are permuted among those whose month has as many digits and whose day
    is below 10, up to 12, or above, so that every way to write the one can
    write the other and reads back in the same order.
    """
    months = range(1, 10) if d.month < 10 else range(10, 13)
    days = range(1, 10) if d.day < 10 else range(10, 13) if d.day <= 12 else range(13, 32)
    years = LAST.year - FIRST.year + 1
    x = ((d.year - FIRST.year) * len(months) + d.month - months[0]) * len(days) + d.day - days[0]
    while True:
        x = p(f"date:{months[0]}:{days[0]}", years * len(months) * len(days), x)
        rest, day = divmod(x, len(days))
        year, month = divmod(rest, len(months))
        try:
            return date(FIRST.year + year, months[month], days[day])
        except ValueError:
            continue


def _date(m: re.Match, p: Permuter) -> str | None:
    """Year first, or day first; where only month first makes a date, month first."""
    a, mark, b, c = m[1], m[2], m[3], m[4]
    orders = (lambda: (a, b, c),) if len(a) == 4 else (lambda: (c, b, a), lambda: (c, a, b))
    for k, order in enumerate(orders):
        try:
            d = date(*map(int, order()))
        except ValueError:
            continue
        if not FIRST <= d <= LAST:
            return None
        e = _other_date(d, p)
        y, mo, dd = f"{e.year:04d}", str(e.month), str(e.day)
        fields = (y, mo, dd) if len(a) == 4 else (dd, mo, y) if k == 0 else (mo, dd, y)
        return mark.join(f.zfill(len(w)) for f, w in zip(fields, (a, b, c), strict=True))
    return None


#: Lengths of IBANs by country; of other countries only the whole match is tried.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27,
    GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27,
    MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23,
    TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
#: What ends a group: the match itself, or the place before a separator.
EDGE = {"card": re.compile(r"(?=[ -])|$"), "iban": re.compile(r"(?= )|$")}


def _ends(kind: str, text: str) -> list[int]:
    """Where a value that starts with ``text`` may end."""
    ends = [e.start() for e in EDGE[kind].finditer(text)]
    if kind == "card":
        return ends
    n = IBAN_LENGTHS.get(text[:2])
    return [e for e in ends if e - text[:e].count(" ") == n] if n else [len(text)]


def values(kind: str, pattern: re.Pattern, change: Callable, text: str, permute: Permuter) -> Iterator[tuple[int, int, str]]:
    """(start, end, new text) of the valid values of one kind."""
    at = 0
    while m := pattern.search(text, at):
        at = max(m.end(), at + 1)
        if kind not in EDGE:
            if (new := change(m, permute)) is not None:
                yield m.start(), m.end(), new
            continue
        for end in _ends(kind, m[0]):
            if (new := change(re.match(r"(?s).*", m[0][:end]), permute)) is not None:
                yield m.start(), m.start() + end, new
                at = m.start() + end
                break
        else:
            # Nothing starts here; a value may start at the next group.
            gap = re.search("[ -]", m[0])
            at = m.start() + (gap.end() if gap else len(m[0]))


#: Tried in this order; what one has taken the next ones leave.
FINDERS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("mail", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![\w-])"), _mail),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"), _card),
    ("date", re.compile(r"(?<![\w./-])([0-9]{4})(-|/|\.)([0-9]{1,2})\2([0-9]{1,2})(?![0-9/-]|(?!T[0-9]{2})\w)"), _date),
    ("date", re.compile(r"(?<![\w./-])([0-9]{1,2})(-|/|\.)([0-9]{1,2})\2([0-9]{4})(?![0-9/-]|(?!T[0-9]{2})\w)"), _date),
    ("ipv4", re.compile(r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])"), _address),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,8}\)?){1,5}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])"), _phone),
)
ANY = re.compile(r"[0-9@]")


def overlaps(taken: list[tuple[int, int, str, str]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the spans, which are sorted and apart."""
    k = bisect_left(taken, (end,))
    return k > 0 and taken[k - 1][1] > start


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms (``back``: with originals), and (kind, start, end) of what was replaced."""
    if not ANY.search(text):
        return text, []
    permute: Permuter = lambda context, size, x: permutation(key, context, size).apply(x, back)
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in FINDERS:
        for start, end, new in values(kind, pattern, change, text, permute):
            if not overlaps(taken, start, end):
                insort(taken, (start, end, kind, new))
    out, at = [], 0
    for s, e, _, new in taken:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [(kind, s, e) for s, e, kind, _ in taken]


def pseudonyms(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(id, text, n_found, spans): the text with pseudonyms; spans as kind:start:end, comma-joined."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else pseudonymise(t, key, back) for t in batch.column("text").to_pylist()]
            spans = [",".join(f"{k}:{s}:{e}" for k, s, e in found) for _, found in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array(spans, pa.string())],
                ["id", "text", "n_found", "spans"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_found long, spans string")
