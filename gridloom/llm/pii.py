"""Personal data: format-preserving Feistel pseudonyms.

Validated values (card numbers by check digit, phone numbers, IP addresses, social security numbers, bank account numbers,
dates, e-mail addresses, secret tokens) are permuted within their own format by a keyed Feistel network: a card number
becomes another valid card number, a date another date (of 1900 to 2099, or of the other years from 1 to 9999; year, month and
day). The permutation depends on the key and the kind of value alone, not on its layout, so equal values have equal pseudonyms
in all documents, without any table of values or shuffle, and whoever has the key can go back. A phone number is its
digits behind the country code; an address its user in any case, on its host; a date its day, in any of the layouts. Dates from the 13th
on are permuted among themselves, and those before it too, so that a date with the month first stays readable in one way.

Cases: null text stays null with no values found; empty texts stay empty. Texts of any length are read whole; no value
reaches over a line break. Values that fail validation (an octet over 255, the 31st of February, a wrong check digit or bank
check sum) are left as they are; with numbers=True those of card length are permuted among numbers with the same error, kind
`number`. In a run of digits with blanks and hyphens, cards are looked for first, on the boundaries of its groups (of three digits
or more, if they are not the usual ones), so a security code, an expiry date or an address beside a card does not change its
pseudonym. Runs of any length are read whole. Where groups of a run could also be read as other cards, a card can get another
pseudonym than alone, so that the way back stays open. Users of addresses without ASCII letters or digits have their signs and
letters permuted within their own script. A permutation can map a value to itself, as rarely as it has values. Repeated rows give equal results; an empty table gives an empty result.
Columns that clash with those added are replaced.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, without

ROUNDS = 8
#: Dates of these years are permuted among themselves, and all other dates among themselves.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
LETTERS, CAPITALS, DECIMALS, MARKS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "%+-._"

_BEFORE = (
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[A-Fa-f]{0,63}[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
)
#: Cards and phone numbers do not end in the middle of an address or a date with dots.
_DOTTED = r"\.[0-9]{1,3}\.[0-9]"
_PHONE = rf"|(?P<phone>(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .-][0-9]{{3,4}}[ .-][0-9]{{3,4}}(?![0-9]|{_DOTTED}))"
#: Nor does a run of digits go into a secret.
_HEX = "(?![0-9A-Fa-f]{32})"
#: With whole runs of 13 digits or more, blanks and hyphens between them, that may hold cards.
PATTERN = re.compile(_BEFORE + rf"|(?P<run>(?<![0-9-])(?=[0-9](?:[ -]?[0-9]){{12}}){_HEX}[0-9]++(?:[ -]{_HEX}[0-9]++)*+)" + _PHONE)
#: For what is left of a run beside its cards: as much of it as has card length is one number.
REST = re.compile(_BEFORE + rf"|(?P<card>(?<![0-9-]){_HEX}[0-9](?:(?:[ -]{_HEX})?[0-9]){{12,18}}(?![0-9]|-[0-9]|{_DOTTED}))" + _PHONE)
#: Every value has a digit or an `@`.
HINT = re.compile("[0-9@]")
DIGITS, DOTTED, DECIMAL = re.compile("[0-9]+"), re.compile(_DOTTED), re.compile(r"\.[0-9]")
#: Usual groups of cards, and card lengths, the likeliest first.
GROUPINGS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
LENGTHS = (16, 15, 14, 13, 19, 18, 17)
#: No window of a card has more characters, and values may reach so far behind a run.
WIDEST, REACH = 2 * 19 - 1, 1000


class Permuter:
    """Keyed permutations of ranges of integers: a balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.order = key, range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        self.back = back

    def _round(self, label: bytes, i: int, half: int, size: int) -> int:
        message = b"%b|%d|%x" % (label, i, half)
        return int.from_bytes(hmac.digest(self.key, message, "sha256")) % size

    def number(self, label: bytes, value: int, n: int) -> int:
        """Another number below n."""
        if n < 2:
            return value
        side = 1
        while side * side < n:  # powers of two keep equal sides for every n
            side *= 2
        label = b"%b/%x" % (label, n)
        while True:
            left, right = divmod(value, side)
            for i in self.order:
                if self.back:
                    left, right = (right - self._round(label, i, left, side)) % side, left
                else:
                    left, right = right, (left + self._round(label, i, right, side)) % side
            value = left * side + right
            if value < n:
                return value

    def text(self, label: bytes, value: str, fold: bool = False) -> str:
        """Digits to digits, letters to letters of the same case; everything else stays. The shape of the text is its format.

        fold: a letter's case stays where it is and has no part in the format.
        """
        kinds = "".join("9" if c in DECIMALS else "a" if c in LETTERS else "A" if c in CAPITALS else " " for c in value)
        code, n = 0, 1
        for c, k in zip(value, kinds, strict=True):
            if k == "9":
                code, n = code * 10 + int(c), n * 10
            elif k != " ":
                code, n = code * 26 + LETTERS.index(c.lower()), n * 26
        shape = "".join(c if k == " " else k for c, k in zip(value, kinds, strict=True))
        code = self.number(label + (shape.replace("A", "a") if fold else shape).encode(), code, n)
        out = []
        for c, k in zip(reversed(value), reversed(kinds), strict=True):
            if k == "9":
                code, d = divmod(code, 10)
                c = DECIMALS[d]
            elif k != " ":
                code, d = divmod(code, 26)
                c = LETTERS[d] if k == "a" else CAPITALS[d]
            out.append(c)
        return "".join(reversed(out))

    def signs(self, label: bytes, value: str) -> str:
        """Characters other than ASCII letters and digits, each to one of its own alphabet: marks, or letters alike in the same part of Unicode."""
        alphabets = [MARKS if c in MARKS else _alphabet(ord(c) >> 8, unicodedata.category(c)) for c in value]
        code, n = 0, 1
        for c, alphabet in zip(value, alphabets, strict=True):
            code, n = code * len(alphabet) + alphabet.index(c), n * len(alphabet)
        shape = ",".join(f"{ord(a[0]):x}" for a in alphabets)
        code = self.number(label + b"|" + shape.encode(), code, n)
        out = []
        for alphabet in reversed(alphabets):
            code, d = divmod(code, len(alphabet))
            out.append(alphabet[d])
        return "".join(reversed(out))


@cache
def _alphabet(part: int, category: str) -> str:
    """The word characters of 256 code points that are of one category."""
    return "".join(c for c in map(chr, range(part << 8, part + 1 << 8)) if unicodedata.category(c) == category and re.match(r"\w", c) and not (c.isascii() and c.isalnum()))


def luhn(digits: str) -> int:
    """The Luhn sum, 0 for valid numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(p: Permuter, s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if luhn(digits):
        return None
    body = p.text(b"card", digits[:-1])
    return _refill(s, body + str(-luhn(body + "0") % 10))


def _number(p: Permuter, s: str) -> str | None:
    """A long number of card length with a wrong check digit may still name someone: it is permuted among those."""
    digits = re.sub(r"\D", "", s)
    body = p.text(b"number", digits[:-1])
    shift = luhn(digits)
    return _refill(s, body + str((-luhn(body + "0") + shift) % 10))


def _ip(p: Permuter, s: str) -> str | None:
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255:
        return None
    value = p.number(b"ip", int.from_bytes(bytes(octets)), 1 << 32)
    return ".".join(map(str, value.to_bytes(4)))


_before_year: list[int] = []


def _late(year: int, month: int) -> int:
    """Days of a month from the 13th on."""
    return calendar.monthrange(year, month)[1] - 12


def _late_days(day: datetime.date) -> int:
    """Days before this one, from year 1, whose day of the month is 13 or more."""
    if not _before_year:
        _before_year.extend(accumulate((sum(_late(y, m) for m in range(1, 13)) for y in range(1, datetime.MAXYEAR + 1)), initial=0))
    return _before_year[day.year - 1] + sum(_late(day.year, m) for m in range(1, day.month)) + max(0, day.day - 13)


def _late_day(n: int) -> datetime.date:
    """The day with so many before it by _late_days."""
    year = bisect_right(_before_year, n)
    n -= _before_year[year - 1]
    month = 1
    while n >= _late(year, month):
        n -= _late(year, month)
        month += 1
    return datetime.date(year, month, 13 + n)


def _early_days(day: datetime.date) -> int:
    """Days before this one, from year 1, up to the 12th of their months."""
    return ((day.year - 1) * 12 + day.month - 1) * 12 + min(day.day, 12) - 1


def _early_day(n: int) -> datetime.date:
    months, day = divmod(n, 12)
    return datetime.date(months // 12 + 1, months % 12 + 1, day + 1)


def _date(p: Permuter, s: str) -> str | None:
    form = "%Y-%m-%d" if s[4] == "-" else "%d/%m/%Y" if "/" in s else "%d.%m.%Y"
    swap = False
    try:
        day = datetime.datetime.strptime(s, form).date()
    except ValueError:
        if "/" not in s:
            return None
        try:
            day, swap = datetime.datetime.strptime(s, "%m/%d/%Y").date(), True
        except ValueError:
            return None
    if swap:
        form = "%m/%d/%Y"
    label, number, back = (b"late-date", _late_days, _late_day) if day.day >= 13 else (b"early-date", _early_days, _early_day)
    at, first = number(day), number(FIRST_DAY)
    n = number(LAST_DAY + datetime.timedelta(1)) - first
    if FIRST_DAY <= day <= LAST_DAY:
        day = back(first + p.number(label, at - first, n))
    else:  # the days before and after, without the gap
        everything = number(datetime.date.max) + 1
        at = p.number(label + b"-far", at - (n if day > LAST_DAY else 0), everything - n)
        day = back(at + (n if at >= first else 0))
    return form.replace("%Y", f"{day.year:04d}").replace("%m", f"{day.month:02d}").replace("%d", f"{day.day:02d}")


def _ssn(p: Permuter, s: str) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    value = (((area - 1 - (area > 666)) * 99) + group - 1) * 9999 + serial - 1
    value = p.number(b"ssn", value, 898 * 99 * 9999)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(p: Permuter, s: str) -> str | None:
    raw = s.replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    if rest(raw) != 1:
        return None
    body = p.text(b"iban" + raw[:2].encode(), raw[4:])
    new = raw[:2] + f"{98 - rest(raw[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(next(it) if c != " " else c for c in s)


def _secret(p: Permuter, s: str) -> str | None:
    value = p.number(b"secret", int(s, 16), 16 ** len(s))
    out = f"{value:0{len(s)}x}"
    return out if s == s.lower() else out.upper()


def _phone(p: Permuter, s: str) -> str | None:
    if not 7 <= len(re.sub(r"\D", "", s)) <= 15:
        return None
    head = re.match(r"\+[0-9]{1,3}[ .-]?", s)
    head = head.group() if head else ""
    rest = s[len(head) :]
    return head + _refill(rest, p.text(b"phone", re.sub(r"\D", "", rest)))


def _email(p: Permuter, s: str) -> str | None:
    user, _, host = s.rpartition("@")
    # the mail server and everything above it stay; addresses are permuted as pairs of user and server
    label = b"email@" + host.lower().encode()
    plain = any(c.isascii() and c.isalnum() for c in user)
    return f"{p.text(label, user, fold=True) if plain else p.signs(label, user)}@{host}"


RULES = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}


def _cards(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The places of cards in a run of digits: windows of whole groups with a right check digit, the likeliest forms first.

    And the windows that have a wrong one and would be cards with a right one, since no likelier card lies on them.
    """
    starts, ends = array("q"), array("q")
    for m in DIGITS.finditer(text, start, end):
        starts.append(m.start())
        ends.append(m.end())
    # by likelihood, first and last groups in turn: few bytes for each of the many windows of a long run
    windows: dict[tuple[bool, bool, int], array] = {}
    for i in range(len(starts)):
        sizes: tuple[int, ...] = ()
        for j in range(i, len(starts)):
            sizes += (ends[j] - starts[j],)
            n = sum(sizes)
            if n > 19:
                break
            usual = len(sizes) == 1 or sizes in GROUPINGS
            if n >= 13 and (usual or min(sizes) >= 3) and not DOTTED.match(text, ends[j]):
                form = (DECIMAL.match(text, ends[j]) is not None, not usual, LENGTHS.index(n))
                windows.setdefault(form, array("q")).extend((i, j))
    taken, barred, used = [], [], bytearray(len(starts))
    for form in sorted(windows):
        for i, j in zip(windows[form][::2], windows[form][1::2], strict=True):
            if not any(used[i : j + 1]):
                a, b = starts[i], ends[j]
                if luhn(re.sub("[ -]", "", text[a:b])):
                    barred.append((a, b))
                else:
                    taken.append((a, b))
                    used[i : j + 1] = b"\1" * (j + 1 - i)
    return sorted(taken), sorted(barred)


def _values(text: str, start: int, end: int, cards: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Kind and place of each value that begins in a run: its cards, and other values between them."""
    out, at = [], start
    for a, b in [*cards, (end, end)]:
        stop = end + REACH if a == end else a
        while at < a and (m := REST.search(text, at, stop)) and m.start() < a:
            out.append((m.lastgroup, *m.span()))
            at = m.end()
        if b > a:
            out.append(("card", a, b))
            at = b
    return out


def _run(p: Permuter, text: str, start: int, end: int, numbers: bool) -> tuple[str, list[str], int]:
    """A run with its values replaced, their kinds, and the end of what was read.

    New digits can make a card across groups where there was none. Values are replaced one after another, and each is permuted
    again until no barred window on it, among the values as they then are, has a right check digit (cycle walking). So the run
    has the same cards after each of them, and the way back undoes the last one first. All else that places values in a run is
    the kind of its characters, which stays.
    """
    cards, barred = _cards(text, start, end)
    values = _values(text, start, end, cards)
    stop = max([end, *(b for *_, b in values)])
    now = bytearray(text[start:end], "ascii")
    new, kinds = {}, {}
    for i in reversed(range(len(values))) if p.back else range(len(values)):
        kind, a, b = values[i]
        rule, value = RULES[kind], text[a:b]
        if kind == "card" and numbers and luhn(re.sub(r"\D", "", value)):
            kind, rule = "number", _number
        near = barred[bisect_left(barred, (a - WIDEST, 0)) : bisect_left(barred, (b, 0))]
        near = [(x - start, y - start) for x, y in near if y > a]
        while (value := rule(p, value)) is not None:
            new[i], kinds[i] = value, kind
            if not near:
                break
            # not for addresses of four octets, the only ones to change their length: no window reaches into them
            now[a - start : b - start] = value[: end - a].encode()
            if all(luhn(now[x:y].translate(None, b" -").decode()) for x, y in near):
                break
    out, at = [], start
    for i, (_, a, b) in enumerate(values):
        out += [text[at:a], new.get(i, text[a:b])]
        at = b
    return "".join([*out, text[at:stop]]), [kinds[i] for i in sorted(kinds)], stop


def pseudonymise(text: str, p: Permuter, numbers: bool = False) -> tuple[str, list[str]]:
    """The text with its values replaced, and the kind of each value in order."""
    if not HINT.search(text):
        return text, []
    lines, kinds = text.split("\n"), []
    for i, line in enumerate(lines):
        if HINT.search(line):
            lines[i], found = _line(line, p, numbers)
            kinds += found
    return "\n".join(lines), kinds


def _line(text: str, p: Permuter, numbers: bool) -> tuple[str, list[str]]:
    kinds: list[str] = []
    out: list[str] = []
    at = 0
    while m := PATTERN.search(text, at):
        out.append(text[at : m.start()])
        kind, at = m.lastgroup, m.end()
        if kind != "run":
            new = RULES[kind](p, m.group())
            out.append(m.group() if new is None else new)
            if new is not None:
                kinds.append(kind)
            continue
        new, found, at = _run(p, text, *m.span(), numbers)
        out.append(new)
        kinds += found
    out.append(text[at:])
    return "".join(out), kinds


def pii(docs: DataFrame, key: str, text_col: str = "text", back: bool = False, numbers: bool = False) -> DataFrame:
    """The rows with pseudonymised text, n_values, kinds (distinct, sorted, comma-joined). `back` undoes it with the same key and `numbers`."""
    docs = without(docs, ["n_values", "kinds"], (text_col,))
    secret = hashlib.sha256(key.encode()).digest()
    schema = docs.withColumns({"n_values": F.lit(0).cast("long"), "kinds": F.lit("")}).schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(secret, back)
        for part in slices(batches, text_col):
            texts, n, kinds = [], [], []
            for text in part.column(text_col).to_pylist():
                new, found = pseudonymise(text, p, numbers) if text else (text, [])
                texts.append(new)
                n.append(len(found))
                kinds.append(",".join(sorted({*found})))
            at = part.schema.get_field_index(text_col)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=[*part.schema.names, "n_values", "kinds"])

    return docs.mapInArrow(replace, schema)
