"""Format-preserving pseudonyms for personal data.

Validated numbers (payment cards by Luhn, IBANs by mod 97, IPv4 addresses by
range, phone and social security numbers by form), dates, mail addresses and
secrets are replaced by values of the same format. A replacement is a keyed
permutation (a balanced Feistel network over the format's numbers, with cycle
walking to stay inside), so equal values get equal pseudonyms in all documents,
different values never get the same one, and the key's owner can go back.
Check digits are made anew, so a pseudonym is as valid as the value was. A date
is one value in all notations. Ten digits without any mark are an ordinary
number, not a phone.

A match that its kind's check rejects uses up no text: at the same start the
other kinds follow, then shorter matches, then the search goes on a character
behind. A card that is a part of a longer run of digits is taken only after a
phone at its start and in the usual groups of digits; in other groups, where
nothing else was found. What a rejected match overlaps gets other digits, with
which it may be accepted: in such runs of numbers the way back needs the spans
(`restored`), as a new search can cut the run otherwise.

Defined results: a null text stays null with no finds, an empty one stays
empty; where valid values overlap, the first one wins, at the same start the
kind listed first; repeated rows are replaced alike; `pseudonymised` keeps all
columns of docs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import documents, inner, slices

#: Key of the registered queries; a real one comes from a secret store.
KEY = b"quillspark registered queries"
ROUNDS = 8
#: Digits and letters that are permuted together at most.
MOST_PLACES = 96

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIRST, _LAST = date(1900, 1, 1), date(2099, 12, 31)

#: Mail addresses, each run of characters before an @ read once (a search from every place of a run would take its length squared).
_EMAIL = regex.compile(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: What else is looked for. A match is replaced only if its kind's check accepts it.
PATTERN = regex.compile(
    r"""
    (?P<secret>(?<=password=)[^\s"']+|\bAKIA[0-9A-Z]{16}\b|\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}\b)
    |(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))
    |(?P<date>(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]))
    |(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))
    |(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))
    |(?P<phone>(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9]))
    """,
    regex.VERBOSE,
)
#: The kinds' patterns alone, in their order.
_FORMS = {m[1]: regex.compile(m[0].strip().lstrip("|"), regex.VERBOSE) for m in regex.finditer(r"^ *\|?\(\?P<(\w+)>.*$", PATTERN.pattern, regex.MULTILINE)}
#: Usual groups of a card's digits.
_GROUPS = regex.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")


@lru_cache(100_000)
def permuted(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of 0 ... size - 1, another for each tweak."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(i: int, x: int) -> int:
        digest = hashlib.blake2b(x.to_bytes(half // 8 + 1, "big"), key=key[:64], digest_size=half // 8 + 1, person=i.to_bytes(2, "big"), salt=hashlib.md5(tweak.encode()).digest()).digest()
        return int.from_bytes(digest, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ f(i, left), left) if back else (right, left ^ f(i, right))
        value = left << half | right
        if value < size:  # outside: walk on along the cycle
            return value


def _replaced(key: bytes, kind: str, text: str, back: bool, keep: Callable[[int], bool] = lambda i: False) -> str:
    """Each digit and ASCII letter (but the kept places) permuted together, in its own class; the rest stays."""
    places = [(i, a) for i, c in enumerate(text) if not keep(i) for a in ("0123456789", _LOWER, _UPPER) if c in a]
    if len(places) > MOST_PLACES:  # parts of a long value are permuted one by one, each in its own way
        cuts = [0, *(i for i, _ in places[MOST_PLACES::MOST_PLACES]), len(text)]
        return "".join(_replaced(key, f"{kind}:{k}", text[a:b], back, lambda i, a=a: keep(a + i)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    value, size = 0, 1
    for i, a in places:
        value, size = value * len(a) + a.index(text[i]), size * len(a)
    form = "".join("0" if a[0] == "0" else a[0] for _, a in places)
    value = permuted(key, f"{kind}:{form}", value, size, back)
    out = list(text)
    for i, a in reversed(places):
        value, k = divmod(value, len(a))
        out[i] = a[k]
    return "".join(out)


def luhn(digits: str) -> int:
    """0 if the last digit is the check digit."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


#: First digits of payment cards: one of 3 to 6, or 2221 to 2720. A pseudonym keeps them.
_ISSUER = regex.compile(r"[3-6]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720")


def _card(key: bytes, text: str, back: bool) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if luhn(digits) or len(set(digits)) == 1 or not _ISSUER.match(digits):
        return None
    fixed = 4 if digits[0] == "2" else 1
    body = digits[:fixed] + _replaced(key, f"card:{digits[:fixed]}", digits[fixed:-1], back)
    check = next(d for d in "0123456789" if not luhn(body + d))
    new = iter(body + check)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _iban(key: bytes, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    body = _replaced(key, f"iban:{plain[:2]}", plain[4:], back)
    new = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _ip(key: bytes, text: str, back: bool) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = permuted(key, "ip", int.from_bytes(bytes(octets), "big"), 1 << 32, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _shape(when: date) -> tuple[bool, int]:
    """What keeps a date's notation: whether month and day have two digits, and whether the day may be a month."""
    return when.month > 9, (when.day > 9) + (when.day > 12)


@lru_cache(1)
def _days() -> dict[tuple[bool, int], list[date]]:
    """The dates of each shape, in order."""
    out: dict[tuple[bool, int], list[date]] = {}
    for n in range((_LAST - _FIRST).days + 1):
        when = _FIRST + timedelta(n)
        out.setdefault(_shape(when), []).append(when)
    return out


def _date(key: bytes, text: str, back: bool) -> str | None:
    """One permutation for all notations, so a date in two of them stays linked; with a slash the month comes first if it can.

    A date becomes one of its own shape, so a pseudonym is written and read as the date was.
    """
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    x = [int(p) for p in parts]
    order = (0, 1, 2) if mark == "-" else (2, 0, 1) if mark == "/" and x[0] <= 12 else (2, 1, 0)  # places of year, month and day
    try:
        when = date(*(x[i] for i in order))
    except ValueError:
        return None
    if not _FIRST <= when <= _LAST:
        return None
    days = _days()[_shape(when)]
    when = days[permuted(key, f"date{_shape(when)}", bisect_left(days, when), len(days), back)]
    new = dict(zip(order, (when.year, when.month, when.day), strict=True))
    return mark.join(f"{new[i]:0{len(p)}d}" for i, p in enumerate(parts))


def _email(key: bytes, text: str, back: bool) -> str:
    at = text.index("@")
    return _replaced(key, "email", text[:at], back) + text[at:]


def _phone(key: bytes, text: str, back: bool) -> str:
    """The number without its country code (the digits before the first mark after a plus) is permuted."""
    code = regex.match(r"\+[0-9]{1,3}(?=[ .-])", text)
    first = code.end() if code else 0
    return text[:first] + _replaced(key, f"phone:{text[:first]}", text[first:], back)


KINDS: dict[str, Callable[[bytes, str, bool], str | None]] = {
    "email": _email,
    "secret": lambda k, t, b: _secret(k, t, b),
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "ssn": lambda k, t, b: _replaced(k, "ssn", t, b),
    "card": _card,
    "phone": _phone,
}


def _secret(key: bytes, text: str, back: bool) -> str:
    """Hexadecimal digits stay such; the fixed prefix of an access key stays; else digits and letters are permuted."""
    if len(text) >= 32 and regex.fullmatch("[0-9a-f]+", text):
        return f"{permuted(key, f'hex{len(text)}', int(text, 16), 16 ** len(text), back):0{len(text)}x}"
    fixed = 4 if regex.fullmatch("AKIA[0-9A-Z]{16}", text) else 0
    return _replaced(key, "secret", text, back, lambda i: i < fixed)


def _card_ends(text: str, start: int) -> tuple[int | None, list[int]]:
    """Ends of the 13 to 19 digits from a start on: the end of the run of digits, if it has no more, and the ends inside the run, last first."""
    ends, at, n = [], start, 0
    while n < 20 and at < len(text) and "0" <= text[at] <= "9":
        n, at = n + 1, at + 1
        inside = at < len(text) and "0" <= text[at] <= "9"
        if 13 <= n <= 19 and not inside:
            ends.append(at)
        if not inside and text[at : at + 1] in (" ", "-") and "0" <= text[at + 1 : at + 2] <= "9":
            at += 1
    whole = ends.pop() if 13 <= n <= 19 and ends and ends[-1] == at else None
    return whole, ends[::-1]


def _iban_ends(text: str, start: int, end: int) -> Iterator[int]:
    """Ends of the shorter matches at a start, last first."""
    for e in range(end - 1, start + 11, -1):
        if not (text[e].isalnum() or text[e] == "_") and _FORMS["iban"].fullmatch(text, start, e):
            yield e


def _tried(text: str, m: regex.Match) -> Iterator[tuple[str, int]]:
    """Kinds and ends of what may stand at a match's start, in the order in which they are tried."""
    start, kinds = m.start(), list(_FORMS)
    cut: list[int] = []
    for kind in kinds[kinds.index(m.lastgroup) :]:
        if kind == "card":
            whole, cut = _card_ends(text, start) if _FORMS[kind].match(text, start) else (None, [])
            if whole is not None:
                yield kind, whole
        elif found := m if kind == m.lastgroup else _FORMS[kind].match(text, start):
            yield kind, found.end()
            if kind == "iban":
                yield from ((kind, e) for e in _iban_ends(text, start, found.end()))
    yield from (("card", e) for e in cut if _GROUPS.fullmatch(text, start, e))


def _mail(text: str, at: int) -> tuple[int, int, int] | None:
    """Start, place of the @ and end of the next mail address."""
    m = _EMAIL.search(text, at)
    return m and (m.start(), text.index("@", m.start()), m.end())


def _values(text: str, key: bytes, back: bool) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym of the values, by start. A mail address is the first kind; one whose beginning is used up begins behind that."""
    out, left, at = [], [], 0
    mail, m = _mail(text, 0), PATTERN.search(text)
    while mail or m:
        if m and m.start() < at:
            m = PATTERN.search(text, at)
        if mail and mail[1] <= at:  # its part before the @ is used up
            mail = _mail(text, at)
        if mail and (not m or max(at, mail[0]) <= m.start()):
            start, at = max(at, mail[0]), mail[2]
            out.append((start, at, "email", _email(key, text[start:at], back)))
            continue
        if not m:
            break
        start = m.start()
        for kind, end in _tried(text, m):
            if (new := KINDS[kind](key, text[start:end], back)) is not None:
                out.append((start, end, kind, new))
                at = end
                break
        else:
            at = start + 1
            if m.lastgroup == "card" or _FORMS["card"].match(text, start):
                left.append(start)
    # Cards in unusual groups, in what is left.
    before, k = 0, 0
    for start in left:
        while k < len(out) and out[k][0] < start:
            before = max(before, out[k][1])
            k += 1
        if start < before:
            continue
        behind = out[k][0] if k < len(out) else len(text)
        for end in _card_ends(text, start)[1]:
            if end <= behind and (new := _card(key, text[start:end], back)) is not None:
                out.insert(k, (start, end, "card", new))
                break
    return out


def replaced(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end of each in it."""
    out, spans, end, length = [], [], 0, 0
    for start, stop, kind, new in _values(text, key, back):
        out += [text[end:start], new]
        length += start - end
        spans.append((kind, length, length + len(new)))
        length += len(new)
        end = stop
    return ("".join([*out, text[end:]]), spans) if out else (text, spans)


def restored(text: str, spans: list[tuple[str, int, int]], key: bytes = KEY) -> str:
    """The text before its values at these spans were replaced."""
    out, end = [], 0
    for kind, a, b in spans:
        out += [text[end:a], KINDS[kind](key, text[a:b], True) or text[a:b]]
        end = b
    return "".join([*out, text[end:]])


#: Without one of these characters a text holds nothing that PATTERN finds.
_HINT = regex.compile(r"[0-9@]|password=")


def extra_columns(docs: DataFrame) -> list[str]:
    """Names of the two columns that `pseudonymised` adds; other ones if docs has such names."""
    out = []
    for name in ("pii_kinds", "pii_spans"):
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        out.append(name)
    return out


def pseudonymised(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """docs with pseudonyms in `text`, and two more columns: pii_kinds (one for each replacement) and pii_spans ("start-end" in code points)."""
    rows, names = inner(docs)
    at, extra = rows.columns.index("text"), ["kinds_found", "spans_found"]
    schema = StructType([*rows.schema.fields, *(StructField(c, ArrayType(StringType())) for c in extra)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, kinds, places = [], [], []
            for text in batch.column(at).to_pylist():
                new, spans = replaced(text, key, back) if text and _HINT.search(text) else (text, [])
                texts.append(new)
                kinds.append([k for k, _, _ in spans])
                places.append([f"{a}-{b}" for _, a, b in spans])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string())), pa.array(places, pa.list_(pa.string()))], names=[*batch.schema.names, *extra])

    return rows.mapInArrow(run, schema).toDF(*names, *extra_columns(docs))


def replaced_in(docs: DataFrame) -> DataFrame:
    """docs with pseudonyms in `text`, and its length in `n_chars` if there is such a column."""
    rows, names = inner(docs)
    out = pseudonymised(rows).select(*rows.columns)
    if "n_chars" in names:
        at = rows.columns[names.index("n_chars")]
        out = out.withColumn(at, F.length("text").cast(rows.schema[at].dataType))
    return out.toDF(*names)


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text")).selectExpr("doc_id", "text", "CAST(size(pii_kinds) AS long) AS n_replaced", "pii_kinds", "pii_spans")
