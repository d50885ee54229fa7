"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers find the spans around them.

One pass of the automaton over a text reports every at-sign, plus-digit, dot-digit, pair of digits, scheme mark and
identifier cue. A parser per kind of anchor expands it to the left and right and validates what it found. Nothing
else of the text is looked at.
"""

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The kinds in the order in which spans are listed. The first four have base spans, see ``base``.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE_KINDS = KINDS[:4]
ROWS_AT_ONCE = 256
Span = tuple[int, int, int, bool]  # number of the kind, start, end (exclusive), whether it is a base span

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_LINKED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_ADDRESS = re.compile(r"[^\s\"'<>`{}|\\^]+")
_HOST = re.compile(r"(?:localhost|[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?$")
_IBAN = re.compile(r"[\s:#.=-]{0,4}(([A-Z]{2}[0-9]{2})((?:[ ]?[A-Z0-9]){11,30}))")
_NUMBER = re.compile(r"(?:[ \t]*(?:numbers?|nos?|nr|num|id)\b\.?)?[ \t]*[:#=]?[ \t]*([A-Z]{0,3}[0-9](?:[ -]?[0-9]){4,19})(?![\w])", re.I)
_VALUE = re.compile(r"[ \t]*[=:][ \t]*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([\w./+=~-]{8,}))")
_NOT_AT_END = ".,;:!?)]}*&$%#"
_LONGEST_SCHEME = 20

_CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "a/c", "passport", "ssn", "social security", "tax id"),
    "secret": ("token", "password", "passwd", "api key", "api_key", "apikey", "secret", "access key"),
}


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton; a value is (kind of anchor, length)."""
    found = ahocorasick.Automaton()
    for cues, spellings in _CUES.items():
        for cue in spellings:
            for spelling in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                found.add_word(spelling, (cues, len(spelling)))
    for a in "0123456789":
        found.add_word(f"+{a}", ("phone", 2))
        found.add_word(f".{a}", ("ip", 2))
        for between in ("", " ", "-"):
            for b in "0123456789":
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the digits, every second one from the right doubled, add up to a multiple of ten."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def valid_iban(compact: str) -> bool:
    """Whether the check digits fit: the number with its head moved to the end is 1 modulo 97."""
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _back(text: str, at: int, floor: int, allowed) -> int:
    """Where the run of allowed characters that ends before ``at`` begins."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = _back(text, at, floor, _LOCAL)
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _wide_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address in letters of any script, if it keeps the rules for local parts and names of hosts."""
    start = at
    while start > max(floor, at - 65) and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
        start -= 1
    while start < at and text[start] in ".%+-":
        start += 1
    local = text[start:at]
    domain = _WIDE_DOMAIN.match(text, at + 1)
    if not domain or not 0 < len(local) <= 64 or local[-1] == "." or ".." in local:
        return None
    labels = domain.group().split(".")
    good = all(len(x) <= 63 and "_" not in x for x in labels) and len(labels[-1]) > 1 and labels[-1].isalpha()
    return (start, domain.end()) if good else None


def _ip(text: str, dot: int, floor: int) -> tuple[int, int] | None:
    start = _back(text, dot, floor, _DIGITS)
    found = _DOTTED.match(text, start) if start < dot else None
    return found.span() if found else None


def _url(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > max(floor, at - _LONGEST_SCHEME) and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    rest = _ADDRESS.match(text, at + 3) if at - start > 1 else None
    if not rest:
        return None
    found = rest.group().rstrip(_NOT_AT_END)
    host = re.split(r"[/?#]", found, maxsplit=1)[0].rpartition("@")[2]
    return (start, at + 3 + len(found)) if _HOST.match(host) else None


def _iban(text: str, end: int) -> tuple[int, int] | None:
    """The longest number behind the cue whose check digits fit."""
    found = _IBAN.match(text, end)
    if not found:
        return None
    start, written = found.start(1), found.group(1)
    for length in range(len(written), 14, -1):
        if written[length - 1] != " " and valid_iban(written[:length].replace(" ", "")):
            return start, start + length
    return None


def _account(text: str, end: int) -> tuple[int, int] | None:
    found = _NUMBER.match(text, end)
    return found.span(1) if found else None


def _secret(text: str, end: int) -> tuple[int, int] | None:
    found = _VALUE.match(text, end)
    if not found:
        return None
    place = next(i for i in (1, 2, 3) if found.group(i) is not None)
    plain = place == 3 and not any(c in _DIGITS for c in found.group(3))  # an ordinary word
    return None if plain else found.span(place)


def _n_digits(text: str) -> int:
    return sum(c in _DIGITS for c in text)


def _in_byte(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or 0) <= 255


def spans(text: str) -> list[Span]:
    """All spans of a text, by kind, then start, then end.

    Base spans of a kind are those that its pattern finds from left to right without overlap, as far as they
    pass the kind's test; a span that fails it takes its characters all the same. The others may overlap them.
    """
    found: set[Span] = set()
    ends = dict.fromkeys(KINDS, 0)  # of the last span of a kind, whether it passed or not
    wide_end = 0
    for last, (kind, length) in anchors().iter(text):
        at = last + 1 - length
        if kind == "email":
            base = _email(text, at, ends["email"])
            if base:
                ends["email"] = base[1]
                found.add((0, *base, True))
            wide = _wide_email(text, at, wide_end)
            if wide:
                wide_end = wide[1]
                if wide != base and (base is None or (wide[0] <= base[0] and wide[1] >= base[1])):
                    found.add((0, *wide, False))
        elif kind == "ip":
            span = _ip(text, at, ends["ip"])
            if span:
                ends["ip"] = span[1]
                if all(map(_in_byte, text[span[0] : span[1]].split("."))):
                    found.add((1, *span, True))
        elif kind == "card":
            if at >= ends["card"]:  # the first pair of a chain; the others lie within it
                ends["card"] = end = _LINKED.match(text, at).end()
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.add((2, at, end, True))
        elif kind == "phone":
            span = _DIALLED.match(text, at)
            if span and 9 <= _n_digits(span.group()) <= 15:
                found.add((3, *span.span(), True))
        elif kind == "url":
            if at >= ends["url"] and (span := _url(text, at, ends["url"])):
                ends["url"] = span[1]
                found.add((4, *span, False))
        elif at >= ends[kind] and not (at and text[at - 1].isalnum()):
            parse = {"iban": _iban, "account": _account, "secret": _secret}[kind]
            span = parse(text, last + 1)
            if span:
                ends[kind] = span[1]
                found.add((KINDS.index(kind), *span, False))
    return sorted(found)


_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(begin, ROWS_AT_ONCE)
        yield part, [x or "" for x in part.column("text").to_pylist()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _texts(batch):
            rows = [[(KINDS[k], s, e, b) for k, s, e, b in spans(text)] for text in texts]
            offsets = pa.array([0, *[len(r) for r in rows]], pa.int32()).to_numpy().cumsum()
            flat = [x for r in rows for x in r]
            values = pa.StructArray.from_arrays(
                [pa.array([x[i] for x in flat], f.type) for i, f in enumerate(_STRUCT)], fields=list(_STRUCT)
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` per row: kind, start and end (code points, end exclusive) and whether it is a base span.

    Spans come by kind as in KINDS, then start, then end. A null or empty text has none. Repeated rows stay
    repeated, a null id stays null, other columns are not read, an empty table gives no row. Whole texts are read; a task
    holds those of one Arrow batch.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def masked(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans are one, named after the first."""
    pieces, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in spans(text)):
        if start >= at:
            pieces += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(pieces) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind in angle brackets; all columns, a null text stays null."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                missing = part.column("text").is_null().to_pylist()
                new = pa.array([None if m else masked(t) for t, m in zip(texts, missing)], pa.string())
                columns = [new if i == place else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def listed(found: Column) -> Column:
    """kind:start:end of all spans of an array, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base(found: Column, kind: str | None = None) -> Column:
    return F.filter(found, lambda s: s["base"] if kind is None else s["base"] & (s["kind"] == kind))
