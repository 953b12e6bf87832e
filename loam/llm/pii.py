"""Personal data by offset-preserving deobfuscation.

Detectors for emails, IPv4 addresses, payment cards and phone numbers run twice: on the text as it is (the base spans), and on a normal form that small transducers write, which undo homoglyphs, spelled digits and at/dot disguises and remember for every character they write which source characters it stands for. Spans found only in the normal form are mapped back and added where they touch no base span of their kind.

Defined results: null and empty texts have no spans; texts of any length take linear time; repeated rows each get their own result; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from loam.llm.common import arrow, column, map_batches, texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches that don't overlap. The local part can't hold an @, so it starts after the previous @ or match at the earliest: linear time."""
    low, at = 0, text.find("@")
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        low = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", low)


def ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield m.span()


_DIGIT = re.compile("[0-9]")


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, f in ((1, ips), (2, cards), (3, phones)):
            out += [(s, k, e) for s, e in f(text)]
    return sorted(out)


# Look-alike characters and what they stand for, the words for digits in four languages, and the words for "at" and "dot".
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "ѵ": "v", "ӏ": "l", "ү": "y", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ϲ": "c", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "\u2024": ".", "\u3002": ".", "\ufe52": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-", "\ufe6b": "@", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")
SPOKEN_DOTS = ("dot", "punkt", "punto")  # without brackets; "at the point of" is no address

_DROPPED = dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad", "")
_WIDE = re.compile(r"[^\x00-\x7f]")


@functools.lru_cache(1 << 16)
def plain_form(c: str) -> str | None:
    """The ASCII character that a character stands for (none for invisible ones), or None: look-alikes from the table, digits of any script, and styled letters and signs (full-width, mathematical, circled, raised) by their compatibility form."""
    if c in _DROPPED or c in HOMOGLYPHS:
        return _DROPPED[c] if c in _DROPPED else HOMOGLYPHS[c]
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    form = HOMOGLYPHS.get(form, form)
    return form if len(form) == 1 and form.isascii() else None


_OPEN = re.compile(r"[\[({<]\s{0,3}(?:[@.]|[A-Za-z]{2,11}\s{0,3}[\])}>])")
_DIGIT_SET, _AT_SET, _DOT_SET = map(frozenset, (DIGIT_WORDS, AT_WORDS, SPOKEN_DOTS))


@functools.cache
def _rules():
    at, dot, digit = ("|".join(sorted(x, key=lambda w: -len(w))) for x in (AT_WORDS, DOT_WORDS, DIGIT_WORDS))
    part, end = r"[A-Za-z0-9_%+-]{1,64}", r"(?![A-Za-z0-9_%+@-]|\.[A-Za-z0-9._%+-]{1,64}@)"
    opened, closed = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
    hide_at = re.compile(rf"(?<=[A-Za-z0-9]){opened}(?:{at}|@){closed}(?=[A-Za-z0-9])", re.I)
    hide_dot = re.compile(rf"(?<=[A-Za-z0-9]){opened}(?:{dot}|\.){closed}(?=[A-Za-z0-9])", re.I)
    spoken = "|".join(SPOKEN_DOTS)
    chain = rf"{part}(?:(?:\s(?:{spoken})\s|\.){part})"
    plain = re.compile(rf"(?<![A-Za-z0-9._%+-])({chain}{{0,4}})(\s(?:{at})\s)({chain}{{1,4}}){end}", re.I)
    signed = re.compile(rf"(?<![A-Za-z0-9._%+-])({chain}{{0,4}})@({chain}{{1,4}})", re.I)
    plain_dot = re.compile(rf"\s(?:{spoken})\s", re.I)
    spelled = re.compile(rf"(?<!\w)(?:(?:plus\s)?(?:{digit})(?:[\s-](?:{digit}|\d+))*[\s-](?:{digit}))(?!\w)", re.I)
    word = re.compile(rf"plus\s|(?:{digit})", re.I)
    return hide_at, hide_dot, plain, signed, plain_dot, spelled, word


class Tape:
    """A text with the source span of every character, as two arrays; a step rewrites some spans and keeps the map."""

    def __init__(self, text: str):
        self.text, self.starts = text, np.arange(len(text), dtype=np.int32)
        self.ends = self.starts + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans (start, end, new), in order and apart. Characters of new stand for the whole span."""
        if not edits:
            return
        parts, starts, ends, low = [], [], [], 0
        for s, e, new in edits:
            parts += [self.text[low:s], new]
            starts += [self.starts[low:s], np.full(len(new), self.starts[s], np.int32)]
            ends += [self.ends[low:s], np.full(len(new), self.ends[e - 1], np.int32)]
            low = e
        self.text = "".join([*parts, self.text[low:]])
        self.starts, self.ends = np.concatenate([*starts, self.starts[low:]]), np.concatenate([*ends, self.ends[low:]])


def _spoken_ats(tape: Tape, plain: re.Pattern, plain_dot: re.Pattern):
    """Edits for a spoken "at" before a domain with a dot that is spoken or was written from brackets; an undisguised one alone is prose ("meet at example.com")."""
    m = plain.search(tape.text)
    while m:
        s, e = m.span(3)
        dots = [(x.start(), x.end(), ".") for x in plain_dot.finditer(tape.text, s, e)]
        if dots or any(tape.text[i] == "." and tape.ends[i] - tape.starts[i] > 1 for i in range(s, e)):
            yield from ((x.start(), x.end(), ".") for x in plain_dot.finditer(tape.text, *m.span(1)))
            yield (*m.span(2), "@")
            yield from dots
            m = plain.search(tape.text, e)
        else:
            m = plain.search(tape.text, s)


def normalise(text: str) -> Tape | None:
    """The text after the transducers, or None where none of them has anything to do."""
    hide_at, hide_dot, plain, signed, plain_dot, spelled, word = _rules()
    strange = not text.isascii() and any(plain_form(c) is not None for c in set(_WIDE.findall(text)))
    hidden = _OPEN.search(text)
    words = text.lower().replace("-", " ").split()
    digits = strange or not _DIGIT_SET.isdisjoint(words)
    at, dot = not _AT_SET.isdisjoint(words), not _DOT_SET.isdisjoint(words)
    parted = strange or (at and dot) or ((at or dot) and (hidden or "@" in text))
    if not (strange or hidden or digits or parted):
        return None
    tape = Tape(text)
    if strange:
        tape.rewrite([(m.start(), m.end(), new) for m in _WIDE.finditer(text) if (new := plain_form(m[0])) is not None])
    for rule, new in ((hide_at, "@"), (hide_dot, ".")):
        tape.rewrite([(m.start(), m.end(), new) for m in rule.finditer(tape.text)])
    if parted:
        tape.rewrite(list(_spoken_ats(tape, plain, plain_dot)))
        tape.rewrite([(x.start(), x.end(), ".") for m in signed.finditer(tape.text) for x in plain_dot.finditer(tape.text, *m.span())])
    edits = []
    for m in spelled.finditer(tape.text) if digits else ():
        marks = list(word.finditer(tape.text, m.start(), m.end()))
        for x, y in zip(marks, [*marks[1:], None], strict=True):
            new = "+" if x[0].lower().startswith("plus") else DIGIT_WORDS[x[0].lower()]
            end = y.start() if y is not None and not any(map(str.isdigit, tape.text[x.end() : y.start()])) else x.end()
            edits.append((x.start(), end, new))
    tape.rewrite(edits)
    return tape


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, as (start, kind's number, end) over the source."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    more = set()
    for s, k, e in detect(tape.text):
        span = (int(tape.starts[s]), k, int(tape.ends[e - 1]))
        if text[span[0] : span[2]] != tape.text[s:e] and not any(k == b[1] and span[0] < b[2] and b[0] < span[2] for b in base):
            more.add(span)
    return base, sorted({*base, *more}) if more else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the counts and digest of its base spans, and all its spans."""

    def run(b):
        rows = []
        for x in texts(b, text_col):
            base, every = find(x)
            n = [0, 0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            w = written(base)
            rows.append((*n, hashlib.sha256(w.encode()).hexdigest(), w if every is base else written(every)))
        names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
        return {"doc_id": column(b, id_col)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(docs.select(id_col, text_col), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str) -> str:
    """Every span becomes its kind in brackets; spans that touch each other become one, named by the first."""
    out, low = [], 0
    for s, k, e in find(text)[1]:
        if s >= low:
            out += [text[low:s], f"[{KINDS[k].upper()}]"]
        low = max(low, e)
    return "".join([*out, text[low:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            new = pa.array([None if x is None else redact_text(x) for x in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, b.schema.field(at).name, new)

    return arrow(docs, run, docs.schema)
