"""Personal data in whole texts, also where it is disguised.

Base spans come from the source text. A chain of transducers then rewrites disguises
(look-alike characters, spelled digits, words and brackets for ``@`` and ``.``) while it
keeps, for every character it writes, the range of source characters it stands for. The
same detectors run over the rewritten text and their spans are mapped back to source
characters. A mapped span is added if it used a rewriting and does not lie inside a base
span; base spans stay. Two limits are part of the rules: letters that pass for digits
(``O``, ``l``) are read as such in runs of at most 42 characters, and a bare ``at`` counts
only before a disguised dot and a known last label.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankframe.llm.common import tune

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a match can't begin inside a run of digits, so looking behind keeps the scan linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern. A match holds the characters before one
    ``@``, so looking at each ``@`` in turn finds them all in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base rules, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- transducers -------------------------------------------------------------------------

#: Characters that pass for others, and characters that are not seen.
LOOKALIKES = dict(zip(
    "аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅοαντρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧıℓ‐‑‒–—−﹣․﹒。｡·﹫　   ",
    "aeopcyxijshdqwABEKMHOPCTXYIJSoavtpikABEZHIKMNOPTYXil-------.....@    ",
))
HIDDEN = "​‌‍⁠﻿­"
_STYLED = "！-～①-⑳Ⓐ-ⓩ\U0001d400-\U0001d7ff"
_DIGITS_ELSEWHERE = "٠-٩۰-۹०-९০-৯๐-๙"
_ODD = re.compile(f"[{''.join(re.escape(c) for c in LOOKALIKES)}{HIDDEN}{_STYLED}{_DIGITS_ELSEWHERE}]")

#: Names of the digits in four languages.
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NAME = "(?:" + "|".join(sorted(DIGIT_NAMES, key=len, reverse=True)) + ")"
_DOT_NAME = "(?:dot|punkt|point|punto)"
_DOT_SIGN = rf"(?:[\[({{<] ?(?:{_DOT_NAME}|\.) ?[\])}}>]|(?<=[\s-]){_DOT_NAME}(?=[\s-]))"
_UNIT = rf"(?:{_NAME}(?!\w)|[0-9]+)"
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus[\s-]{{1,3}})?{_UNIT}(?:(?:[\s-]{{0,3}}{_DOT_SIGN}[\s-]{{0,3}}|[\s,.()-]{{1,3}}){_UNIT}){{2,}}(?!\w)")
_SPELLED_HINT = re.compile(rf"(?i)(?<!\w){_NAME}(?!\w)|[0-9][\s-]{{0,3}}{_DOT_SIGN}")
_SPELLED_PART = re.compile(rf"(?i)(?P<plus>plus[\s-]{{1,3}})|(?P<name>{_NAME})(?!\w)|(?P<digits>[0-9]+)|(?P<dot>[\s-]{{0,3}}{_DOT_SIGN}[\s-]{{0,3}})|(?P<gap>[\s,.()-]{{1,3}})")

_LABEL = r"[A-Za-z0-9-]+"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_DOT_NAME}|\.)\s*[\])}}>]\s*|\s+{_DOT_NAME}\s+)"
#: Last labels of domains that are spelled out without any sign.
TOP_LABELS = frozenset("com org net edu gov info biz io de fr es uk us eu co me ai dev app ch at it nl be ru cn jp br mx ca au in".split())
# every alternative begins with a sign or a word, so runs of blanks are passed over once
_DISGUISED_AT = re.compile(
    rf"(?i)[\[({{<]\s*(?:at|arroba|@)\s*[\])}}>]\s*(?={_LABEL}(?:\.|{_DOT}){_LABEL})"
    # a bare "at" is a common word: it counts only with a disguised dot after it
    rf"|(?P<bare>(?<=\s)(?:at|arroba)\s+)(?={_LABEL}{_DOT}{_LABEL})|@(?={_LABEL}{_DOT}{_LABEL})"
)
_DOMAIN_AFTER = re.compile(rf"(?i){_LABEL}(?:(?:\.|{_DOT}){_LABEL})+")
_DOT_ONLY = re.compile(rf"(?i){_DOT}")
_AT_HINT = re.compile(rf"(?i)[\[({{<]\s*(?:at|arroba|@)\s*[\])}}>]|\s{_DOT_NAME}\s|[\[({{<]\s*(?:{_DOT_NAME}|\.)\s*[\])}}>]")
_LOCAL_LABEL = _LOCAL - {"."}
_DOT_NAMES = ("dot", "punkt", "point", "punto")

_LETTERED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI][0-9OolI ().-]{8,40}[0-9OolI](?![A-Za-z0-9])")
_AS_DIGIT = str.maketrans("OolI", "0011")


class Tape:
    """Text with the source range of each of its characters."""

    def __init__(self, text: str, start: list[int] | range | None = None, end: list[int] | range | None = None):
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ranges (sorted, apart) by texts; a text's characters stand for its whole range,
        but a text as long as its range goes character by character."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a]), start.extend(self.start[at:a]), end.extend(self.end[at:a])
            text.append(new)
            if len(new) == b - a:
                start.extend(self.start[a:b]), end.extend(self.end[a:b])
            elif new:
                start.extend([self.start[a]] * len(new)), end.extend([self.end[b - 1]] * len(new))
            at = b
        return Tape("".join(text), start, end)


def _plain(c: str) -> str:
    if c in HIDDEN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) == "Nd":
        return str(d)
    return unicodedata.normalize("NFKC", c)


def undo_lookalikes(tape: Tape) -> Tape:
    return tape.rewritten([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(tape.text)])


def undo_spelled_digits(tape: Tape) -> Tape:
    """Spelled digits next to digits or other spelled digits, and dots written out between them."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        before, gap = "", None
        for p in _SPELLED_PART.finditer(m[0]):
            a, b, kind = m.start() + p.start(), m.start() + p.end(), p.lastgroup
            if kind == "gap":
                gap = (a, b)
                continue
            if kind == "name" and before == "name" and gap:
                edits.append((*gap, ""))  # "five five" is 55
            if kind != "digits":
                edits.append((a, b, {"plus": "+", "name": DIGIT_NAMES.get(p[0].lower(), ""), "dot": "."}[kind]))
            before, gap = kind, None
    return tape.rewritten(edits)


def undo_lettered_digits(tape: Tape) -> Tape:
    edits = []
    for m in _LETTERED.finditer(tape.text):
        letters = sum(c in "OolI" for c in m[0])
        if 0 < letters < sum("0" <= c <= "9" for c in m[0]):
            edits.append((m.start(), m.end(), m[0].translate(_AS_DIGIT)))
    return tape.rewritten(edits)


def _blanks_before(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1].isspace():
        at -= 1
    return at


def _dot_before(text: str, at: int, floor: int) -> int | None:
    """Where a disguised dot that ends at ``at`` begins."""
    a = _blanks_before(text, at, floor)
    closed = a > floor and text[a - 1] in "])}>"
    if not closed and a == at:
        return None
    word_end = _blanks_before(text, a - 1, floor) if closed else a
    name = next((n for n in (*_DOT_NAMES, *("." if closed else "")) if text[max(floor, word_end - len(n)) : word_end].lower() == n), None)
    if name is None:
        return None
    a = word_end - len(name)
    b = _blanks_before(text, a, floor)
    if not closed:
        return b if b < a else None
    return _blanks_before(text, b - 1, floor) if b > floor and text[b - 1] in "[({<" else None


def _local_before(text: str, end: int, floor: int) -> tuple[int, list[tuple[int, int]]]:
    """Start of the local part that ends at ``end`` (``end``: none) and its disguised dots."""
    start, dots, waiting, at = end, [], [], end
    while True:
        a = at
        while a > floor and text[a - 1] in _LOCAL_LABEL:
            a -= 1
        if a == at:
            return start, dots
        start, dots = a, dots + waiting
        if a > floor and text[a - 1] == ".":
            waiting, at = [], a - 1
            continue
        dot = _dot_before(text, a, floor)
        if dot is None:
            return start, dots
        waiting, at = [(dot, a)], dot


def undo_at_and_dot(tape: Tape) -> Tape:
    edits, text, end = [], tape.text, 0
    for m in _DISGUISED_AT.finditer(text):
        if m.start() < end:
            continue
        left = _blanks_before(text, m.start(), end)
        start, dots = _local_before(text, left, end)
        if start == left:
            continue
        domain = _DOMAIN_AFTER.match(text, m.end())
        if m["bare"] and re.split(r"[^A-Za-z0-9]+", domain[0])[-1].lower() not in TOP_LABELS:
            continue
        edits += [(a, b, ".") for a, b in reversed(dots)]
        edits.append((left, m.end(), "@"))
        edits += [(m.end() + d.start(), m.end() + d.end(), ".") for d in _DOT_ONLY.finditer(domain[0])]
        end = domain.end()
    return tape.rewritten(edits)


_DASHES = frozenset("‐‑‒–—−﹣")


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in source characters."""
    tape = source = Tape(text)
    if _ODD.search(text):
        tape = undo_lookalikes(tape)
    if _SPELLED_HINT.search(tape.text):
        tape = undo_spelled_digits(tape)
    if _LETTERED.search(tape.text):
        tape = undo_lettered_digits(tape)
    if _AT_HINT.search(tape.text):
        tape = undo_at_and_dot(tape)
    if tape is source:
        return []
    starts, reach = [s for s, _, _ in base], [0]
    for _, _, e in base:
        reach.append(max(reach[-1], e))
    out = []
    for s, kind, e in detect(tape.text):
        a, b = tape.start[s], tape.end[e - 1]
        if text[a:b] == tape.text[s:e] or reach[bisect_right(starts, a)] >= b:
            continue
        # a dash between words isn't part of the address after it
        if kind == 0 and reach[bisect_left(starts, b)] > a and _DASHES.intersection(text[a:b]):
            continue
        out.append((a, kind, b))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each sorted by start and kind."""
    base = detect(text)
    more = added(text, base)
    return base, sorted(base + more) if more else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans, extra = [[] for _ in KINDS], [], [], []
        for text in batch.column(1).to_pylist():
            base, full = scan(text or "")
            kinds = [k for _, k, _ in full]
            for k, c in enumerate(counts):
                c.append(kinds.count(k))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(full))
            extra.append(len(full) - len(base))
        columns = [batch.column(0)] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_disguised"])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_email, n_ip, n_card,
    n_phone`` (all spans), ``base_sha256, spans, n_disguised``.

    Spans are ``kind:start:end`` in code points. Null text is empty; a text without spans
    has empty ``spans``; repeated rows give repeated rows; an empty table gives none.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")
