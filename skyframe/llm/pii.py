"""Personal data in whole texts, also where it is disguised; spans are code points of the source.

Two transducers rewrite a text and keep, for every character they write, the source characters it stands for. The first maps look-alike characters
to ASCII and drops invisible ones. The second maps spelled digits, spelled signs and at/dot disguises. The same detectors run on the source (base
spans) and on the rewritten text; spans of the latter that rest on a rewritten character are mapped back and added. Base spans always stay.
Nothing is shuffled, and a task holds one Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The formats of personal data.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Cyrillic and Greek letters that look like Latin ones, and marks that look like ASCII signs.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T",
    "У": "Y", "Х": "X", "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y",
    "х": "x", "ԁ": "d", "һ": "h", "ո": "n", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ı": "i", "ǀ": "l", "‐": "-", "‑": "-",
    "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _ascii_of(code: int) -> str | None:
    """The ASCII character that a digit of any script, or a wide or styled form, stands for."""
    char = chr(code)
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    if unicodedata.decomposition(char).startswith(("<wide>", "<font>")):
        plain = unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and plain.isascii():
            return plain
    return None


SPACES = {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F)}
LETTERS = SPACES | {ord(k): v for k, v in LOOK_ALIKES.items()} | {c: a for c in range(0x80, 0x20000) if (a := _ascii_of(c)) is not None}
TRACE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(LETTERS)) + INVISIBLE + "]")
HIDDEN = re.compile(f"[{INVISIBLE}]")
DIGIT = "(?:" + "|".join(DIGITS) + ")"
GAP = r"[ \t]{1,3}"
BRACKETED = r"[ \t]{0,3}[\[({<][ \t]{0,3}%s[ \t]{0,3}[\])}>][ \t]{0,3}"
SPELLED = re.compile(
    rf"(?P<digit>(?<![A-Za-z]){DIGIT}(?![A-Za-z]))"
    rf"|(?P<plus>(?<![A-Za-z])plus(?:{GAP}|-)(?={DIGIT}(?![A-Za-z])|[0-9]))"
    rf"|(?P<at>{BRACKETED % 'at'})"
    rf"|(?P<dot>{BRACKETED % '(?:dot|point|[.])'}|{GAP}dot{GAP}|{GAP}point{GAP}(?={DIGIT}(?![A-Za-z])|[0-9]))"
    rf"|(?P<spaced>{GAP}at{GAP}(?=[A-Za-z0-9-]+(?:(?:{GAP}|[ \t]{{0,3}}[\[({{<][ \t]{{0,3}})dot[ \t\])}}>])))", re.IGNORECASE)
# What makes a text worth rewriting, on lower-case UTF-8: patterns that start with plain bytes, since most texts hold none of these.
NEXT = rb"[ \t,.-]{1,3}(?:%s|dot|point|[0-9])" % DIGIT.encode()
CLUES = {w.encode(): re.compile(b"%s(?<![a-z]%s)(?![a-z])%s" % (w.encode(), w.encode(), NEXT)) for w in [*DIGITS, "plus"]}
CLUES |= {w: re.compile(b"%s(?<=[ \t]%s)[ \t]" % (w, w)) for w in (b"dot", b"point")}
OTHER_CLUES = re.compile(rb"[\[({<0-9](?:(?<![0-9])[ \t]{0,3}(?:at|dot|point|[.][ \t]{0,3}[\])}>])|(?<=[0-9])[ \t,.-]{1,3}%s(?![a-z]))" % DIGIT.encode())
OFTEN = bytes(b for b in range(256) if b < 0xC0 or b == 0xC3)
CLUSTER = re.compile(r"[+0-9][\x20().0-9-]*")
SHORTEST = 7


def _clue(text: str) -> bool:
    low = text.encode("utf-8", "surrogatepass").lower()
    return any(w in low and p.search(low) for w, p in CLUES.items()) or OTHER_CLUES.search(low) is not None


BETWEEN = re.compile(r"[ \t,-]{1,3}\Z")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then start; leftmost, not overlapping within a kind. Time follows the length of the text."""
    found, end, sign = [], 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = DOMAIN.match(text, sign + 1) if start < sign else None
        if host:
            end = host.end()
            found.append(("email", start, end))
        else:
            end = sign + 1
        sign = text.find("@", end)
    runs = [(m.start(), m.end()) for m in CLUSTER.finditer(text) if m.end() - m.start() >= SHORTEST]
    for lo, hi in runs:
        for m in ADDRESS.finditer(text, lo, hi):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    for lo, hi in runs:
        for m in CARD.finditer(text, lo, hi):
            if m.end() - m.start() >= 13:
                digits = re.sub("[ -]", "", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", m.start(), m.end()))
    for lo, hi in runs:
        m = PHONE.match(text, lo, hi)
        if m and 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def rewrite(text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """The rewritten text with, per written character, source start, source end and whether it was rewritten; None if there is nothing to rewrite."""
    traced = not text.isascii() and text.encode("utf-8", "surrogatepass").translate(None, OFTEN) and TRACE.search(text)
    if not traced and not _clue(text):
        return None
    start = np.arange(len(text), dtype=np.int64)
    end, changed, plain = start + 1, np.zeros(len(text), dtype=bool), text
    if traced:
        plain = text.translate(LETTERS)
        changed = np.array([ord(a) in LETTERS for a in text], dtype=bool)
        hidden = [m.start() for m in HIDDEN.finditer(plain)]
        if hidden:
            kept = np.ones(len(text), dtype=bool)
            kept[hidden] = False
            after = [i + 1 for i in hidden if i + 1 < len(text)]
            changed[after] = True
            start, end, changed = start[kept], end[kept], changed[kept]
            plain = HIDDEN.sub("", plain)
    if not _clue(plain):
        return plain, start, end, changed
    out, parts, at, last_digit = [], [], 0, None

    def copy(lo: int, hi: int) -> None:
        if hi > lo:
            out.append(plain[lo:hi])
            parts.append((start[lo:hi], end[lo:hi], changed[lo:hi]))

    for m in SPELLED.finditer(plain):
        lo, hi, kind = m.start(), m.end(), m.lastgroup
        joined = kind == "digit" and last_digit is not None and BETWEEN.fullmatch(plain, last_digit, lo)
        if not joined:
            copy(at, lo)
        new = DIGITS[m[0].lower()] if kind == "digit" else {"plus": "+", "at": "@", "spaced": "@", "dot": "."}[kind]
        out.append(new)
        parts.append((start[lo:lo + 1], end[hi - 1:hi], np.ones(1, dtype=bool)))
        at, last_digit = hi, hi if kind == "digit" else None
    copy(at, len(plain))
    if not parts:
        return plain, start, end, changed
    return ("".join(out), *(np.concatenate([p[i] for p in parts]) for i in range(3)))


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, start, end. Null texts count as empty."""
    text = text or ""
    base = detect(text)
    spans = {(KINDS.index(k), a, b): True for k, a, b in base}
    written = rewrite(text)
    if written is not None:
        plain, start, end, changed = written
        total = np.concatenate(([0], np.cumsum(changed)))
        for kind, a, b in detect(plain):
            if total[b] > total[a]:
                spans.setdefault((KINDS.index(kind), int(start[a]), int(end[b - 1])), False)
    return [(KINDS[k], a, b, spans[k, a, b]) for k, a, b in sorted(spans)]


def masked(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b, _ in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, spans, and with `mask` the masked text. Other columns are not read; null ids and repeated rows stay."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            spans = [find_spans(t) for t in texts]
            columns = [batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in x] for x in spans], kind)]
            if mask:
                columns.append(pa.array(map(masked, texts, spans), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "masked"][: len(columns)])

    schema = f"doc_id long, spans {SPANS}" + ", masked string" * mask
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with personal data masked in the text; a column n_chars follows the new length. Null texts stay null."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, find_spans(t)) if t else t for t in texts], dtype=object)

    out = docs.withColumn(text_col, hide(text_col))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined_spans(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
