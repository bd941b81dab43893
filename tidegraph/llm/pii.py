"""Personal data: patterns propose spans, validators confirm them, context scores them.

Kinds and their validators: ``email`` (pattern only), ``ip`` (four parts of at most
255), ``card`` (12 to 19 digits passing Luhn), ``phone`` (9 to 15 digits) and ``iban``
(country, check digits and mod-97).  A confirmed span starts at its kind's base score;
words of its kind within ``CONTEXT`` characters raise the score, words that mark a
number as something else lower it.  Spans of the first four kinds are always
reported; an ``iban`` only from ``MIN_SCORE``, so one beside a word against it needs a
word for it as well.  An ``iban`` ends at the last word end that makes it valid.

The work is a narrow map over the rows (no shuffle).  Patterns are written so that no
text makes them back up more than once over a run.  Null and empty texts have no span;
repeated rows are searched alike; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
CONTEXT = 48
MIN_SCORE = 0.5
BASE_SCORE = {"email": 0.95, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.7}
#: Words that speak for a kind, and words that speak against any.
FOR_WORDS = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST_WORDS = ("version", "order", "isbn", "serial", "example", "sku")

#: A local part ends at its "@", so candidates are found by "@" and grown to the left.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_GOES_ON = re.compile(r"[A-Za-z0-9]")
_DIGIT = re.compile(r"[0-9]")
_LUHN_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    last = [int(d) for d in reversed(digits)]
    return (sum(last[::2]) + sum(_LUHN_TWICE[d] for d in last[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid numbers; what follows one (a currency, a bank code, another number) may look like its end."""
    found = _IBAN.search(text)
    while found:
        start, at = found.start(), found.start() + 1
        for end in range(found.end(), start + 14, -1):
            if text[end - 1] != " " and not _GOES_ON.match(text, end) and _valid("iban", text[start:end]):
                yield start, end
                at = end
                break
        found = _IBAN.search(text, at)


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "iban":
        plain = found.replace(" ", "")
        return 15 <= len(plain) <= 34 and mod97(plain)
    digits = re.sub(r"[^0-9]", "", found)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    score = BASE_SCORE[kind]
    if any(word in around for word in FOR_WORDS[kind]):
        score = min(1.0, score + 0.2)
    if any(word in around for word in AGAINST_WORDS):
        score = max(0.0, score - 0.3)
    return score


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) in code points, by start and then kind."""
    text = text or ""
    proposed = [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        proposed += [(s, e, "iban") for s, e in _ibans(text)]
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            proposed += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m.group())]
    scored = [(s, e, kind, _score(kind, text, s, e)) for s, e, kind in proposed]
    kept = [x for x in scored if x[2] != "iban" or x[3] >= MIN_SCORE]
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans as one."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


SPAN_TYPE = "array<struct<start:bigint,end:bigint,kind:string,score:double>>"


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per input row."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
        names = ("start", "end", "kind", "score")
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(search, f"doc_id bigint, spans {SPAN_TYPE}")


def redact_rows(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with redacted texts and their new length, columns and order of columns unchanged."""
    at, schema = df.columns.index(text_col), df.schema
    size = df.columns.index(length_col) if length_col in df.columns else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            if size is not None:
                old = batch.column(size)
                lengths = [o if t is None else len(t) for t, o in zip(texts, old.to_pylist(), strict=True)]
                columns[size] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(rewrite, schema)
