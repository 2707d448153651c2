"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, ``://``, plus signs, identifier cues, and the digits that
numeric kinds begin with.  Local parsers expand each anchor to the left and right and check the result.  Offsets are code
points, end exclusive.

The base kinds ``email, ip, card, phone`` follow fixed patterns: leftmost, non-overlapping per kind, matches that fail a
check are dropped without another try.  Parsers use possessive forms that give the same matches in linear time: a maximal
run of local-part characters before an at-sign, a digit run taken whole.  The method adds ``account`` (a value behind a cue
such as ``token =``; at least eight characters, then all that follow, with inner dots and closing equals signs), ``handle`` (an at-sign with a name and no address around it) and ``url`` (scheme to last URL
character).  Edge cases: null texts count as empty and have no spans; very long texts are read whole, in linear time; of
overlapping spans all are listed, and for masking the first in the text names the joint span, of ties the first kind in
alphabetical order; repeated rows give repeated results; an empty table gives none; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import arrow, plain

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "handle", "url")
REDACTED = ("email", "ip", "card", "phone", "account")

# Words that announce an identifier.
CUES = ("token", "api_key", "api-key", "apikey", "secret", "password", "passwd", "account", "iban", "ssn", "access_key", "auth")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"\s{0,3}(?:(?:is|no|number|nr)\b\.?\s{0,3})?[:=#]?\s{0,3}[\"']?([A-Za-z0-9_+/-]{8})")
_WHOLE = re.compile(r"[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+=*+")
_SCHEME = re.compile(r"[A-Za-z0-9+.-]")
_URL = re.compile(r"[^\s\"'<>|\\^`{}]+")
_HANDLE = re.compile(r"[A-Za-z0-9_]{2,}+")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, what in (("@", "at"), ("://", "scheme"), ("+", "plus")):
        a.add_word(word, (what, len(word)))
    for digit in "0123456789":
        a.add_word(digit, ("digit", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _run_before(text: str, at: int, low: int, one: re.Pattern) -> int:
    """Start of the maximal run of characters of class ``one`` that ends at ``at``, not before ``low``."""
    while at > low and one.match(text, at - 1):
        at -= 1
    return at


def find(text: str | None, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    after_email = after_phone = after_url = after_account = after_ip = after_card = barren = 0
    lone = []
    for last, (what, size) in anchors.iter(text):
        start = last + 1 - size
        if what == "digit":
            # a run of digits is taken whole, so only its first digit can begin a match
            if start >= after_card:
                m = _DIGITS.match(text, start)
                after_card = m.end()
                if after_card - start >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(m.span())
            if start >= after_ip and (m := _IP.match(text, start)):
                after_ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    spans["ip"].append(m.span())
        elif what == "at":
            if start < after_email:
                continue
            begin = _run_before(text, start, after_email, _LOCAL)
            if begin < start and (m := _DOMAIN.match(text, start + 1)):
                spans["email"].append((begin, m.end()))
                after_email = m.end()
            elif begin == start and (m := _HANDLE.match(text, start + 1)):
                lone.append((start, m.end()))
        elif what == "plus":
            if start >= after_phone and (m := _PHONE.match(text, start)):
                after_phone = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans["phone"].append(m.span())
        elif what == "scheme":
            begin = _run_before(text, start, after_url, _SCHEME)
            while begin < start and not ("a" <= text[begin].lower() <= "z"):
                begin += 1
            if begin < start and start >= after_url and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)"))
                if end > last + 1:
                    spans["url"].append((begin, end))
                    after_url = end
        elif start >= after_account and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            m = _VALUE.match(text, last + 1)
            # a start inside a value of too few digits has fewer still, so no run is read twice
            if m and m.start(1) > last + 1 and m.start(1) >= barren:
                m = _WHOLE.match(text, m.start(1))
                if sum(map(str.isdigit, m[0])) >= 3:
                    spans["account"].append(m.span())
                    after_account = m.end()
                else:
                    barren = m.end()
    spans["handle"] = lone
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = REDACTED) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k in kinds for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            found = [find(x.as_py(), anchors) for x in batch.column("text")]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    *(pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found], pa.string()),
                    pa.array([joined(f, KINDS) for f in found], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return arrow(plain(documents, "doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(documents: DataFrame, kinds: tuple[str, ...] = REDACTED) -> DataFrame:
    """All rows and columns, with the spans in ``text`` replaced and ``n_chars`` (if there) counted anew; null stays null."""
    names = [c.lower() for c in documents.columns]
    text, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            clean = []
            for x in batch.column(text):
                value = x.as_py()
                spans = find(value, anchors)
                clean.append(redact(value, spans, kinds) if any(spans[k] for k in kinds) else value)
            columns = list(batch.columns)
            columns[text] = pa.array(clean, batch.column(text).type)
            if size is not None:
                columns[size] = pa.array([None if v is None else len(v) for v in clean], batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow(documents, run, documents.schema)
