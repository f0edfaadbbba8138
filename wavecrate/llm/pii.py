"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a whole text in one pass: at
signs, dotted and joined digits, plus signs before digits, schemes and identifier
cues. From each anchor a local parser walks out to the boundaries of the address,
number or account and validates it; nothing else of the text is looked at. Per
kind, candidates come from left to right and never overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.rows import row_key
from wavecrate.shipping import ship

BASE = ("email", "ip", "card", "phone")
#: What the method finds besides: credentials in an address, and identifiers after a cue.
ADDED = ("uri", "account")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
JOINED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"[\x20().0-9-]+")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
AUTHORITY = re.compile(r"[^\s/?#@:\"'<>]+(?::[^\s/?#@\"'<>]*)?@[^\s/?#@\"'<>]+")
#: Between a cue and its identifier.
GAP = re.compile(r"\s{0,3}(?:(?:no|nr|number)\b\.?\s{0,3})?[:#=]?\s{0,3}", re.IGNORECASE)
#: Cues and the shape of what follows them.
CUES = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
    "passport": re.compile(r"(?=[A-Z0-9]*[0-9]{5})[A-Z0-9]{6,9}(?![A-Za-z0-9])"),
    "account": re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![A-Za-z0-9])"),
}
CUES |= dict.fromkeys(("reisepass", "passeport", "pasaporte"), CUES["passport"])
CUES |= dict.fromkeys(("konto", "kontonummer", "compte", "cuenta"), CUES["account"])


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    add: dict[str, tuple[str, int]] = {"@": ("email", 1), "://": ("uri", 3)}
    for x in "0123456789":
        add["+" + x] = ("phone", 2)
        for y in "0123456789":
            add[x + "." + y] = ("ip", 3)
            for gap in ("", " ", "-"):
                add[x + gap + y] = ("card", 2 + len(gap))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            add[form] = (cue, len(form))
    for word, value in add.items():
        a.add_word(word, value)
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, from left to right."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    if not text:
        return out
    free = dict.fromkeys(out, 0)  # by kind, where the next candidate may start
    n = len(text)
    for last, (kind, size) in AUTOMATON.iter(text):
        at = last - size + 1
        if kind == "card":
            if at < free["card"]:
                continue
            end = JOINED.match(text, at).end()
            free["card"] = end
            digits = text[at:end].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append((at, end))
        elif kind == "email":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1)
            if m and start < at:
                out["email"].append((start, m.end()))
                free["email"] = m.end()
        elif kind == "ip":
            if at < free["ip"]:
                continue
            start = at
            while start > free["ip"] and text[start - 1] in DIGITS:
                start -= 1
            end = DOTTED.match(text, start).end()
            groups = text[start:end].split(".")
            for k in range(0, len(groups) - 3, 4):
                four = groups[k : k + 4]
                stop = start + sum(map(len, four)) + 3
                if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                    out["ip"].append((start, stop))
                start = stop + 1
            free["ip"] = end
        elif kind == "phone":
            if at < free["phone"]:
                continue
            m = DIALLED.match(text, at + 2)
            end = m.end() if m else at + 2
            while end > at + 2 and text[end - 1] not in DIGITS:
                end -= 1
            if end > at + 3:
                free["phone"] = end
                if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    out["phone"].append((at, end))
        elif kind == "uri":
            m = AUTHORITY.match(text, at + 3)
            s = SCHEME.search(text, max(free["uri"], at - 20), at) if m else None
            if s:
                out["uri"].append((s.start(), m.end()))
                free["uri"] = m.end()
        else:
            if at < free["account"] or (at and text[at - 1].isalnum()) or (last + 1 < n and text[last + 1].isalnum()):
                continue
            start = GAP.match(text, last + 1).end()
            m = CUES[kind].match(text, start)
            while m and kind == "iban" and not iban(m[0]):  # the shape may have taken a word that follows
                cut = m[0].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789").rstrip()
                m = CUES[kind].match(text, start, start + len(cut)) if cut else None
            if m:
                out["account"].append((m.start(), m.end()))
                free["account"] = m.end()
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t.as_py()) for t in batch.column(2)]
        counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in (*BASE, *ADDED)]
        sums = pa.array([hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found], pa.string())
        spans = pa.array([joined(f, (*BASE, *ADDED)) for f in found], pa.string())
        yield pa.record_batch([batch.column(0), batch.column(1), *counts, sums, spans], names=["doc_id", "row_key", *(f"n_{k}" for k in (*BASE, *ADDED)), "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, counts by kind, base_sha256, spans.

    spans: kind:start:end (code points, end exclusive) by kind, then start, comma-
    joined. base_sha256 covers the base kinds alone. Null and empty texts have no
    span. Repeated rows give repeated results; texts are read whole. An empty table
    gives an empty result. Only the named columns are read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in (*BASE, *ADDED))
    return rows.mapInArrow(_scan, f"doc_id long, row_key binary, {counts}, base_sha256 string, spans string")


def redact(text: str | None, mask: str = "[{kind}]") -> str | None:
    """The text with every span replaced by its kind; overlapping spans by that of the first."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, spans in find(text).items() for a, b in spans):
        if a >= at:
            out += [text[at:a], mask.format(kind=kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])
