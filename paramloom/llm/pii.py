"""Personal data in whole texts: patterns propose, checksums confirm, context adjusts.

Base kinds. email, ip, card and phone by their patterns, leftmost and without
overlap per kind; a card must have 12 to 19 digits and pass Luhn, an ip have
parts up to 255, a phone 9 to 15 digits. These spans always stay.

Added kinds, kept if their score reaches ``THRESHOLD``:
  iban    two letters, two digits, 11 to 30 letters or digits in groups; mod 97 must be 1
  phone   national numbers without a plus, which need a word such as tel nearby
  secret  a quoted or bare run of 20 or more key characters after a word such as token or password
  id      nine to twelve digits in groups, which need a word such as passport or ssn nearby
A proposal starts from its kind's score; a word of its context list within
``NEAR`` code points before it adds to that. An added span never overlaps a
base span or an earlier added one.

Every scan is linear in the text, whatever it holds: patterns start only where
a run starts (or at an '@' or '+'), and runs are matched possessively.

Edge cases. Null counts as empty: no spans. Offsets count code points. Rows
are independent: any doc_id, repeats and other columns are fine.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from paramloom.llm.scratch import bounded_batches

BASE = ("email", "ip", "card", "phone")
KINDS = {k: i for i, k in enumerate((*BASE, "iban", "secret", "id"))}
THRESHOLD = 0.6
NEAR = 40
CONTEXT = {
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|cell|telefon|téléphone|teléfono)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\b"),
    "id": re.compile(r"(?i)\b(?:ssn|social security|passport|tax id|national id|dni|ausweis)\b"),
}
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])")
_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[ -]?[0-9]{2,3}[ -]?[0-9]{3,6}(?![0-9A-Za-z-])")
_DIGIT = re.compile(r"[0-9]")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN without its spaces."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        hit = _AT.match(text, at) if start < at else None
        if hit:
            end = hit.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found["phone"].append(m.span())
    return found


def proposals(text: str):
    """(kind, start, end, score before context) of the added kinds."""
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        end = m.end() if not text[m.end() : m.end() + 1].isalnum() else text.rfind(" ", m.start(), m.end())
        while end - m.start() >= 15:  # words in capitals may follow: give up groups from the end
            plain = text[m.start() : end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield "iban", m.start(), end, 0.9
                break
            end = text.rfind(" ", m.start(), end)
    for m in _SECRET.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            yield "secret", *m.span(), 0.4 if _ASSIGNED.search(text, max(0, m.start() - 4), m.start()) else 0.25
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 12:
            yield "phone", *m.span(), 0.35
    for m in _ID.finditer(text):
        if 9 <= len(_digits(m.group())) <= 12:
            yield "id", *m.span(), 0.3


def _meets(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span of a sorted list without overlaps meets this one."""
    i = bisect.bisect_left(taken, (start, start))
    return i > 0 and taken[i - 1][1] > start or i < len(taken) and taken[i][0] < end


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, float]]]:
    """The base spans by kind, and every span as (kind, start, end, score) in order."""
    base = base_spans(text)
    spans = [(k, s, e, 1.0) for k in BASE for s, e in base[k]]
    lists, added = [*base.values(), []], []
    for kind, start, end, score in proposals(text):
        words = CONTEXT.get(kind)
        if words and words.search(text, max(0, start - NEAR), start):
            score += 0.4
        if score >= THRESHOLD:
            added.append((start, KINDS[kind], kind, end, score))
    for start, _, kind, end, score in sorted(added):
        if not any(_meets(taken, start, end) for taken in lists):
            lists[-1].append((start, end))
            spans.append((kind, start, end, score))
    spans.sort(key=lambda x: (x[1], KINDS[x[0]]))
    return base, spans


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string,"
    " found array<struct<kind:string,start:long,end:long,score:double>>"
)
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(batches):
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts, shas, texts, found = {k: [] for k in BASE}, [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base, spans = all_spans(text)
            for k in BASE:
                counts[k].append(len(base[k]))
            plain = sorted(((k, s, e) for k in BASE for s, e in base[k]), key=lambda x: (x[1], KINDS[x[0]]))
            shas.append(hashlib.sha256(joined(plain).encode()).hexdigest() if plain else nothing)
            texts.append(joined(spans))
            found.append([{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(found, _FOUND)],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"],
        )


def find_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts and digests per document, and found: its spans with kind and score."""
    bounded_batches(spark)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_scan, _SCHEMA)


def op1_patterns_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
