"""Personal data: patterns propose spans, checksums confirm them, and nearby words adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import bounded_batches, Carried, slices
from kinmap.llm.words import text_column

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("card_run", "phone_run", "iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
#: Added spans of a lower score are dropped; base spans stay at any score.
THRESHOLD = 0.6
#: Characters on either side in which context words count.
REACH = 60

# Fixed patterns. Possessive parts only keep long runs linear: they match what their greedy forms match.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_RUN = re.compile(r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])")
_PHONE_RUN = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRETS = (
    (re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"), 0),
    (re.compile(r"\b(?:[Tt]oken|[Ss]ecret|[Pp]assword|[Pp]asswd|[Aa]pi[_-]?[Kk]ey)\b\x20?[=:]\x20?\"?([^\"\s]{8,})"), 1),
)
_KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9\x20]*?PRIVATE KEY(?:\x20BLOCK)?-----")
_KEY_END = re.compile(r"-----END [A-Z0-9\x20]*?PRIVATE KEY(?:\x20BLOCK)?-----")
#: What follows a key's first line where its last is missing: header fields and runs of the key's alphabet.
_KEY_BODY = re.compile(r"(?:(?:\s|\\n)*+(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*+|[A-Za-z0-9+/=]{16,}+))*+")

#: Words that raise (or, after the bar, lower) the score of a kind.
CONTEXT = {
    "email": ("mail e-mail contact write correo kontakt contacto", "example"),
    "ip": ("ip address host server login adresse dirección", "version section chapter kapitel"),
    "card": ("card visa mastercard amex credit debit payment karte tarjeta carte", "order invoice isbn tracking serial rechnung factura"),
    "phone": ("phone call tel mobile fax whatsapp telefon teléfono téléphone handy", "order invoice serial rechnung factura"),
    "iban": ("iban bank account transfer konto cuenta compte", "serial part"),
    "ssn": ("ssn social security taxpayer", "part serial order"),
    "secret": ("key token secret password credential", "example"),
}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an IBAN without spaces: the first four characters go last, letters count from 10."""
    rest = 0
    for c in code[4:] + code[:4]:
        n = int(c, 36)
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str, pattern: re.Pattern = _CARD) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str, pattern: re.Pattern = _PHONE) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]
        for end in ends:  # a capital word may follow the last group
            if 15 <= len(code := text[m.start() : end].replace(" ", "")) <= 34 and mod97(code):
                yield m.start(), end
                break


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Social security numbers of areas, groups and serials that are in use."""
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Whole blocks, from the first line of a key to its last; without a last line before the next key, what looks like its body."""
    begins = list(_KEY_BEGIN.finditer(text)) if "PRIVATE KEY" in text else []
    for m, upto in zip(begins, [*(n.start() for n in begins[1:]), len(text)]):
        last = _KEY_END.search(text, m.end(), upto)
        yield m.start(), last.end() if last else _KEY_BODY.match(text, m.end(), upto).end()


def secrets(text: str) -> Iterator[tuple[int, int]]:
    for pattern, group in _SECRETS:
        for m in pattern.finditer(text):
            yield m.span(group)
    yield from private_keys(text)


#: Score of a confirmed span before its context is seen.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "card_run": 0.8, "phone_run": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.9}


def scored(kind: str, text: str, start: int, end: int) -> Span:
    raising, lowering = (set(x.split()) for x in CONTEXT[kind.removesuffix("_run")])
    near = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    score = PRIOR[kind] + 0.3 * bool(near & raising) - 0.3 * bool(near & lowering)
    return Span(kind, start, end, round(min(1.0, max(0.0, score)), 2))


def find_spans(text: str) -> list[Span]:
    """All spans by kind in the order of ``KINDS``, then start. Added kinds never repeat a base span they overlap."""
    digits = any(c in text for c in "0123456789")
    base = {"email": list(emails(text))}
    base["ip"] = list(addresses(text)) if digits else []
    base["card"] = list(cards(text)) if digits else []
    base["phone"] = list(phones(text)) if "+" in text else []
    clear = lambda kind, spans: [s for s in spans if all(s[1] <= a or b <= s[0] for a, b in base[kind])]
    added = {
        "card_run": clear("card", cards(text, _CARD_RUN)) if digits else [],
        "phone_run": clear("phone", phones(text, _PHONE_RUN)) if "+" in text else [],
        "iban": list(ibans(text)) if digits else [],
        "ssn": list(numbers(text)) if digits else [],
        "secret": sorted(set(secrets(text))),
    }
    out = [scored(kind, text, a, b) for kind in BASE_KINDS for a, b in base[kind]]
    return out + [s for kind in ADDED_KINDS for a, b in added[kind] if (s := scored(kind, text, a, b)).score >= THRESHOLD]


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the upper-case kind of its first span in angle brackets."""
    out, done = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for a, b, kind in merged:
        out += [text[done:a], f"<{kind.removesuffix('_run').upper()}>"]
        done = b
    return "".join([*out, text[done:]])


SPANS = "spans array<struct<kind:string,start:long,end:long,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row a document: the columns ``keep`` (``key`` alone by default), spans (code points, end exclusive) and, if asked for, ``redacted_text``.

    No shuffle; whole texts, each pattern linear in a text's length. Null texts count as empty and have no spans (their redacted
    text is null); null keys and repeated rows come back as they are; further columns are not read, and ``keep`` may not name an added one.
    """
    carried = Carried(docs, [key] if keep is None else keep)
    own = carried.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 8_000_000):
            column = batch.column("_text")
            texts = text_column(column).to_pylist()
            found = [find_spans(t) for t in texts]
            columns = [*map(batch.column, own), pa.array([[s._asdict() for s in f] for f in found], _SPAN_TYPE)]
            if with_text:
                clean = [redacted(t, f) if f else t for t, f in zip(texts, found)]
                columns.append(pa.array([None if null else c for c, null in zip(clean, column.is_null().to_pylist())], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "spans", *["redacted_text"] * with_text])

    added = ["spans", *["redacted_text"] * with_text]
    schema = f"{carried.ddl}, {SPANS}" + ", redacted_text string" * with_text
    return bounded_batches(docs.select(*carried.columns, F.col(text).alias("_text"))).mapInArrow(run, schema).select(*carried.restored, *added)
