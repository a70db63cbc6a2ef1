"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import map_batches

#: Kinds in the order that breaks ties of spans with one start; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "local_phone"]
BASE = KINDS[:4]
SPAN = "struct<kind: string, start: long, end: long, score: double>"
#: Score before context, by kind: what passed a checksum or a strict form starts high.
PRIOR = {"email": 0.95, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}
#: Words within ``WINDOW`` characters before or after a span that raise or lower its score, by kind.
NEAR = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "client", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "cvv"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta", "swift", "bic"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp"},
}
AGAINST = {
    "ip": {"version", "v", "release", "section", "chapter"},
    "card": {"order", "invoice", "isbn", "id", "serial", "tracking"},
    "phone": {"order", "invoice", "isbn", "id"},
    "ssn": {"order", "invoice", "isbn", "part"},
    "local_phone": {"order", "invoice", "isbn", "id", "part"},
}
RAISE, LOWER, WINDOW = 0.25, 0.3, 48
#: A kind that is no base kind is reported from this score on.
MIN_SCORE = 0.5

# Possessive runs: each pattern passes once over a text whatever the text holds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+A-Za-z.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """As the email pattern finds them from the left, but anchored at each @, so a long run of name characters is read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # no later name part reaches back over this @
            at = text.find("@", at + 1)
    return out


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def _ssn_ok(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end in code points) of one text, without scores."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if len(c := m[0].replace(" ", "")) <= 34 and mod97(c)]
    out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text) if _ssn_ok(m[0])]
    out += [("local_phone", m.start(), m.end()) for m in _TEL.finditer(text)]
    return out


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW): start]) + _WORD.findall(text[end: end + WINDOW])}
    score = PRIOR[kind] + (RAISE if near & NEAR[kind] else 0.0) - (LOWER if near & AGAINST.get(kind, set()) else 0.0)
    return round(min(1.0, max(0.0, score)), 4)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans by start, then kind. A kind beside the base ones must reach MIN_SCORE and not overlap a base span."""
    if not text:
        return []
    found = proposals(text)
    base = sorted((s, e) for k, s, e in found if k in BASE)
    ends: list[int] = []  # largest end up to each base span
    for _, e in base:
        ends.append(max(e, ends[-1] if ends else 0))
    starts = [s for s, _ in base]
    out = []
    for kind, s, e in found:
        score = scored(text, kind, s, e)
        if kind not in BASE:
            before = bisect_left(starts, e)
            if score < MIN_SCORE or (before and ends[before - 1] > s):
                continue
        out.append((kind, s, e, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id as ``id`` and ``spans`` (kind, start, end, score).

    One pass without a shuffle; each whole text is read once. A null or empty text has no spans; repeated rows give
    repeated rows; a null id stays null; other columns are not read; an empty table gives an empty one.
    """

    def run(ids, texts):
        return ids, [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in spans_of(t)] for t in texts]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, spans array<{SPAN}>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Id as ``id`` and the text with every span of at least ``min_score`` replaced by ``[KIND]``; overlapping spans become one mark of the first."""

    def run(ids, texts):
        out = []
        for t in texts:
            parts, done = [], 0
            for k, s, e, x in spans_of(t):
                if x < min_score:
                    continue
                if s >= done:
                    parts += [t[done:s], f"[{k.upper()}]"]
                done = max(done, e)
            out.append(None if t is None else "".join(parts) + t[done:])
        return ids, out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, text string")
