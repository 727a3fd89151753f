"""Personal data in texts: patterns propose, checksums confirm, context words weigh.

Four kinds (e-mail and IP addresses, payment cards, international phone numbers) follow
fixed patterns and are always reported.  The others (bank accounts, shorter cards,
national phone numbers) are reported when their score reaches a threshold: a checksum
gives most of it, words near the span the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_by_value
from .base import text_of

ship_by_value(__name__)

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "local_phone")

# Characters of an address, and the length of an account number by country.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")  # starts only
NATIONAL = re.compile(r"(?<![0-9+])\(?0[0-9]{1,4}\)?[\x20./-]?[0-9]{3,4}[\x20.-]?[0-9]{3,5}"
                      r"(?![0-9])")
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22,
    "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta",
             "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame", "appelez"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
CONTEXT["short_card"], CONTEXT["local_phone"] = CONTEXT["card"], CONTEXT["phone"]
NEAR = 48                   # characters looked at on either side
# Score without context: what the pattern and its checksum are worth by themselves.
WORTH = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9,
         "short_card": 0.5, "local_phone": 0.4}
BONUS, THRESHOLD = 0.3, 0.65


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def digits_of(text: str) -> str:
    return re.sub("[^0-9]+", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Checksum of an account number: country and check digits moved to the end, letters
    read as 10 to 35."""
    moved = account[4:] + account[:4]
    return int("".join([str(int(c, 36)) for c in moved])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def account(text: str, start: int) -> int | None:
    """End of the account number that begins here, by its country's length."""
    left = IBAN_LENGTH.get(text[start:start + 2])
    letters = []
    for k in range(start, len(text)):
        if left is None or not left:
            break
        if text[k] == " ":
            if text[k - 1] == " ":          # single spaces only
                return None
        else:
            letters.append(text[k])
            left -= 1
            if not left:
                whole = "".join(letters)
                after = text[k + 1:k + 2]
                good = re.fullmatch("[A-Z0-9]+", whole) and not re.match("[A-Za-z0-9]", after)
                return k + 1 if good and mod97(whole) else None
    return None


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card" if len(digits) >= 16 else "short_card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    over = 0
    for m in IBAN.finditer(text):
        end = account(text, m.start()) if m.start() >= over else None
        if end:
            over = end
            yield "iban", m.start(), end
    for m in NATIONAL.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 12:
            yield "local_phone", *m.span()


def spans_of(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by kind as listed, then start; offsets in characters, end exclusive."""
    found = []
    for kind, start, end in proposals(text):
        around = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()
        words = re.findall(r"[^\W\d_]+", around)
        near = any(w.startswith(c) for w in words for c in CONTEXT[kind])
        score = min(1.0, WORTH[kind] + BONUS * near)
        if kind in BASE or score >= threshold:
            found.append(Span(kind, start, end, round(score, 2)))
    # a national number is the weakest claim: none inside another span
    found = [s for s in found if s.kind != "local_phone" or not any(
        o.start < s.end and s.start < o.end for o in found if o.kind != "local_phone")]
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


def joined(spans: list[Span]) -> str:
    return ",".join([f"{s.kind}:{s.start}:{s.end}" for s in spans])


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``key, spans`` for every row; a span has kind, start, end and score.

    Map-only.  A null text is an empty one and has no spans; null or repeated keys are
    passed on; other columns are not looked at; texts of any length are read whole; an
    empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans_of(t.as_py(), threshold)]
                     for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(found, pa.list_(span))], ["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, spans array<struct<kind: string, start: int,"
                                " `end`: int, score: double>>").withColumnRenamed("key", key)


def digests(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts and texts of :func:`find_pii`: ``n_<kind>`` of the fixed kinds, the digest of
    their spans, and all spans in one string."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        key, *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(text(of(*BASE)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
