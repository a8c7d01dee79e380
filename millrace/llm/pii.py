"""Operator 10: personal data by regular expressions, checksum validators and context words.

Expressions propose spans; checksums (Luhn for cards, mod 97 for account numbers) confirm them; words near a span raise
or lower its score. The four base kinds (email, ip, card, phone) stay whatever their score; the added kinds (iban, ssn)
need their validator and, for ssn, a score of at least 0.5. Context words are those of the corpus's four languages.

Null text: as empty. Empty text: no spans. Ties: base kinds do not exclude each other; an added span is dropped where it
overlaps a base span or an added one before it. Repeated rows: each gives its row. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import binary_slices, slices, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: The expressions start where a leftmost match can start at all, so that long runs of digits take linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Beginnings of words, in English, French, German and Spanish, that raise or lower a span's score when they stand within
#: CONTEXT characters before or after it.
CONTEXT = 48
RAISES = {
    "email": "mail email e-mail contact write reach courriel contacter écrire adresse kontakt schreib correo contacto escrib",
    "ip": "ip address server host network adresse serveur réseau hôte rechner netzwerk dirección servidor red",
    "card": "card visa mastercard amex pay credit debit carte paiement payer crédit karte kredit zahl tarjeta pago crédito débito",
    "phone": "phone call tel mobile cell dial téléphone appel portable ruf anruf handy mobil teléfono llam móvil celular",
    "iban": "iban bank account transfer wire banque compte virement konto überweis banco cuenta transferencia",
    "ssn": "ssn social security sécurité sociale sozialversicherung seguridad seguro",
}
LOWERS = {
    "email": "example sample noreply no-reply exemple beispiel ejemplo",
    "ip": "version release build section chapter ausgabe kapitel versión capítulo chapitre",
    "card": "isbn order serial tracking invoice commande facture bestell rechnung pedido factura",
    "phone": "fax isbn serial order version seriennummer série serie",
    "iban": "sample example exemple beispiel muster ejemplo",
    "ssn": "part model serial order article modèle pièce artikel teil modell pieza modelo artículo",
}
_NEAR = {which: {kind: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words.split()))})") for kind, words in table.items()} for which, table in (("raise", RAISES), ("lower", LOWERS))}
START_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.4}
LEAST_ADDED_SCORE = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(code: str) -> bool:
    """The account number check: its first four characters moved to the end, letters as 10 to 35, leave 1."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """As [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds them, around each @ in turn: linear on any text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append((start, last))
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    """From each start the country's length, then all that could belong to it, then (of other countries) each shorter end
    before a space, longest first: the first that mod 97 confirms."""
    found, last = [], 0
    for m in _IBAN.finditer(text):
        start = m.start()
        rest = _IBAN_REST.match(text, m.end()) if start >= last else None
        if not rest:
            continue
        places = [i for i in range(start, rest.end()) if text[i] != " "]
        ends = [n for n in range(len(places), 14, -1) if (e := places[n - 1] + 1) == len(text) or not (text[e].isascii() and text[e].isalnum())]
        own = IBAN_LENGTHS.get(text[start : start + 2])
        if own:
            ends = [n for n in ends if n == own] + [n for n in ends if n == len(places) and n != own]
        for n in ends:
            if mod97("".join(text[i] for i in places[:n])):
                last = places[n - 1] + 1
                found.append((start, last))
                break
    return found


def ssns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]


def score(kind: str, text: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    raised, lowered = bool(_NEAR["raise"][kind].search(near)), bool(_NEAR["lower"][kind].search(near))
    return round(min(1.0, max(0.0, START_SCORE[kind] + 0.3 * raised - 0.3 * lowered)), 2)


class _Taken:
    """Disjoint intervals, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i < 0 or self.ends[i] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(text: str) -> list[Span]:
    """All spans by kind as in KINDS, then start."""
    if text.isascii() and not any(c in text for c in "@0123456789"):
        return []
    base = {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}
    spans = [Span(kind, a, b, score(kind, text, a, b)) for kind in BASE_KINDS for a, b in base[kind]]
    taken = _Taken([(s.start, s.end) for s in spans])
    for kind, added in (("iban", ibans(text)), ("ssn", ssns(text))):
        for a, b in added:
            if taken.free(a, b) and (s := score(kind, text, a, b)) >= LEAST_ADDED_SCORE:
                spans.append(Span(kind, a, b, s))
                taken.add(a, b)
    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span] | None = None) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for s in sorted(find(text) if spans is None else spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digests of base spans, all spans with their scores, and the redacted text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [find(t) for t in texts]
                base = [[s for s in x if s.kind in BASE_KINDS] for x in found]
                out = {"doc_id": part.column("doc_id")}
                for kind in BASE_KINDS:
                    out[f"n_{kind}"] = pa.array([sum(s.kind == kind for s in x) for x in base], pa.int64())
                out["base_sha256"] = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
                out["spans"] = pa.array([joined(x) for x in found], pa.string())
                out["scores"] = pa.array([[s.score for s in x] for x in found], pa.list_(pa.float64()))
                out["redacted"] = pa.array([redact(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string())
                yield pa.record_batch(out)

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return docs.mapInArrow(scan, f"doc_id long, {counts}, base_sha256 string, spans string, scores array<double>, redacted string")


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows with all spans replaced in text (null stays null) and n_chars, if there, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in binary_slices(batch, "text"):
                texts = [t if t is None else redact(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")
