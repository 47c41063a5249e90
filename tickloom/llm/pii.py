"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

The base kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers, leftmost and without overlap
within a kind; a match that fails its check is dropped and not tried again from a later start. The method adds bank
accounts (IBAN, mod 97) whose score reaches THRESHOLD. Base spans always stay, whatever their score.

Positions are code points of the whole text, ends exclusive. The scans are linear in the text: no pattern is tried twice
over the same run of characters.

Defined cases: a null text is empty and has no spans; ids aren't looked at, so null and repeated ids give a row each; an
empty table gives an empty result; other columns pass through, and a column named like an added one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("score", T.DoubleType())])

DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")

#: Lengths of account numbers by country, as registered.
IBAN_LENGTH = {"AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
               "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
               "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
               "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
               "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
               "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
               "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30}

#: Score of a confirmed match without any context; what a supporting or a contrary word nearby adds.
#: A number that its checksum confirms stays at the threshold at least.
CHECKED = ("card", "iban")
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7}
SUPPORT, AGAINST, NEAR, THRESHOLD = 0.2, -0.3, 48, 0.5
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "adresse", "dirección"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
}
CONTRARY = {"version", "sample", "example", "test", "dummy", "beispiel", "exemple", "ejemplo"}
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(compact: str) -> bool:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(t: str) -> Iterator[tuple[int, int]]:
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = t.find("@", done)


def _ips(t: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(t):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def _cards(t: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(t: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(t):
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.span()


def _ibans(t: str) -> Iterator[tuple[int, int]]:
    """Of a candidate only the registered length counts; the scan goes on behind a confirmed one, and just after the start of another."""
    m = IBAN.search(t)
    while m:
        size, end, compact = IBAN_LENGTH.get(m[0][:2], 0), m.start(), ""
        for c in m[0]:
            if len(compact) == size:
                break
            compact, end = compact + c.strip(), end + 1
        good = size and len(compact) == size and not t[end:end + 1].isalnum() and mod97(compact)
        if good:
            yield m.start(), end
        m = IBAN.search(t, end if good else m.start() + 1)


def score(t: str, kind: str, start: int, end: int) -> float:
    """Words within NEAR code points on either side decide: each sort of context counts once."""
    near = {w.lower() for w in WORD.findall(t[max(0, start - NEAR):start]) + WORD.findall(t[end:end + NEAR])}
    told = min(1.0, START[kind] + SUPPORT * bool(near & FOR[kind]) + AGAINST * bool(near & CONTRARY))
    return round(max(told, THRESHOLD) if kind in CHECKED else told, 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then by KINDS."""
    t, found = text or "", []
    finders = [("email", _emails)] if "@" in t else []
    if DIGIT.search(t):
        finders += [("ip", _ips), ("card", _cards), ("phone", _phones), ("iban", _ibans)]
    for kind, finder in finders:
        spans = [(kind, a, b, score(t, kind, a, b)) for a, b in finder(t)]
        found += spans if kind in BASE_KINDS else [s for s in spans if s[3] >= THRESHOLD]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind; spans that overlap are replaced as one, by the first's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end, _ in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(T.ArrayType(SPAN))
def spans_of(texts: pd.Series) -> pd.Series:
    return texts.map(find_spans)


@F.pandas_udf(T.StringType())
def masked_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else masked(t, find_spans(t)), na_action=None)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`."""
    return docs.withColumn("spans", spans_of(F.coalesce(F.col(text), F.lit(""))))


def mask_pii(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with all spans masked in the text, and the length column, if there is one, brought up to date."""
    df = docs.withColumn(text, masked_text(F.col(text)))
    return df.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length in docs.columns else df


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
