"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds, each found leftmost and without overlap of its own kind, failing matches dropped without a
second try: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (``+``, 9 to 15
digits). The method adds: iban (mod-97 = 1, at the length of its country, else the longest that ends at a word boundary and passes), and ssn-like numbers (ddd-dd-dddd), which have no
checksum and count only where a context word is near. Offsets are code points, ends exclusive.

Every search runs in time linear in the text: runs are entered only at their first character or from
their ``@``, and never scanned twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import prepare, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + EXTRA_KINDS

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}))")
#: Lengths of IBANs by country (ISO 13616).
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SEPARATORS = str.maketrans("", "", " ().+-")

#: What a pattern alone is worth, and words that raise or lower it nearby.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax", "insurance"),
}
AGAINST = ("version", "example", "isbn", "order", "serial")
NEAR, GAIN, LOSS, LEAST = 48, 0.3, 0.2, 0.5
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v)) + r")(?!\w)", re.I) for k, v in CONTEXT.items()}
_AGAINST = re.compile(r"(?<!\w)(?:" + "|".join(AGAINST) + r")(?!\w)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """The base spans of one text, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in t:
        end = 0
        for m in _DOMAIN.finditer(t):
            s = at = m.start()
            while s > end and t[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                end = m.end()
                out.append(("email", s, end))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in t:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(m[0].translate(_SEPARATORS)) <= 15]
    return out


def _iban_end(t: str, start: int, most: int) -> int:
    """The end, at a word boundary up to ``most``, at which the IBAN from ``start`` passes mod-97: at the length
    of its country, else the last one; 0 if there is none."""
    best, usual = 0, IBAN_LENGTHS.get(t[start : start + 2])
    for end in range(most, start + 14, -1):
        if t[end - 1] != " " and not (end < len(t) and t[end].isascii() and t[end].isalnum()):
            x = t[start:end].replace(" ", "")
            if len(x) < 15:
                break
            if (not best or len(x) == usual) and mod97(x):
                best = end
    return best


def extra_spans(t: str) -> list[tuple[str, int, int]]:
    out, last = [], 0
    for m in _IBAN.finditer(t):
        if m.start() >= last and (end := _iban_end(t, m.start(), m.end(1))):
            out.append(("iban", m.start(), end))
            last = end
    return out + [("ssn", m.start(), m.end()) for m in _SSN.finditer(t) if score(t, "ssn", m.start(), m.end()) >= LEAST]


def score(t: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, raised by a context word within NEAR characters, lowered by a contrary one."""
    near = t[max(0, start - NEAR) : start] + " " + t[end : end + NEAR]
    x = PRIOR[kind] + GAIN * bool(_CONTEXT[kind].search(near)) - LOSS * bool(_AGAINST.search(near))
    return min(1.0, max(0.0, round(x, 3)))


def redact(t: str, spans: list[tuple[str, int, int]]) -> str:
    """Each maximal run of overlapping spans becomes the mark of its first span's kind."""
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [t[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*parts, t[at:]])


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def find_pii(docs: DataFrame, keep: list[str], redacted: bool = False) -> DataFrame:
    """docs -> the columns ``keep`` plus the counts of base kinds, base_sha256, spans ("kind:start:end",
    comma-joined, base kinds first) and the score of every span; with ``redacted`` also that text.

    Null text counts as empty (no spans, hash of the empty string, redacted text null). Rows are
    independent: ties, repeats and empty tables need no rule. Columns of docs outside ``keep`` are ignored.
    """
    prepare(docs.sparkSession)
    pick = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t") if redacted else text_or_empty().alias("t"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pick.schema.fields[:-1]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for x in b.column(b.num_columns - 1).to_pylist():
                t = x or ""
                base = base_spans(t)
                every = base + extra_spans(t)
                for i, k in enumerate(BASE_KINDS):
                    cols[i].append(sum(s[0] == k for s in base))
                named = [f"{k}:{s}:{e}" for k, s, e in every]
                cols[4].append(hashlib.sha256(",".join(named[: len(base)]).encode()).hexdigest())
                cols[5].append(",".join(named))
                cols[6].append([score(t, *s) for s in every])
                cols[7].append(redact(x, every) if redacted and x is not None else None)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.float64()), pa.string()]
            made = [pa.array(c, k) for c, k in zip(cols, types, strict=True)]
            names = [*b.schema.names[:-1], *[x.split(" ")[0] for x in _FOUND.split(", ")], "redacted"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names)

    out = pick.mapInArrow(scan, ", ".join([*kept, _FOUND, "redacted string"]))
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"k{i}", c)
    return out if redacted else out.drop("redacted")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
