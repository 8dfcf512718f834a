"""Operator 7: personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, schemes, and cues of identifiers.
From each anchor a deterministic parser expands to the boundaries that its kind allows and validates what it found
(labels of a domain, parts of an address up to 255, check digits). Parsers move one way and never retry, so a text
takes time in proportion to its length. Rows stay where they are: there is no shuffle.

Kinds with a base definition (spans leftmost and non-overlapping within a kind, in code points, end exclusive):
email, ip, card, phone. Kinds that the method adds: ``account`` (an IBAN with right check digits; a number of the shape
ddd-dd-dddd behind a cue such as "ssn"; 6 to 17 digits behind a cue such as "account number"), ``url`` (an address whose authority has user
information) and ``secret`` (what is assigned to a cue such as "password" or "api_key"; keys that begin as known issuers' do).

Nulls and rows: a null text is an empty one; rows, repeated or not, each give a row; an empty table gives an empty result;
columns named like a result give way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cols, tidied, with_results

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url", "secret")
DIGITS = "0123456789"
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://")
SSN_CUES = ("ssn", "SSN", "social security")
ACCOUNT_CUES = ("account number", "account no", "account nr", "account id", "acct", "customer number", "customer id", "routing number", "passport number", "passport no")
#: Behind a password's name any value of some length counts, behind the others' one with a digit.
PASSWORD_CUES = ("password", "passwd", "passphrase", "passcode")
SECRET_CUES = ("api_key", "api-key", "apikey", "api key", "access_key", "access key", "secret_key", "secret key", "secret", "token", "auth_key")
KEY_SHAPES = {"AKIA": r"[0-9A-Z]{16}", "ASIA": r"[0-9A-Z]{16}", "ghp_": r"[0-9A-Za-z]{36}", "gho_": r"[0-9A-Za-z]{36}", "sk-": r"[0-9A-Za-z_-]{20,}", "xoxb-": r"[0-9A-Za-z-]{10,}", "xoxp-": r"[0-9A-Za-z-]{10,}"}
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split()

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_chain = re.compile(r"[0-9](?:[ -]?[0-9])*")
_dial = re.compile(r"[ ().0-9-]*")
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ssn = re.compile(r"[^0-9\n]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_account = re.compile(r"[^0-9\n]{0,8}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_assigned = re.compile(r"""["']?[ \t]{0,3}(?:[:=]|is(?=[ \t]))[ \t]{0,3}["']?([^\s"'<>,;]{4,})""")
_shapes = {k: re.compile(v + r"(?![0-9A-Za-z])") for k, v in KEY_SHAPES.items()}
_user = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    cased = lambda words: [x for w in words for x in dict.fromkeys((w, w.upper(), w.capitalize(), w.title()))]
    anchors = (("@", "@"), ("+", "+"), ("d", DIGITS), ("u", SCHEMES), ("s", SSN_CUES), ("n", cased(ACCOUNT_CUES)), ("p", cased(PASSWORD_CUES)), ("k", cased(SECRET_CUES)), ("x", KEY_SHAPES))
    for kind, words in anchors:
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34 or s[:2] not in IBAN_COUNTRIES:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = number_end = dotted_end = phone_end = account_end = url_end = secret_end = 0
    for last, (kind, size) in _AUTOMATON.iter(text):
        at = last - size + 1
        if kind == "d":
            if at >= number_end:  # the first digit of a chain of digits with single separators
                number_end = _chain.match(text, at).end()
                if number_end - at >= 13:
                    digits = text[at:number_end].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, number_end))
            if at >= dotted_end:
                dotted_end = _dotted.match(text, at).end()
                if dotted_end - at >= 7:
                    _addresses(text, at, dotted_end, out["ip"])
            if at >= account_end and at >= 2 and text[at - 2 : at] in IBAN_COUNTRIES and (at < 3 or not text[at - 3].isalnum()):
                m = _iban.match(text, at - 2)
                if m:
                    end = _longest_iban(text, m.start(), m.end())
                    if end:
                        account_end = end
                        out["account"].append((m.start(), end))
        elif kind == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _domain.match(text, at)):
                email_end = m.end()
                out["email"].append((start, email_end))
        elif kind == "+":
            if at >= phone_end and text[at + 1 : at + 2] and text[at + 1] in DIGITS:
                end = _dial.match(text, at + 2).end()
                while end > at + 3 and text[end - 1] not in DIGITS:
                    end -= 1
                if end > at + 3 and text[end - 1] in DIGITS:
                    phone_end = end
                    if 9 <= sum(map(text[at:end].count, DIGITS)) <= 15:
                        out["phone"].append((at, end))
        elif kind == "u":
            if at >= url_end and (m := _user.match(text, last + 1)):
                url_end = m.end()
                out["url"].append((at, url_end))
        elif kind in "sn":
            m = (_ssn if kind == "s" else _account).match(text, last + 1)
            if m and m.start(1) >= account_end:
                account_end = m.end(1)
                out["account"].append(m.span(1))
        elif at >= secret_end:
            span = _secret(text, kind, at, last + 1)
            if span and span[0] >= secret_end:
                secret_end = span[1]
                out["secret"].append(span)
    return out


def _secret(text: str, kind: str, at: int, end: int) -> tuple[int, int] | None:
    """What a cue is followed by, or a key with its own beginning; the value alone."""
    if kind == "x":
        m = None if text[at - 1 : at].isalnum() and at else _shapes[text[at:end]].match(text, end)
        return (at, m.end()) if m else None
    m = _assigned.match(text, end)
    value = m[1].rstrip(".!?)]}") if m else ""
    sure = kind == "p" and m and m[0].lstrip("\"' \t")[:1] in ":="
    if len(value) < (4 if sure else 8) or not (sure or any(c in DIGITS for c in value)):
        return None
    return m.start(1), m.start(1) + len(value)


def _addresses(text: str, start: int, end: int, found: list[tuple[int, int]]) -> None:
    """Four parts at a time of a chain of numbers joined by dots."""
    parts = text[start:end].split(".")
    at = start
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        stop = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
            found.append((at, stop))
        at = stop + 1


def _longest_iban(text: str, start: int, end: int) -> int:
    """The end of the longest valid IBAN that ends at a boundary, or 0."""
    while end - start >= 15:
        if text[end - 1] != " " and not text[end : end + 1].isalnum() and iban(text[start:end]):
            return end
        end -= 1
    return 0


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in kinds for a, z in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    every = sorted((a, -z, k) for k, found in spans.items() for a, z in found)
    if not every:
        return text
    out, at, i = [], 0, 0
    while i < len(every):
        a, z, kind = every[i][0], -every[i][1], every[i][2]
        i += 1
        while i < len(every) and every[i][0] < z:
            z = max(z, -every[i][1])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = z
    return "".join([*out, text[at:]])


_RESULTS = [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
_RESULTS += [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans", "redacted")]


def detect(df: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``df`` without ``text``, with counts of base spans, their digest, all spans, and (``with_text``) ``redacted``."""
    results = _RESULTS if with_text else _RESULTS[:-1]
    base = with_results(df.drop(text), [f.name for f in results])
    schema = T.StructType([*base.schema.fields, *results])

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[list] = [[] for _ in results]
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py() or ""
                spans = find(t)
                row = [*(len(spans[k]) for k in BASE), hashlib.sha256(listed(spans, BASE).encode()).hexdigest(), listed(spans, KINDS)]
                for column, v in zip(new, [*row, redacted(t, spans)] if with_text else row, strict=True):
                    column.append(v)
            kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in results]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(new, kinds, strict=True))], names=schema.names)

    return df.select(*cols(base), F.col(f"`{text}`").alias("__text")).mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, with_text=False).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
