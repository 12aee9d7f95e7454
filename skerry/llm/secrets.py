"""Secret scans with structural confirmation.

Patterns find assignments, access keys and long hex strings. Beyond them, runs of base64 or hex are decoded
and reported only if their bytes parse: a private key in DER with consistent nested lengths, an OpenSSH key
with its length-prefixed strings, or a signed token whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
BASE = KINDS[:3]
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters
ANY_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_=-])([A-Za-z0-9_=-]+)\.[A-Za-z0-9_-]+={0,2}\.[A-Za-z0-9_-]*")
OPENING = re.compile("e(?:y[A-DI-L]|w[k-r0-3])")  # what `{` and white space or a quote begin with in base64
PEEK = 64  # characters of a header that are looked at first
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}(?:(?:\r?\n|\\r\\n|\\n)[A-Za-z0-9+/]+)+={0,2}")  # runs over lines, or with written line breaks
COLONS = re.compile(r"(?:[0-9A-Fa-f]{2}:){31,}[0-9A-Fa-f]{2}")
BREAKS = re.compile(r"\s+|\\[nr]|:")

_words = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_as_run = bytes(104 if chr(b) in "0123456789abcdefABCDEF" else 98 if re.match(r"[A-Za-z0-9+/_-]", chr(b), re.A) else 32 for b in range(256))
_all_run = bytes(98 if b == 104 else b for b in range(256))


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at `at`; None if it doesn't fit before end."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 128:
        k = size - 128
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end]; None if they don't fill it."""
    found = []
    while at < end:
        x = tlv(data, at, end)
        if x is None:
            return None
        found.append(x)
        at = x[2]
    return found


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted) or SEC1: one SEQUENCE over all bytes with the parts of a private key."""
    top = tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _, _ in parts]
    number = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags[0] == 2 else None

    def algorithm(x: tuple[int, int, int]) -> bool:
        inner = children(data, x[1], x[2])
        return bool(inner) and inner[0][0] == 6

    if len(tags) >= 9 and number in (0, 1) and tags[:9] == [2] * 9:
        return True
    if len(tags) >= 3 and number in (0, 1) and tags[1:3] == [0x30, 4]:
        return algorithm(parts[1])
    if number == 1 and tags[1] == 4 and 16 <= parts[1][2] - parts[1][1] <= 80:
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags == [0x30, 4] and algorithm(parts[0])


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for what in ("cipher", "kdf", "options", "count", "public", "private"):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if what == "count":
            if not 1 <= size <= 16:
                return False
            continue
        if at + size > len(data):
            return False
        at += size
    return at == len(data)


def unbase64(s: str) -> bytes:
    """Decoded bytes of base64 in either alphabet; none if it isn't."""
    s = BREAKS.sub("", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def kind_of(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def plausible(run: str, at: int) -> bool:
    """Whether what stands in a run from a place on may begin a JSON object, by its first characters alone: a run with
    many openings isn't decoded from each of them."""
    part = run[at : at + PEEK]
    try:
        start = codecs.getincrementaldecoder("utf-8")().decode(base64.urlsafe_b64decode(part[: len(part) & ~3]))
    except ValueError:
        return False
    try:
        json.loads(start)
    except json.JSONDecodeError as e:
        return len(part) < PEEK or e.msg.startswith("Unterminated string") or e.pos >= len(start.rstrip())
    except RecursionError:
        return False
    return True


def is_signed_token(s: str) -> bool:
    """A header that names an algorithm, and claims; however their JSON is spaced."""
    header, payload, _ = s.split(".", 2)
    try:
        top, claims = (json.loads(unbase64(x)) for x in (header, payload))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(top, dict) and isinstance(top.get("alg"), str) and isinstance(claims, dict)


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text in code points, by start, then kind."""
    raw = text.encode("utf-8", "replace")
    low, runs, found = raw.lower(), raw.translate(_as_run), []
    if any(w in low for w in _words):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"h" * 32 in runs:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        for m in ANY_HEX.finditer(text):
            size = len(m[0]) & ~1
            for a in {m.start(), m.end() - size}:  # of an odd run, without its last or its first digit
                if kind := kind_of(bytes.fromhex(text[a : a + size])):
                    found.append((kind, a, a + size))
    if raw.count(b":") > 30:
        found += [(kind, *m.span()) for m in COLONS.finditer(text) if (kind := kind_of(bytes.fromhex(m[0].replace(":", ""))))]
    if b"ey" in raw or b"ew" in raw:
        for m in DOTTED.finditer(text):
            tail = text[m.end(1) : m.end()]
            start = next((m.start() + o.start() for o in OPENING.finditer(m[1]) if plausible(m[1], o.start()) and is_signed_token(m[1][o.start() :] + tail)), None)
            if start is not None:
                found.append(("jwt", start, m.end()))
    if b"b" * 40 in runs.translate(_all_run):
        keys = [(kind, *m.span()) for m in PEM.finditer(text) if (kind := kind_of(unbase64(m[2])))] if b"PRIVATE KEY-----" in raw else []
        for pattern in (WRAPPED, BASE64):
            for m in pattern.finditer(text):
                if not any(a <= m.start() < b for _, a, b in keys) and (kind := kind_of(unbase64(m[0]))):
                    keys.append((kind, *m.span()))
        found += keys
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as (doc_id, spans), spans in code points, end exclusive, by start and then kind.

    Null and empty texts have none. Repeated rows and ids stay; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=pa.list_(kind))], names=["doc_id", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SPANS)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for _, a, b in scan(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets replaced by the mark in text_col. Nulls stay null, empty texts empty; other columns, repeated rows
    and ids stay as they are; an empty table gives an empty one."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, mark), na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
