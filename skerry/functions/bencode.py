"""Bencoded binaries as VARIANT values, and back.

Integers `i<n>e`, byte strings `<length>:<bytes>`, lists `l...e` and dictionaries `d<key><value>...e`. The parser keeps its own
stack. Byte strings that aren't UTF-8 become objects {"hex": "..."}, and keys that aren't become "hex:..."; both are written
back as bytes. Binaries nested more than DEEPEST levels are taken for malformed, as no VARIANT holds them.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.arrow import pieces

MOST_DIGITS, DEEPEST = 38, 400  # of an integer, what a decimal of a VARIANT holds; lists and dictionaries within each other


class Malformed(ValueError):
    """Not bencoded; at is the place of the first byte that can't be read."""

    def __init__(self, at: int):
        super().__init__(at)
        self.at = at


def text_of(data: bytes) -> str | dict[str, str]:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return {"hex": data.hex()}


def number_at(data: bytes, start: int, end: int) -> int:
    """The integer between two places: digits, one minus at most, no zeros in front, no minus zero."""
    digits = data[start:end]
    plain = digits[1:] if digits[:1] == b"-" else digits
    if not plain.isdigit() or len(plain) > MOST_DIGITS or (plain[:1] == b"0" and digits != b"0"):
        raise Malformed(start)
    return int(digits)


def string_at(data: bytes, at: int) -> tuple[bytes, int]:
    """The byte string that begins at a place, and the place behind it."""
    colon = data.find(b":", at, at + 20)
    if colon < 0 or not data[at:colon].isdigit():
        raise Malformed(at)
    end = colon + 1 + int(data[at:colon])
    if end > len(data):
        raise Malformed(at)
    return data[colon + 1 : end], end


def parse(data: bytes) -> Any:
    """The value of a whole bencoded binary. Of equal keys of a dictionary the last counts; keys needn't be sorted."""
    at = 0
    open_: list[tuple[Any, list]] = []  # values that aren't closed yet, each with its key that waits for a value
    while True:
        kind, done = data[at : at + 1], False
        waiting = open_[-1] if open_ else None
        is_key = waiting is not None and isinstance(waiting[0], dict) and not waiting[1]
        if kind == b"e" and waiting is not None and not (isinstance(waiting[0], dict) and waiting[1]):
            value, at, done = open_.pop()[0], at + 1, True
        elif kind.isdigit():
            raw, at = string_at(data, at)
            value, done = text_of(raw), True
            if is_key:
                waiting[1].append(value if isinstance(value, str) else f"hex:{raw.hex()}")
                continue
        elif is_key or kind not in (b"i", b"l", b"d"):
            raise Malformed(at)
        elif kind == b"i":
            end = data.find(b"e", at)
            if end < 0:
                raise Malformed(at)
            value, at, done = number_at(data, at + 1, end), end + 1, True
        elif len(open_) == DEEPEST:
            raise Malformed(at)
        else:
            open_.append(([] if kind == b"l" else {}, []))
            at += 1
        if done:
            if not open_:
                if at != len(data):
                    raise Malformed(at)
                return value
            holder, key = open_[-1]
            if isinstance(holder, dict):
                holder[key.pop()] = value
            else:
                holder.append(value)


def bytes_of(text: Any) -> bytes:
    if isinstance(text, dict):
        return bytes.fromhex(text["hex"])
    return bytes.fromhex(text[4:]) if text.startswith("hex:") else text.encode()


def is_bytes(value: Any) -> bool:
    return isinstance(value, dict) and list(value) == ["hex"] and isinstance(value["hex"], str)


def write(value: Any) -> bytes:
    """A value as bencoded bytes, keys of dictionaries in the order of their bytes."""
    out: list[bytes] = []
    rest: list[Any] = [value]
    while rest:
        x = rest.pop()
        if isinstance(x, bytes):
            out.append(x)
        elif isinstance(x, str) or is_bytes(x):
            raw = x.encode() if isinstance(x, str) else bytes_of(x)
            out.append(b"%d:%b" % (len(raw), raw))
        elif isinstance(x, int) and not isinstance(x, bool):
            out.append(b"i%de" % x)
        elif isinstance(x, list):
            out.append(b"l")
            rest += [b"e", *reversed(x)]
        elif isinstance(x, dict):
            out.append(b"d")
            rest.append(b"e")
            for raw, v in sorted(((bytes_of(k), v) for k, v in x.items()), reverse=True):
                rest += [v, b"%d:%b" % (len(raw), raw)]
        else:
            raise TypeError(f"{type(x).__name__} has no bencoded form")
    return b"".join(out)


DECODED = T.StructType([T.StructField("json", T.StringType()), T.StructField("bad_at", T.LongType())])


_STRUCT = pa.struct([("json", pa.string()), ("bad_at", pa.int64())])


@F.arrow_udf(DECODED)
def _decoded(data: pa.Array) -> pa.Array:
    def row(d: bytes | None) -> dict:
        try:
            return {} if d is None else {"json": json.dumps(parse(d), ensure_ascii=False)}
        except Malformed as e:
            return {"bad_at": e.at}

    return pa.concat_arrays([pa.array([], _STRUCT), *(pa.array(map(row, p.to_pylist()), _STRUCT) for p in pieces(data))])


def decoded(data: Column) -> Column:
    """(json, bad_at) of bencoded binaries: the value as a JSON text, or the place of the first byte that can't be read. Null for null."""
    return _decoded(data)


def variant_of(json_text: Column) -> Column:
    """The VARIANT of a decoded value, for variant_get()."""
    return F.parse_json(json_text)


@F.arrow_udf(T.BinaryType())
def encoded(json_text: pa.Array) -> pa.Array:
    """JSON texts of integers, strings, lists and objects as bencoded binaries; null for null."""
    every = ((None if t is None else write(json.loads(t)) for t in p.to_pylist()) for p in pieces(json_text))
    return pa.concat_arrays([pa.array([], pa.binary()), *(pa.array(e, pa.binary()) for e in every)])
