"""Bencoded binaries: round trips and malformed input."""

import json
import random

import pytest

from skerry.functions import bencode as B


def value(rng, depth=0):
    kind = rng.choice("isbld" if depth < 4 else "isb")
    if kind == "i":
        return rng.choice([0, -1, 7, 10**30, -(2**63)])
    if kind == "s":
        return rng.choice(["", "é", "a:b", "i5e", "e" * 30])
    if kind == "b":
        return {"hex": rng.randbytes(3).hex() + "ff"}
    if kind == "l":
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "bb", "c c", "é"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(40))
def test_values_come_back(seed):
    v = value(random.Random(seed))
    data = B.write(v)
    assert B.parse(data) == v and B.write(B.parse(data)) == data


def test_known_forms():
    assert B.parse(b"d3:cow3:moo4:spami-3ee") == {"cow": "moo", "spam": -3}
    assert B.parse(b"l4:spaml0:i0eee") == ["spam", ["", 0]]
    assert B.write({"b": 1, "a": ["x", {"hex": "ff00"}], "hex:ff": {}}) == b"d1:al1:x2:\xff\x00e1:bi1e1:\xffdee"
    assert B.parse(b"d1:ai1e1:ai2ee") == {"a": 2}


@pytest.mark.parametrize(
    "data, at",
    [(b"", 0), (b"x", 0), (b"i5", 0), (b"ie", 1), (b"i-0e", 1), (b"i05e", 1), (b"i1.5e", 1), (b"5:abc", 0), (b"1x:a", 0), (b"i1ei2e", 3), (b"l", 1), (b"li1e", 4), (b"d", 1), (b"d1:ae", 4), (b"di1ei2ee", 1), (b"d1:a", 4), (b"e", 0), (b"i" + b"9" * 39 + b"e", 1), (b"l" * 401, 400), (b"-1:a", 0)],
)
def test_malformed(data, at):
    with pytest.raises(B.Malformed) as e:
        B.parse(data)
    assert e.value.at == at


def test_columns(spark):
    rows = [(1, b"d1:ali1ei2eee"), (2, b"i5"), (3, None), (4, B.write({"x": {"hex": "fe"}})), (5, b"l" * 300 + b"e" * 300)]
    d = spark.createDataFrame(rows, "i int, b binary").withColumn("d", B.decoded("b"))
    got = {r.i: (r.d.json if r.d else None, r.d.bad_at if r.d else None) for r in d.collect()}
    assert got[1] == (json.dumps({"a": [1, 2]}), None) and got[2] == (None, 0) and got[3] == (None, None) and json.loads(got[4][0]) == {"x": {"hex": "fe"}} and got[5][1] is None
    assert {r.i: bytes(r.e) if r.e else None for r in d.select("i", B.encoded("d.json").alias("e")).collect()} == {1: rows[0][1], 2: None, 3: None, 4: rows[3][1], 5: rows[4][1]}
    assert d.filter("i = 1").selectExpr("variant_get(parse_json(d.json), '$.a[1]', 'int') x").first().x == 2
