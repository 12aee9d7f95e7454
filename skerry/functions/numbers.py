"""Numbers: literals with units, bit masks, saturation, addresses and scores."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import verdict_of

#: Units of size and time.
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4, "k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4}
AGE_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}


def literal(text: Column, units: dict[str, int], default: str) -> Column:
    """Whole number of a decimal with `.` or `,` and a unit; null if it isn't one."""
    number = F.replace(F.regexp_extract(F.lower(F.btrim(text)), r"^([0-9]+(?:[.,][0-9]+)?) ?([a-z]*)$", 1), F.lit(","), F.lit("."))
    unit = F.regexp_extract(F.lower(F.btrim(text)), r"^([0-9]+(?:[.,][0-9]+)?) ?([a-z]*)$", 2)
    factor = F.get(F.from_json(F.lit("[]"), "array<bigint>"), F.lit(0))
    for name, value in units.items():
        factor = F.when(unit == name, F.lit(value).cast("long")).otherwise(factor)
    factor = F.when(unit == "", F.lit(units[default]).cast("long")).otherwise(factor)
    return F.floor(F.try_to_number(number, F.lit("999999999999.999999")).cast("double") * factor).cast("long")


def to_mask(values: Column, known: list[str], wide: bool = False) -> Column:
    """Bit mask of the known values of an array; wide: as a long, for more than 31 of them."""
    zero = F.lit(0).cast("long") if wide else F.lit(0)
    total = zero
    for k, value in enumerate(known):
        total = total.bitwiseOR(F.when(F.array_contains(values, value), F.lit(1 << k).cast("long") if wide else 1 << k).otherwise(zero))
    return total


def from_mask(mask: Column, known: list[str]) -> Column:
    """The known values whose bits are set, in their order."""
    named = F.array(*(F.when(mask.bitwiseAND(1 << bit) != 0, value) for bit, value in enumerate(known)))
    return F.array_compact(named)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ipv4(text: Column) -> Column:
    """Dotted address as a number that sorts like the address; null if it isn't one."""
    part = F.split(text, r"\.")
    number = sum((F.get(part, F.lit(i)).try_cast("int").cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(text.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"), number)


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, 8 * (3 - i)).bitwiseAND(255).cast("string") for i in range(4)))


#: Address blocks that are not global.
LOCAL_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
#: Addresses within these blocks that are global.
GLOBAL_WITHIN = ["192.0.0.9/32", "192.0.0.10/32"]


def block_range(block: str) -> tuple[int, int]:
    """First and last number of an IPv4 block; bits beyond the prefix don't count."""
    base, _, bits = block.partition("/")
    a = sum(int(p) << 8 * (3 - i) for i, p in enumerate(base.split(".")))
    size = 1 << 32 - int(bits or 32)
    return a - a % size, a - a % size + size - 1


def ip_binary(text: Column) -> Column:
    """16 bytes of an address, that of version 4 mapped into version 6, so that bytes sort like addresses; null if it isn't one."""
    shape = r"^(([0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4})?(::(([0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4})?)?$"

    def in_hex(v4: Column) -> Column:
        return F.concat(F.lower(F.hex(F.shiftright(v4, 16))), F.lit(":"), F.lower(F.hex(v4.bitwiseAND(65_535))))

    def packed(whole: Column) -> Column:
        part = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(whole, "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        return let(
            F.struct(part(0).alias("left"), part(1).alias("right")),
            lambda h: F.when(
                whole.rlike(shape) & F.when(F.contains(whole, F.lit("::")), F.size(h.left) + F.size(h.right) <= 7).otherwise(F.size(h.left) == 8),
                F.unhex(F.array_join(F.transform(F.concat(h.left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(h.left) - F.size(h.right))), h.right), lambda g: F.lpad(g, 4, "0")), "")),
            ),
        )

    dotted = F.regexp_extract(text, r"([0-9]+\.[0-9.]+)$", 1)  # a dotted end stands for the last two groups
    whole = F.when(dotted != "", F.concat(F.regexp_replace(text, r"[0-9]+\.[0-9.]+$", ""), in_hex(ipv4(dotted)))).otherwise(text)
    mapped = F.unhex(F.concat(F.lit("00000000000000000000FFFF"), F.lpad(F.hex(ipv4(text)), 8, "0")))
    return F.when(F.contains(text, F.lit(":")), let(whole, packed)).otherwise(mapped)


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_text(packed: Column) -> Column:
    """The usual form of 16 bytes: dotted for version 4, else groups in hex with the first longest run of zeros left out."""

    def v4(digits: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(digits, 25 + 2 * i, F.lit(2)), 16, 10)), ".")

    def v6(joined: Column) -> Column:
        out = joined
        for n in range(2, 9):  # longer runs are asked after shorter ones, and so win
            cut = F.concat(F.regexp_extract(joined, rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)", 1), F.lit("::"), F.regexp_extract(joined, rf"^.*?(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$", 1))
            out = F.when(joined.rlike(rf"(^|:)0(:0){{{n - 1}}}(:|$)"), cut).otherwise(out)
        return out

    def groups(digits: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(digits, 1 + 4 * i, F.lit(4)), "^0{1,3}", "")), ":")

    shown = let(F.lower(F.hex(packed)), lambda d: F.when(d.startswith("00000000000000000000ffff"), v4(d)).otherwise(let(groups(d), v6)))
    return F.when(F.octet_length(packed) == 16, shown)


def ip_specs(text: str, most: int = 5000) -> tuple[list[tuple[bytes, bytes, bool]], list[str]]:
    """(first, last, whether of version 4) of each address or block of a request, and what is neither.

    Separated by spaces, commas or semicolons; a port after a dotted address and brackets don't count.
    """
    found, bad = [], []
    for spec in re.split(r"[\s,;]+", text or ""):
        spec = spec.strip("[]")
        if not spec:
            continue
        if spec.count(":") == 1 and "." in spec:
            spec = spec.partition(":")[0]
        try:
            block = ipaddress.ip_network(spec, strict=False)
        except ValueError:
            bad.append(spec)
            continue
        pack = lambda a: (b"\0" * 10 + b"\xff\xff" if a.version == 4 else b"") + a.packed
        found.append((pack(block.network_address), pack(block.broadcast_address), block.version == 4))
        if len(found) >= most:
            break
    return found, bad


def in_specs(rows: DataFrame, address: str, specs: DataFrame) -> DataFrame:
    """Rows (with v4, the version) whose packed address lies in one of the specs (low, high, v4).

    Specs are cut at a prefix of their own length, so that rows meet them by equal prefixes, not in a nested loop.
    """
    prefixes = specs.withColumn("bytes", common_bytes(F.col("low"), F.col("high")))
    lengths = [r[0] for r in prefixes.select("bytes").distinct().collect()]  # at most 17, one for each length
    tried = rows.withColumn("__p", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.substring(address, 1, n).alias("p")) for n in lengths)))) if lengths else rows.limit(0).withColumn("__p", F.struct(F.lit(0).alias("n"), F.lit(b"").alias("p")))
    wanted = prefixes.selectExpr("bytes", "substring(low, 1, bytes) prefix", "low", "high", "v4 wanted_v4")
    near = (tried["__p.n"] == wanted.bytes) & (tried["__p.p"] == wanted.prefix) & (tried.v4 == wanted.wanted_v4) & (tried[address] >= wanted.low) & (tried[address] <= wanted.high)
    return tried.join(wanted, near, "left_semi").drop("__p")


def common_bytes(low: Column, high: Column) -> Column:
    """How many first bytes two packed addresses have in common."""
    differs = F.filter(F.sequence(F.lit(1), F.lit(16)), lambda i: F.substr(low, i, F.lit(1)) != F.substr(high, i, F.lit(1)))
    return F.coalesce(F.get(differs, F.lit(0)) - 1, F.lit(16))


def is_global(number: Column) -> Column:
    inside = F.lit(False)
    for block in LOCAL_BLOCKS:
        inside = inside | number.between(*block_range(block))
    for block in GLOBAL_WITHIN:
        inside = inside & ~number.between(*block_range(block))
    return ~inside


#: Blocks of version 6 that are not global.
LOCAL_BLOCKS6 = ["::/127", "64:ff9b:1::/48", "100::/64", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10"]


def is_global_packed(packed: Column) -> Column:
    """is_global() of 16 bytes of either version."""
    inside = F.lit(False)
    for block in LOCAL_BLOCKS6:
        net = ipaddress.ip_network(block)
        inside = inside | packed.between(F.lit(net.network_address.packed), F.lit(net.broadcast_address.packed))
    mapped = F.lower(F.hex(packed)).startswith("00000000000000000000ffff")
    return F.when(mapped, is_global(F.conv(F.hex(F.substr(packed, F.lit(13), F.lit(4))), 16, 10).cast("long"))).otherwise(~inside)


def score(unsafe: Column, doubtful: Column, safe: Column, weight: float = 0.5, least: float = 0.3) -> Column:
    """0-100 from log probabilities of the three answers; null if they carry too little mass."""
    u, d, s = (F.coalesce(F.exp(x), F.lit(0.0)) for x in (unsafe, doubtful, safe))
    return F.when(u + d + s >= least, F.round(100 * (u + weight * d) / (u + d + s)))


def score_of_answers(alternatives: Column, label: Column, weight: float = 0.5, least: float = 0.3) -> Column:
    """0-1 from a model's alternatives for its first token (token, logprob), or, where they carry too little mass, from its label; null without either."""
    mass = lambda name: F.aggregate(F.filter(alternatives, lambda a: verdict_of(a.token).eqNullSafe(name) & a.logprob.isNotNull()), F.lit(0.0), lambda total, a: total + F.exp(a.logprob))
    u, d, s = (F.coalesce(mass(name), F.lit(0.0)) for name in ("unsafe", "controversial", "safe"))
    by_label = F.when(label == "unsafe", 1.0).when(label == "controversial", weight).when(label == "safe", 0.0)
    return F.when(u + d + s >= least, (u + weight * d) / (u + d + s)).otherwise(by_label)


def progress(bits: Column, n: Column) -> Column:
    """Share of a bit field that is set, of n pieces, at most 1, to four places; null without pieces. bits: an array of whole numbers."""
    have = F.aggregate(bits, F.lit(0), lambda total, b: total + F.bit_count(b))
    return F.when(n > 0, F.bround(F.least(F.lit(1.0), have / n), 4))


def pieces(size: Column, piece: Column) -> Column:
    return F.when(piece > 0, F.ceil(size / piece)).otherwise(0)
