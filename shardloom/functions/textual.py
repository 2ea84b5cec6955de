"""Conversions of times, sizes, addresses and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Microseconds of time suffixes, bytes of size suffixes, size units from the largest down.
TIME = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
BYTES = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}
UNITS = (("EB", 1 << 60), ("PB", 1 << 50), ("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10))


def _whole(number: Column, unit: int) -> Column:
    """A long divided by a unit, cut towards zero, without a detour over doubles."""
    return F.call_function("div", number, F.lit(unit).cast("long"))


def _suffixed(text: Column, number: str, factors: dict[str, int], default: str) -> Column:
    """number and suffix of a text as a count of the smallest unit; null if it does not parse."""
    low = F.lower(F.trim(text))
    pattern = rf"^({number})([a-z]+)?$"
    value, suffix = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    factor = F.lit(None).cast("long")
    for name, size in factors.items():
        factor = F.when(suffix == name, F.lit(size).cast("long")).otherwise(factor)
    factor = F.when(suffix == "", F.lit(factors[default]).cast("long")).otherwise(factor)
    return F.when(low.rlike(pattern), F.try_multiply(value.try_cast("long"), factor))


def time_as(text: Column, unit: str) -> Column:
    """A time string in whole units, cut towards zero; without a suffix it is in the unit already."""
    return _whole(_suffixed(text, "-?[0-9]+", TIME, unit), TIME[unit])


def bytes_as(text: Column, unit: str) -> Column:
    """A byte string in whole units; without a suffix it is in the unit already."""
    return _whole(_suffixed(text, "[0-9]+", BYTES, unit), BYTES[unit])


def size_string(size: Column) -> Column:
    """Bytes with one decimal, in the largest unit that the size is over twice of."""
    out = F.concat(F.format_string("%.1f", size.cast("double")), F.lit(" B"))
    for name, unit in reversed(UNITS):
        value = F.round(size.cast("decimal(38,10)") / F.lit(unit).cast("decimal(20,0)"), 1).cast("decimal(20,1)").cast("string")
        out = F.when(size > 2 * unit if 2 * unit < 1 << 63 else F.lit(False), F.concat(value, F.lit(f" {name}"))).otherwise(out)
    return out


def megabytes_string(size: Column) -> Column:
    return size_string(size * (1 << 20))


def host_of(address: Column) -> Column:
    """What stands before the last colon."""
    return F.when(F.contains(address, F.lit(":")), F.trim(F.regexp_extract(address, r"^(?s)(.*):[^:]*$", 1))).otherwise(address)


def port_of(address: Column) -> Column:
    """What stands after the last colon, 0 without one."""
    return F.when(F.contains(address, F.lit(":")), F.trim(F.substring_index(address, ":", -1)).cast("long")).otherwise(F.lit(0).cast("long"))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, F.char_length(text))).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.char_length(text) - len(suffix))).otherwise(text)


def resolve_uri(path: Column, home: str) -> Column:
    """A path with a scheme as it is; others as file: paths, relative ones below home."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(home.rstrip("/") + "/"), path))
    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit("file:"), whole))


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is n or more."""
    digits = F.length(F.bin(n - 1))
    return F.when(n <= 1, n).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), digits)).cast("long")


def whole_words(size: Column) -> Column:
    """Bytes rounded up to a multiple of 8."""
    return (size + F.pmod(8 - size % 8, F.lit(8))).cast("long")


def adler32(body: Column) -> Column:
    """The Adler-32 checksum of a binary or of a text's UTF-8 as a signed 32-bit number, in a long.

    Both halves are plain sums over the bytes, the second one weighted by what
    is left of them, so the time grows as the length (up to 2**28 bytes).
    """

    def whole(data):
        n = F.octet_length(data).cast("long")
        at = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
        values = F.transform(at, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
        begin = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        step = lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + s["a"] + x).alias("b"))
        return F.aggregate(values, begin, step, lambda s: (s["b"] + n) % 65521 * 65536 + (s["a"] + 1) % 65521)

    sum_ = F.element_at(F.transform(F.array(body.cast("binary")), whole), 1)  # the bytes are named once and worked out once
    return F.when(sum_ >= 1 << 31, sum_ - (1 << 32)).otherwise(sum_)


def pack_address(page: Column, offset: Column) -> Column:
    """A page number in the upper 13 bits, an offset in the lower 51."""
    return F.shiftleft(page.cast("long"), 51).bitwiseOR(offset.bitwiseAND((1 << 51) - 1))


def page_of(address: Column) -> Column:
    return F.shiftrightunsigned(address, 51).cast("long")


def offset_of(address: Column) -> Column:
    return address.bitwiseAND((1 << 51) - 1)


def convert_bytes(size: Column, source: str, target: str) -> Column:
    """Whole units of one size in another, cut towards zero; too large is an error."""
    up, down = BYTES[source], BYTES[target]
    return (size * (up // down)).cast("long") if up >= down else _whole(size.cast("long"), down // up)
