"""Bytes as Column expressions: integers, checksums, previews and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data, position) -> Column:
    """The unsigned byte at a position from 0; null beyond the end."""
    one = F.substring(data, F.lit(position) + 1 if not isinstance(position, Column) else position + 1, F.lit(1))
    return F.ascii(F.decode(F.when(F.length(one) > 0, one), "ISO-8859-1"))


def byte_array(data: Column) -> Column:
    """All bytes; what makes ``data`` is worked out once, not for each byte."""
    of = lambda d: F.when(F.length(d) > 0, F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: byte_at(d, i))).otherwise(F.array().cast("array<int>"))
    return F.get(F.transform(F.array(data), of), F.lit(0))


def unsigned(data: Column, position: int, size: int, little: bool = True) -> Column:
    parts = range(size) if little else reversed(range(size))
    return sum((byte_at(data, position + p).cast("long") * (1 << 8 * k) for k, p in enumerate(parts)), F.lit(0).cast("long"))


def signed(data: Column, position: int, size: int, little: bool = True) -> Column:
    u = unsigned(data, position, size, little)
    return F.when(u >= 1 << (8 * size - 1), u - (1 << 8 * size)).otherwise(u)


def checksum(data: Column) -> Column:
    """Sum of the bytes modulo 256."""
    return F.aggregate(byte_array(data), F.lit(0), lambda s, b: s + b) % 256


def _crc8_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [(c << 1 ^ (c >> 7) * 7) & 255 for c in table]
    return table


CRC8 = _crc8_table()


def crc8(data: Column) -> Column:
    """CRC with the polynomial 0x07, most significant bit first, from 0; by a table, a step for each byte."""
    return crc8_of(byte_array(data))


def crc8_of(values: Column) -> Column:
    """``crc8`` of an array of bytes."""
    return F.aggregate(values, F.lit(0), lambda crc, b: F.get(F.array(*map(F.lit, CRC8)), crc.bitwiseXOR(b)))


def hex_preview(data: Column) -> Column:
    """Upper-case hex bytes with blanks between."""
    return F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def ascii_preview(data: Column) -> Column:
    """Printable ASCII as it is, a dot for every other byte."""
    return F.array_join(F.transform(byte_array(data), lambda b: F.when(b.between(32, 126), F.char(b)).otherwise(".")), "")


def marker_positions(data: Column, marker: bytes) -> Column:
    """All positions of a marker, overlapping ones too."""
    text, m = F.hex(data), marker.hex().upper()
    last = F.length(data) - len(marker)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int")), lambda i: F.substring(text, i * 2 + 1, F.lit(len(m))) == m)).otherwise(F.array().cast("array<int>"))
