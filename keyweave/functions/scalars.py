"""Times as milliseconds, headers as values, texts as literals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType


def to_millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def header(headers: Column, name: str) -> Column:
    """The bytes of the last header of a name, null without one."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(-1))["value"]


#: Where the 16 bytes of a uuid are in its text (three fields little-endian, the rest as they are).
UUID_BYTES = (3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15)
UUID_FIELDS = (4, 2, 2, 2, 6)
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: First bytes of MessagePack integers that have a body, with its size and whether it is signed.
_PACKED = {"CC": (1, False), "CD": (2, False), "CE": (4, False), "CF": (8, False), "D0": (1, True), "D1": (2, True), "D2": (4, True), "D3": (8, True)}


def _number(digits: Column, size: int, signed: bool = True) -> Column:
    """An integer of so many bytes from hexadecimal digits, as a decimal."""
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if not signed:
        return number
    whole, half = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (8 * size, 8 * size - 1))
    return F.when(number >= half, number - whole).otherwise(number)


def _reordered(digits: Column, order: tuple[int, ...]) -> Column:
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in order))


def header_value(headers: Column, name: str, kind: str) -> Column:
    """A header as string, int or long (raw little-endian bytes of 4 or 8, or MessagePack), or uuid (16 bytes, or text)."""
    raw = header(headers, name)
    if kind == "string":
        return F.decode(raw, "UTF-8")
    digits, length = F.hex(raw), F.length(raw)
    if kind in ("int", "long"):
        size = 4 if kind == "int" else 8
        found = F.when(length == size, _number(_reordered(digits, tuple(range(size))[::-1]), size))
        lead, body = F.substring(digits, 1, 2), F.substring(digits, 3, 16)
        found = found.when((length == 1) & ((lead < "80") | (lead >= "E0")), _number(lead, 1))
        for code, (n, signed) in _PACKED.items():
            found = found.when((length == n + 1) & (lead == code), _number(body, n, signed))
        return found.try_cast(kind)
    if kind == "uuid":
        turned = F.lower(_reordered(digits, UUID_BYTES))
        at, fields = 1, []
        for n in UUID_FIELDS:
            fields.append(F.substring(turned, at, 2 * n))
            at += 2 * n
        text = F.decode(F.when(length == 36, raw), "UTF-8")
        return F.when(length == 16, F.concat_ws("-", *fields)).when(text.rlike(_UUID), F.lower(text))
    return raw


def header_bytes(value: Column, kind: str) -> Column:
    """The bytes of a header that header_value reads as this value."""
    if kind in ("int", "long"):
        size = 4 if kind == "int" else 8
        digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))
        return F.unhex(_reordered(digits, tuple(range(size))[::-1]))
    if kind == "uuid":
        return F.unhex(_reordered(F.upper(F.replace(value, F.lit("-"), F.lit(""))), UUID_BYTES))
    return value if kind == "bytes" else F.encode(value.cast("string"), "UTF-8")


class Unparsable(ValueError):
    pass


def parse(text: str, kind: DataType, names: tuple[str, ...] = ()) -> object:
    """A literal of a column's type from the text of a query; Unparsable if it isn't one."""
    try:
        if names:
            return next(n for n in names if n.lower() == text.lower())
        if isinstance(kind, StringType):
            return text
        if isinstance(kind, BooleanType):
            return {"true": True, "false": False}[text.strip().lower()]
        if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
            return int(text)
        if isinstance(kind, (FloatType, DoubleType)):
            return float(text)
        if isinstance(kind, DecimalType):
            return Decimal(text)
        if isinstance(kind, DateType):
            return dt.date.fromisoformat(text)
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            found = dt.datetime.fromisoformat(text)
            if isinstance(kind, TimestampNTZType):
                return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found
            return found if found.tzinfo else found.replace(tzinfo=dt.UTC)
    except (ValueError, KeyError, StopIteration, InvalidOperation) as e:
        raise Unparsable(text) from e
    raise Unparsable(text)
