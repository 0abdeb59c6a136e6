"""A decoder of MessagePack values, to be given to ``parsed`` and ``read_kafka``.

Maps are read by field name, arrays by the order of the fields. Binary is base64, extensions are lost but for times
(type -1), which are ISO text in UTC; so what is read goes through the schema like JSON does.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values of the format: first byte -> (layout of a number) or size of a length.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {"bin": (0xC4, 0xC5, 0xC6), "ext": (0xC7, 0xC8, 0xC9), "str": (0xD9, 0xDA, 0xDB), "array": (None, 0xDC, 0xDD), "map": (None, 0xDE, 0xDF)}
_KINDS = {code: (kind, 1 << k) for kind, codes in _LENGTHS.items() for k, code in enumerate(codes) if code}
_SINGLE = {0xC0: None, 0xC2: False, 0xC3: True}


def unpack(data: bytes) -> object:
    """The one value that these bytes are; ValueError if they aren't one."""
    value, end = _value(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise ValueError("bytes are missing")
    return data[at : at + n], at + n


def _value(data: bytes, at: int) -> tuple[object, int]:
    (code,), at = _take(data, at, 1)
    if code < 0x80 or code >= 0xE0:
        return (code if code < 0x80 else code - 0x100), at
    if code in _SINGLE:
        return _SINGLE[code], at
    if code in _NUMBERS:
        raw, at = _take(data, at, struct.calcsize(_NUMBERS[code]))
        return struct.unpack(_NUMBERS[code], raw)[0], at
    if code < 0xC0:
        kind, n = ("map", code & 15) if code < 0x90 else ("array", code & 15) if code < 0xA0 else ("str", code & 31)
    elif code in _KINDS:
        kind, width = _KINDS[code]
        raw, at = _take(data, at, width)
        n = int.from_bytes(raw, "big")
    elif 0xD4 <= code <= 0xD8:
        kind, n = "ext", 1 << (code - 0xD4)
    else:
        raise ValueError(f"no value begins with {code:#x}")
    if kind == "array":
        out = []
        for _ in range(n):
            item, at = _value(data, at)
            out.append(item)
        return out, at
    if kind == "map":
        pairs = {}
        for _ in range(n):
            key, at = _value(data, at)
            pairs[str(key)], at = _value(data, at)
        return pairs, at
    if kind == "ext":
        (number,), at = _take(data, at, 1)
        raw, at = _take(data, at, n)
        return (_time(raw) if number == 0xFF else None), at
    raw, at = _take(data, at, n)
    return (raw.decode() if kind == "str" else base64.b64encode(raw).decode()), at


def _time(raw: bytes) -> str:
    if len(raw) == 4:
        seconds, nanos = int.from_bytes(raw, "big"), 0
    elif len(raw) == 8:
        both = int.from_bytes(raw, "big")
        seconds, nanos = both & (1 << 34) - 1, both >> 34
    elif len(raw) == 12:
        nanos, seconds = struct.unpack(">Iq", raw)
    else:
        raise ValueError("no time")
    moment = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds, microseconds=nanos // 1000)
    return moment.isoformat(timespec="microseconds") + "Z"


def decoder(rows: DataFrame, schema: StructType, column: str) -> DataFrame:
    """Bytes to ``value``; what can't be read has its bytes as hexadecimal digits in ``quarantine``."""
    names = schema.names

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            try:
                value = unpack(bytes(data))
                value = dict(zip(names, value, strict=False)) if isinstance(value, list) else value
                return json.dumps(value) if isinstance(value, dict) else None
            except (ValueError, OverflowError, RecursionError):
                return None

        return raw.map(one, na_action="ignore")

    raw = F.col(column)
    rows = rows.withColumn("_text", text(raw)).withColumn("_read", F.from_json("_text", schema))
    bad = raw.isNotNull() & F.col("_read").isNull()
    return rows.withColumn("quarantine", F.when(bad, F.hex(raw))).withColumn("value", F.when(~bad, F.col("_read"))).drop("_text", "_read")
