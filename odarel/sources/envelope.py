"""Results as JSON values and envelopes."""

from __future__ import annotations

import base64
import math
from datetime import UTC, date, datetime, time, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T


def duration(value: timedelta) -> str:
    total = value / timedelta(microseconds=1)
    sign, micros = ("-" if total < 0 else ""), abs(int(total))
    seconds, micros = divmod(micros, 1_000_000)
    days, seconds = divmod(seconds, 86_400)
    hours, seconds = divmod(seconds, 3600)
    minutes, seconds = divmod(seconds, 60)
    fraction = f".{micros:06d}".rstrip("0") if micros else ""
    clock = f"{f'{hours}H' if hours else ''}{f'{minutes}M' if minutes else ''}{f'{seconds}{fraction}S' if seconds or fraction else ''}"
    return f"{sign}P{f'{days}D' if days else ''}{f'T{clock}' if clock or not days else ''}" if clock or days else "PT0S"


def plain(value, kind: T.DataType | None = None):
    """A value as JSON has it: 64-bit integers and decimals as text, instants in UTC."""
    if value is None:
        return None
    if isinstance(kind, T.LongType) and isinstance(value, int):
        return value if abs(value) < 1 << 53 else str(value)
    if isinstance(value, bool) or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else {math.inf: "INF", -math.inf: "-INF"}.get(value, "NaN")
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, datetime):
        value = value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)
        return value.isoformat(timespec="milliseconds" if value.microsecond % 1000 == 0 else "microseconds").replace("+00:00", "Z")
    if isinstance(value, (date, time)):
        return value.isoformat()
    if isinstance(value, timedelta):
        return duration(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, Row):
        fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        return {k: plain(v, fields.get(k)) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        return [plain(v, inner) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return str(value)


def rows(df: DataFrame, found: list[Row] | None = None) -> list[dict]:
    """A page as plain values; the caller has cut it."""
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    return [{k: plain(v, kind) for (k, kind), v in zip(fields, r, strict=True)} for r in (df.collect() if found is None else found)]


def raw(value) -> str | bytes:
    """A property's $value."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    value = plain(value)
    return str(value).lower() if isinstance(value, bool) else str(value)


def write_lines(df: DataFrame, path: str) -> None:
    """A result of any size as JSON lines, written by the executors."""
    df.write.json(path, ignoreNullFields=False)
